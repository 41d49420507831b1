"""Removal of repeated long substrings by suffix arrays.

A string of LEAST bytes that occurs twice has its smallest k-gram hash, its anchor, at the same place in both occurrences.
So starts of strings are cut into intervals of equal anchor; only intervals whose anchor hash occurs again are looked into,
and all that may hold equal strings meet under one hash. Of intervals with the same bytes the first and last
go on, put together to stretches where their texts go on alike, each with the bytes of its own text.
Two others with an equal string also agree in half of what is left of it beside the anchor, before or after it; one that
agrees with none repeats nothing. The texts of all others are put together, and their suffixes sorted in two stages: those
smaller than their successors directly, the others by scans over the buckets of first bytes. Neighbours with a common
prefix of LENGTH bytes are repeats, which are removed; those of LEAST bytes are shared passages, which are counted.

Where a text repeats itself with one period, anchors would change at every turn. Of such a run only the strings of its
first two periods, and those that reach beyond it, go this way; each other one equals the string one period before it.

An anchor of very many different intervals is dealt out further: its intervals are cut into slices of starts at nearly
the same distance from the anchor, and slices meet that agree in all bytes that every string of the slice has in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scratch import Scratch
from .common import annotate, cut, groups_of, keep_heap, mix, small_batches, span_hasher, span_hashes, text_bytes

#: Bytes of a string that is removed where it repeats, and of one that makes a shared passage (about 50 words).
LENGTH, LEAST = 400, 304
K = 32
#: Parts text between regions; no byte of UTF-8.
BREAK = 255
#: Bytes of regions that are sorted at a time, about.
BATCH = 1 << 20
#: Bytes of a text after which a stretch that it has in common with another is cut.
CHUNK = 1 << 16
#: Regions of one group that are sorted together. Groups of more are dealt out by slices, then sorted the same way.
TOGETHER = 1_000
#: Distances from the anchor that a slice spans, level by level.
WIDTHS = (64, 16, 4, 1)
#: Groups beyond TOGETHER are broadcast up to this many; they are a thousandth of all regions at most.
MAX_BROADCAST = 100_000
_NONE = (np.int64, np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64)


def anchors(data: np.ndarray, at: np.ndarray, length: int = LENGTH, least: int = LEAST, starts: int | None = None, k: int = K) -> tuple[np.ndarray, ...]:
    """Intervals of starts with one anchor: row, first start in the row, number of starts, bytes of the region, place of
    the anchor in it, anchor hash, region hash, and two hashes of 32 bits, of the bytes before and after the anchor (0 where
    the region has too few of them).

    Strings have least bytes. The region of an interval is what strings of length bytes cover, or the row's end. Rows of
    data must have under 2^21 bytes together. Only the first starts of data are taken, if that is given. Starts that
    periodic() leaves out come as intervals with a region of no bytes.
    """
    n = len(data)
    if n < least:
        return tuple(np.zeros(0, d) for d in _NONE)
    place = np.arange(n - k + 1)
    hashes = span_hashes(data, place, place + k)
    keys = (hashes >> np.uint64(21) << np.uint64(21)) | place.astype(np.uint64)
    span, width = least - k + 1, 1
    low = keys
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[: n - least + 1]
    good = np.flatnonzero(np.arange(n - least + 1) + least <= at[row + 1])
    if starts is not None:
        good = good[good < starts]
    if not len(good):
        return tuple(np.zeros(0, d) for d in _NONE)
    anchor = (low[good] & np.uint64((1 << 21) - 1)).astype(np.int64)
    turn = np.flatnonzero((anchor[1:] != anchor[:-1]) & (row[good[1:]] == row[good[:-1]]) & (hashes[anchor[1:]] == hashes[anchor[:-1]]))
    known = np.zeros(0, np.int64)
    if len(turn):
        out = periodic(data, at, np.unique(anchor[turn + 1] - anchor[turn]), length)[good]
        known, good, anchor = good[out], good[~out], anchor[~out]
    fresh = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (good[1:] != good[:-1] + 1) | (row[good[1:]] != row[good[:-1]])])
    first = good[fresh]
    count = np.diff(np.r_[fresh, len(good)])
    end = np.minimum(first + count - 1 + length, at[row[first] + 1])
    spans = span_hasher(data)
    region = mix(spans(first, end) ^ count.astype(np.uint64))
    middle, half, top = anchor[fresh], (least - k) // 2, np.uint64(32)
    before = np.where(middle - half >= first, spans(np.maximum(middle - half, 0), middle) >> top | np.uint64(1), np.uint64(0))
    after = np.where(middle + k + half <= end, spans(middle + k, np.minimum(middle + k + half, n)) >> top | np.uint64(1), np.uint64(0))
    found = row[first], first - at[row[first]], count, end - first, middle - first, hashes[middle], region, before << top | after
    if not len(known):
        return found
    edge = np.flatnonzero(np.r_[True, (known[1:] != known[:-1] + 1) | (row[known[1:]] != row[known[:-1]])])
    begin, nothing = known[edge], np.zeros(len(edge), np.int64)
    ones = row[begin], begin - at[row[begin]], np.diff(np.r_[edge, len(known)])
    return tuple(np.r_[x, y] for x, y in zip(found, (*ones, nothing, nothing, *[nothing.astype(np.uint64)] * 3)))


def periodic(data: np.ndarray, at: np.ndarray, periods: np.ndarray, length: int) -> np.ndarray:
    """Whether the string of length bytes at each place equals the one a period before it, which is not the first of its kind.

    Of a run with a period (within one row) the starts of the first two periods stay. Runs of several periods that overlap
    are left out for the smallest only, so that what a string is equal to stays.
    """
    out, taken = np.zeros(len(data), bool), np.zeros(len(data), bool)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    step, probe = max(1, length // 2), min(8, length // 2)  # a run holds a probe: bytes from a multiple of step on
    for p in periods.tolist():
        some = np.arange(0, max(0, len(data) - p - probe + 1), step)
        for d in range(probe):
            some = some[data[some + d] == data[some + p + d]]
        if not len(some):
            continue
        same = (data[p:] == data[:-p]) & (row[p:] == row[:-p])
        edge = np.flatnonzero(np.diff(np.r_[False, same, False].astype(np.int8)))
        begin, end = edge[::2], edge[1::2] + p
        for i in np.flatnonzero(end - begin >= length + 2 * p).tolist():
            run = slice(int(begin[i]), int(end[i]))
            if not taken[run].any():
                out[run.start + 2 * p : run.stop - length + 1] = True
                taken[run] = True
    return out


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that starts after it; the last is not."""
    step = np.sign(np.diff(text.astype(np.int16)))
    step = np.append(step, -1)
    known = np.where(step != 0, np.arange(len(text)), len(text))
    following = np.minimum.accumulate(known[::-1])[::-1]
    return step[following] > 0


def words_at(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number that sorts as they do; beyond the end are zeros."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j : j + len(text)]
    return out


def samples(text: np.ndarray, small: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that are sorted directly, in order, and which of them count: those of small suffixes before larger ones. In
    gaps between them every fifth place is taken too, so that the next one is near."""
    last = np.flatnonzero(small[:-1] & ~small[1:])
    if not len(last):
        return last, np.zeros(0, bool)
    more = (np.diff(np.append(last, len(text))) - 1) // 5
    first = np.cumsum(more + 1) - more - 1
    place = np.repeat(last, more + 1) + 5 * (np.arange(len(last) + int(more.sum())) - np.repeat(first, more + 1))
    counts = np.zeros(len(place), bool)
    counts[first] = True
    return place, counts


def sort_directly(text: np.ndarray, small: np.ndarray, words: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Small suffixes whose successors are not, sorted by the first depth bytes from each on; those that agree in all of them
    stay as they are, and so do those that agree as far as a BREAK and in it. left: bytes from each place to a BREAK.

    Samples are ranked by 7 bytes and the distance to the next sample: of two that agree in 7 bytes the one with the
    nearer is smaller, as there it goes on with a larger suffix that is no small one. Then ranks are doubled: those that
    agree are split by the ranks of the samples that follow as many samples later as they are known to agree in.
    """
    place, counts = samples(text, small)
    m = len(place)
    if not m:
        return place
    key = words[place] >> np.uint64(8) << np.uint64(8) | np.diff(np.append(place, len(text))).astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    spot = np.arange(m)  # of those not settled in order
    fresh = np.append(True, key[1:] != key[:-1])
    rank = np.zeros(m, np.uint32)
    ends = np.concatenate([place, np.full(2 * depth, len(text))]).astype(np.int32)
    stop = (place + np.minimum(left[place] + 1, depth)).astype(np.int32)
    some, step = order, 1
    while True:
        number = np.flatnonzero(fresh)
        size = np.diff(np.append(number, len(spot)))
        rank[some] = np.repeat(spot[number], size)
        several = np.flatnonzero(np.repeat(size > 1, size))
        several = several[ends[some[several] + step] < stop[some[several]]]
        spot, some = spot[several], some[several]
        if not len(spot):
            return place[order[counts[order]]]
        key = rank[some].astype(np.uint64) << np.uint64(32) | rank[some + step]
        turn = np.argsort(key)
        some, key = some[turn], key[turn]
        order[spot] = some
        fresh = np.append(True, key[1:] != key[:-1])
        step *= 2


def layers(text: np.ndarray, bucket: np.ndarray, c: int) -> list[np.ndarray]:
    """Suffixes that put ever more bytes c before those of bucket."""
    out = []
    while len(bucket):
        before = bucket[bucket > 0] - 1
        bucket = before[text[before] == c]
        out.append(bucket)
    return out


def deal(queued: list[list[np.ndarray]], text: np.ndarray, before: np.ndarray) -> None:
    """Put each place into the queue of its byte."""
    first = text[before]
    order = np.argsort(first, kind="stable")
    before, first = before[order], first[order]
    edge = np.flatnonzero(np.append(True, first[1:] != first[:-1])) if len(first) else np.zeros(0, np.int64)
    for b, lo, hi in zip(first[edge].tolist(), edge.tolist(), np.append(edge[1:], len(first)).tolist()):
        queued[b].append(before[lo:hi])


def suffix_array(text: np.ndarray, left: np.ndarray, depth: int = LENGTH, words: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of text, which ends with BREAK, in order of their first depth bytes, or as far as a BREAK. left: bytes to the next.

    Suffixes smaller than their successors are sorted directly where that is not so of the successor. A scan over the
    buckets of first bytes from the last one on puts the other small ones in the order of their successors. Each other
    suffix is larger than its successor, so it is known, bucket by bucket from the first one on, once all smaller suffixes are.
    """
    small = smaller_than_next(text)
    direct = sort_directly(text, small, words_at(text) if words is None else words, left, depth)
    edge = np.searchsorted(text[direct], np.arange(257))
    queued: list[list[np.ndarray]] = [[] for _ in range(256)]
    of_small: list[np.ndarray] = [direct[:0]] * 256
    for c in range(255, -1, -1):
        own = direct[edge[c] : edge[c + 1]]
        if queued[c]:  # by their second byte; of equal ones those whose successor is no small suffix come first
            own = np.concatenate([own, *queued[c]])
            own = own[np.argsort(text[own + 1], kind="stable")]
        queued[c] = []
        if not len(own):
            continue
        of_small[c] = bucket = np.concatenate([*layers(text, own, c)[::-1], own])
        before = bucket[bucket > 0] - 1
        deal(queued, text, before[text[before] < c])
    queued[BREAK].append(np.array([len(text) - 1]))
    out = []
    for c in range(256):
        first = np.concatenate(queued[c]) if queued[c] else direct[:0]
        queued[c] = []
        # Runs of one byte: each layer stands after the one it comes from.
        bucket = np.concatenate([first, *layers(text, first, c), of_small[c]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        deal(queued, text, before[text[before] > c])
    return np.concatenate(out) if out else direct


def alike(text: np.ndarray, words: np.ndarray, one: np.ndarray, two: np.ndarray, bound: int) -> np.ndarray:
    """Whether the bound bytes from each place of one on are those from the place of two on; bound is at least 8.

    Pairs whose strings overlap at one distance share what is compared, a byte each.
    """
    out = words[one] == words[two]
    for d in (bound - 8, bound // 2):
        near = np.flatnonzero(out)
        out[near] = words[one[near] + d] == words[two[near] + d]
    near = np.flatnonzero(out)
    if not len(near):
        return out
    low = np.minimum(one[near], two[near])
    key = (np.abs(one[near] - two[near]) << 32) | low
    turn = np.argsort(key)
    near, low, key = near[turn], low[turn], key[turn]
    edge = np.flatnonzero(np.append(True, np.diff(key) > bound))
    size = low[np.append(edge[1:], len(near)) - 1] + bound - low[edge]
    ends = np.cumsum(size)
    for lo, hi in groups_of(np.append(0, ends), BATCH):
        begin = ends[lo:hi] - size[lo:hi] - (ends[lo] - size[lo])
        x = np.arange(begin[-1] + size[hi - 1], dtype=np.int32) + np.repeat((low[edge[lo:hi]] - begin).astype(np.int32), size[lo:hi])
        apart = np.repeat((key[edge[lo:hi]] >> 32).astype(np.int32), size[lo:hi])
        differ = np.append(0, np.cumsum(text[x] != text[x + apart], dtype=np.int32))
        part = slice(edge[lo], edge[hi] if hi < len(edge) else len(near))
        at = low[part] + np.repeat(begin - low[edge[lo:hi]], np.diff(np.append(edge[lo:hi], part.stop)))
        out[near[part]] = differ[at] == differ[at + bound]
    return out


def repeated_runs(regions: list[bytes], counts: list[int], length: int = LENGTH, least: int = LEAST) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]:
    """Runs of starts, among the first so many of each region, whose strings start elsewhere too: of length bytes, and of
    least bytes. Each as its region's number, first and last start. A start has least bytes after it in its region."""
    text = np.frombuffer(b"".join(x for r in regions for x in (r, bytes([BREAK]))), np.uint8)
    sizes = np.array([len(r) + 1 for r in regions])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    left = np.repeat(ends - 1, sizes) - np.arange(len(text))  # bytes to the end of the region
    valid = np.arange(len(text)) < np.repeat(begins + np.asarray(counts), sizes)
    words = words_at(text)
    array = suffix_array(text, left, length, words)
    array = array[valid[array]]
    one, two = array[:-1], array[1:]
    found = []
    for bound in (least, length):
        whole = np.minimum(left[one], left[two]) >= bound
        one, two = one[whole], two[whole]
        same = alike(text, words, one, two, bound)
        one, two = one[same], two[same]
        twice = np.zeros(len(text) + 1, bool)  # False at each BREAK
        twice[one] = True
        twice[two] = True
        edge = np.flatnonzero(twice != np.append(False, twice[:-1]))
        first, last = edge[::2], edge[1::2] - 1
        of = np.searchsorted(begins, first, side="right") - 1
        found.insert(0, (of, first - begins[of], last - begins[of]))
    return tuple(found)


def as_lists(of: np.ndarray, first: np.ndarray, last: np.ndarray, n: int, names: tuple[str, str] = ("first", "last")) -> pa.Array:
    """Lists of pairs for n rows; of: the row of each pair, in order."""
    at = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(first), pa.array(last)], names=list(names)))


RUNS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))


def mark_intervals(texts: DataFrame, length: int, least: int) -> DataFrame:
    """key, lo, n, size, a, h, r and beside of all intervals of (key, text) rows."""
    small_batches(texts.sparkSession)
    names = ["key", "lo", "n", "size", "a", "h", "r", "beside"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_heap()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            data, at = text_bytes(batch.column(1))
            piece = 1 << 20
            for lo, hi in groups_of(at, piece):
                # A very long text is cut into pieces that overlap: each start is taken in one of them.
                long = at[hi] - at[lo] > piece
                for s in range(0, int(at[hi] - at[lo]), piece) if long else [0]:
                    part = data[at[lo] + s : min(at[lo] + s + piece + length, at[hi])] if long else data[at[lo] : at[hi]]
                    own = np.array([0, len(part)]) if long else at[lo : hi + 1] - at[lo]
                    row, first, count, size, a, *hashed = anchors(part, own, length, least, piece if long else None)
                    if len(row):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[lo + row], first + s, count, size, a, *[x.view(np.int64) for x in hashed])], names=names)

    return texts.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def cut_regions(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the region of each of the wanted rows (key, lo, size, h, r, copy, n, a).

    A text meets all that is wanted of it in one row: an interval for every 100 bytes or so, as runs with a period have few
    (see periodic), so that no row is much longer than its text. Regions leave in batches of 512.
    """
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("h", "r", "copy", "n", "a", "lo", "size")).alias("take"))
    whole = ["h", "r", "copy", "n", "a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column(0))
            for i, take in enumerate(batch.column(1)):
                take = take.values
                lo, size = take.field("lo").to_numpy() + at[i], take.field("size").to_numpy()
                for j in range(0, len(take), 512):
                    regions = [data[x : x + y].tobytes() for x, y in zip(lo[j : j + 512], size[j : j + 512])]
                    yield pa.RecordBatch.from_arrays([*[take.field(c).slice(j, 512) for c in whole], pa.array(regions, pa.binary())], names=[*whole, "region"])

    # The same columns as in the last join with all texts, so that one shuffle of the texts serves both.
    joined = base.join(lists, "key").select("text", "take", "doc_id")
    return joined.mapInArrow(run, "h long, r long, copy int, n long, a long, region binary")


def sort_regions(regions: DataFrame, length: int, least: int) -> DataFrame:
    """g, q and the runs of repeated starts (see repeated_runs) of each region (g, q, copy, n, region).

    All regions of a group g are sorted together. What occurs several times comes twice, as copy 0 and 1, so that its
    strings have equal ones beside them; what is found goes to copy 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_heap()

        def done(rows: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
            found = repeated_runs([x[4] for x in rows], [x[3] for x in rows], length, least)
            own = np.flatnonzero([not x[2] for x in rows])
            ids = [pa.array([rows[j][i] for j in own], pa.int64()) for i in (0, 1)]
            lists = [as_lists(*x, len(rows)).take(pa.array(own)) for x in found]
            return pa.RecordBatch.from_arrays([*ids, *lists], names=["g", "q", "runs", "passages"])

        rows: list[tuple[int, int, int, int, bytes]] = []
        size = 0
        for batch in batches:
            for g, q, copy, n, region in zip(*[c.to_pylist() for c in batch.columns]):
                if rows and g != rows[-1][0]:
                    if size > BATCH:
                        yield done(rows)
                        rows, size = [], 0
                elif rows and (q, copy) == rows[-1][1:3]:
                    continue  # of a row that repeats
                rows.append((g, q, copy, n, region))
                size += len(region) + 1
        if rows:
            yield done(rows)

    shape = T.StructType([T.StructField("g", T.LongType()), T.StructField("q", T.LongType()), T.StructField("runs", RUNS), T.StructField("passages", RUNS)])
    return regions.select("g", "q", "copy", "n", "region").repartition("g").sortWithinPartitions("g", "q", "copy").mapInArrow(run, shape).where(F.size("passages") > 0)


def slices(rows: DataFrame, width: int, length: int, least: int) -> DataFrame:
    """Rows (h, r, off, g, q, n, a, region) cut into slices of starts, of the same columns.

    A slice's starts lie in a range of width distances before the anchor, so all its strings of least bytes have the bytes
    from the last such start to the end of the first such string in common. These and the range make the group.
    A width of 0 takes slices of a single start and puts those together that agree in length bytes.
    """
    names = ["h", "r", "off", "g", "q", "n", "a", "region"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in names}
            for h, r, off, g, n, a, region in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5, 6, 7)]):
                data = np.frombuffer(region, np.uint8)
                wide = max(1, width)
                ranges = np.arange(max(0, a - n + 1) // wide, a // wide + 1)
                lo = np.maximum(0, a - ranges * wide - wide + 1)
                hi = np.minimum(n - 1, a - ranges * wide)
                end = np.minimum(hi + length, len(data))
                core = (lo, end) if not width else (a - ranges * wide, a - ranges * wide - wide + 1 + least)
                salt = np.uint64(g & (1 << 64) - 1) ^ mix(ranges.astype(np.uint64) * np.uint64(8) + np.uint64(width.bit_length()))
                groups = mix(span_hashes(data, *core) ^ salt).view(np.int64)
                kinds = mix(span_hashes(data, lo, end) ^ (hi - lo + 1).astype(np.uint64)).view(np.int64)
                for j in range(len(ranges)):
                    for c, x in zip(names, (h, r, off + int(lo[j]), groups[j], kinds[j], int(hi[j] - lo[j] + 1), int(a - lo[j]), region[lo[j] : end[j]])):
                        out[c].append(x)
            if out["h"]:
                yield pa.RecordBatch.from_arrays([pa.array(out[c], pa.binary() if c == "region" else pa.int64()) for c in names], names=names)

    return rows.select(*names).mapInArrow(run, ", ".join(f"{c} {'binary' if c == 'region' else 'long'}" for c in names))


def shifted(column: str, by: str):
    return F.transform(column, lambda x: F.struct((x["first"] + F.col(by)).alias("first"), (x["last"] + F.col(by)).alias("last")))


def groups_beyond(kinds: DataFrame, group: str, together: int) -> tuple[DataFrame, bool]:
    """Groups of more than together rows, marked for broadcast where they are few enough, and whether there are any."""
    many = cut(kinds.groupBy(group).agg(F.count("*").alias("kinds")).where(F.col("kinds") > together).select(group))
    n = many.count()
    return (F.broadcast(many) if n <= MAX_BROADCAST else many), n > 0


def dealt_out(rows: DataFrame, length: int, least: int, together: int) -> DataFrame:
    """h, r, runs and passages of the regions (h, r, off, g, q, n, a, region) of groups that are too large to sort.

    Level by level slices get narrower, so what meets agrees in more bytes; groups that are small enough are sorted. The
    last groups agree in all bytes of their single strings, so they hold one kind each.
    """
    out = None
    for width in (*WIDTHS, 0):
        rows = cut(slices(rows, width, length, least))
        kinds = rows.groupBy("g", "q").agg(F.count("*").alias("m"), F.min("n").alias("n"), F.min("region").alias("low"), F.max("region").alias("high"))
        kinds = kinds.select("g", "q", "n", F.posexplode(F.when(F.col("m") > 1, F.array("low", "high")).otherwise(F.array("low"))).alias("copy", "region"))
        many, some = groups_beyond(rows.select("g", "q").distinct(), "g", together)
        found = sort_regions(kinds.join(many, "g", "left_anti"), length, least)
        found = rows.select("h", "r", "off", "g", "q").join(found, ["g", "q"]).select("h", "r", shifted("runs", "off").alias("runs"), shifted("passages", "off").alias("passages"))
        out = found if out is None else out.unionByName(found)
        if not some:
            break
        rows = rows.join(many, "g", "left_semi")
        if width == 1:  # those that agree in a whole string of least bytes
            all_starts = F.array(F.struct(F.col("off").alias("first"), F.col("off").alias("last")))
            out = out.unionByName(rows.select("h", "r", F.array().cast(RUNS).alias("runs"), all_starts.alias("passages")))
    return out


def stretches(kinds: DataFrame) -> DataFrame:
    """Kinds (h, r, one, two) of intervals that occur several times, put together where both their first and their last
    occurrence go on in the same two texts: g and q of the stretch, where it begins in both, and off, its distance to each kind.

    So bytes that neighbours have in common are sorted once. A stretch is cut where CHUNK bytes of the first text end.
    """
    rows = kinds.select("h", "r", F.col("one.n").alias("n"), F.col("one.size").alias("size"), F.col("one.key").alias("k1"), F.col("one.lo").alias("l1"), F.col("two.key").alias("k2"), (F.col("two.lo") - F.col("one.lo")).alias("apart"))
    rows = rows.withColumn("g", F.xxhash64("k1", "k2", "apart", F.floor(F.col("l1") / CHUNK)))
    order = Window.partitionBy("g").orderBy("l1")
    fresh = F.coalesce(F.col("l1") > F.lag(F.col("l1") + F.col("n")).over(order), F.lit(True))
    rows = rows.withColumn("fresh", fresh.cast("long")).withColumn("q", F.sum("fresh").over(order))
    whole = Window.partitionBy("g", "q")
    rows = rows.withColumn("lo", F.min("l1").over(whole)).withColumn("starts", F.max(F.col("l1") + F.col("n")).over(whole)).withColumn("end", F.max(F.col("l1") + F.col("size")).over(whole))
    return rows.select("g", "q", "h", "r", "n", "k1", "k2", "apart", "lo", (F.col("starts") - F.col("lo")).alias("starts"), (F.col("end") - F.col("lo")).alias("bytes"), (F.col("l1") - F.col("lo")).alias("off"))


def pairs_of(members: DataFrame) -> DataFrame:
    """The two regions of every stretch, as cut_regions() takes them: each with the bytes of its own text."""
    ends = F.array(F.struct(F.col("k1").alias("key"), F.col("lo").alias("lo")), F.struct(F.col("k2").alias("key"), (F.col("lo") + F.col("apart")).alias("lo")))
    rows = members.where("off = 0").select("g", "q", "starts", "bytes", F.posexplode(ends).alias("copy", "at"))
    return rows.select(F.col("g").alias("h"), F.col("q").alias("r"), "copy", "at.key", "at.lo", F.col("starts").alias("n"), F.col("bytes").alias("size"), F.lit(0).cast("long").alias("a"))


def within(column: str):
    """The part of a stretch's runs that a member's n starts from off on hold."""
    part = F.transform(column, lambda x: F.struct((F.greatest(x["first"], F.col("off")) - F.col("off")).alias("first"), (F.least(x["last"], F.col("off") + F.col("n") - 1) - F.col("off")).alias("last")))
    return F.filter(part, lambda x: x["first"] <= x["last"])


def repeated(base: DataFrame, length: int = LENGTH, least: int = LEAST, together: int = TOGETHER) -> DataFrame:
    """key, runs and passages: the first and last start of all strings of length (and least) bytes that start at least
    twice in base's rows (doc_id, text, key).

    Rows with equal keys must have equal texts; each counts.
    """
    # Written out, so that texts are read through once, the join's sides are dealt anew and a hash of very many rows can be split.
    scratch = Scratch(base.sparkSession)
    every = scratch.keep(mark_intervals(base.select("key", "text"), length, least))
    often = scratch.keep(every.where("size > 0").groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"))
    marks = scratch.keep(every.where("size > 0").join(often, "h", "left_semi"))
    at = F.struct("key", "lo", "n", "size", "a")
    kinds = marks.groupBy("h", "r").agg(F.count("*").alias("m"), F.min(at).alias("one"), F.max(at).alias("two"), F.min("beside").alias("beside"))
    side = lambda n, x: F.when(x != 0, F.xxhash64("h", F.lit(n), x))
    sides = F.array_compact(F.array(side(0, F.shiftrightunsigned("beside", 32)), side(1, F.col("beside").bitwiseAND(0xFFFFFFFF))))
    sides = kinds.select("h", "r", F.explode(sides).alias("side"))
    shared = sides.groupBy("side").agg(F.count("*").alias("c")).where("c > 1").select("side")
    near = sides.join(shared, "side", "left_semi").select("h", "r", F.lit(True).alias("near")).distinct()
    kinds = scratch.keep(kinds.join(near, ["h", "r"], "left").where("near or m > 1"))
    members = scratch.keep(stretches(kinds.where("m > 1")))
    kinds = kinds.where("near").select("h", "r", F.lit(0).alias("copy"), "one.*")
    many, some = groups_beyond(kinds, "h", together)
    small_batches(base.sparkSession)
    wanted = pairs_of(members).unionByName(kinds.join(many, "h", "left_anti") if some else kinds)
    found = scratch.keep(sort_regions(cut_regions(base, wanted).withColumnsRenamed({"h": "g", "r": "q"}), length, least))
    found = found.withColumnsRenamed({"g": "h", "q": "r"}).unionByName(members.join(found, ["g", "q"]).select("h", "r", within("runs").alias("runs"), within("passages").alias("passages")))
    if some:
        hot = cut_regions(base, kinds.join(many, "h", "left_semi"))
        hot = hot.dropDuplicates(["h", "r"]).select("h", "r", F.lit(0).cast("long").alias("off"), F.col("h").alias("g"), F.col("r").alias("q"), "n", "a", "region")
        found = found.unionByName(dealt_out(hot, length, least, together))
    back = marks.join(found, ["h", "r"]).select("key", shifted("runs", "lo").alias("runs"), shifted("passages", "lo").alias("passages"))
    run = F.array(F.struct(F.col("lo").alias("first"), (F.col("lo") + F.col("n") - 1).alias("last")))
    back = back.unionByName(every.where("size = 0").select("key", run.alias("runs"), run.alias("passages")))
    return back.groupBy("key").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("passages")).alias("passages"))


def covered(spans: pa.ListArray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged byte ranges that the strings of each row's runs cover: their row, start and end, in order."""
    row = np.repeat(np.arange(len(spans)), spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    values = spans.flatten()
    first, end = values.field("first").to_numpy(), values.field("last").to_numpy() + length
    order = np.lexsort((first, row))
    row, first, end = row[order], first[order], end[order]
    # Rows are put one behind the other, so that the furthest end so far is one of the row's own.
    far = (int(end.max()) if len(end) else 0) + 1
    reach = np.maximum.accumulate(end + row * far)
    edge = np.flatnonzero(np.append(True, (first + row * far)[1:] > reach[:-1]) if len(row) else row)
    last = np.append(edge, len(row))[1:] - 1
    return row[edge], first[edge], reach[last] - row[edge] * far


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, least: int = LEAST, together: int = TOGETHER, with_bytes: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared, removed_spans, and kept
    (bytes) if asked.

    Each byte is removed that a string of length bytes covers which also starts anywhere else in docs, the same text
    included; overlaps count, and no string crosses texts. n_shared counts the bytes that shorter strings, of least bytes
    (up to length), cover in the same way; they are not removed. Null texts are empty, and an empty table gives no rows.
    Rows that repeat count as copies of each other; so each byte of a tie goes, none is kept as the first. Two rows of one
    doc_id and different texts are different rows. Very long texts are worked through in pieces that overlap, with the
    same result. Columns of docs other than the two are not read, whatever their names. All repeats come from sorted texts,
    compared byte by byte, but for those of a text with its own previous period; where more than two intervals have one
    64-bit hash of their bytes, the first two are sorted for all.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    base = base.withColumn("key", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00")), "text"))
    found = repeated(base, length, least, together)
    joined = base.join(found, "key", "left").select("doc_id", "text", "runs", "passages")
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("n_shared", T.LongType()), T.StructField("removed_spans", SPANS)]
    fields += [T.StructField("kept", T.BinaryType())] if with_bytes else []
    small_batches(spark)

    def make():
        def compute(texts: pa.Array, all_runs: pa.Array, passages: pa.Array) -> list[pa.Array]:
            data, at = text_bytes(texts)
            n = len(texts)
            row, start, end = covered(all_runs, length)
            total = lambda r, x: np.bincount(r, weights=x, minlength=n).astype(np.int64)
            gone = total(row, end - start)
            change = np.zeros(len(data) + 1, np.int8)
            change[at[row] + start] += 1  # ranges of a row do not touch
            change[at[row] + end] -= 1
            rest = memoryview(data[np.cumsum(change[:-1], dtype=np.int8) == 0].tobytes())
            to = np.append(0, np.cumsum(np.diff(at) - gone))
            kept = [rest[a:b] for a, b in zip(to[:-1].tolist(), to[1:].tolist())]
            hashes = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())
            other, first, last = covered(passages, least)
            counts = [np.diff(at), gone, np.bincount(row, minlength=n)]
            out = [*[pa.array(x) for x in counts], hashes, pa.array(total(other, last - first)), as_lists(row, start, end, n, ("start", "end"))]
            return [*out, pa.array([bytes(x) for x in kept], pa.binary())] if with_bytes else out

        return compute

    return annotate(joined, ["text", "runs", "passages"], fields, make, ["doc_id"])
