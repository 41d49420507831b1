"""Near-duplicates by the Jaccard similarity of their word shingles: SimHash fingerprints joined on Golay codewords find
candidates, whole sets decide.

The fingerprint of a set has a bit for each of several hashes: whether it is set in over half of the shingles' hashes. At
similarity 0.8 about 15 % of these bits differ. TABLES pieces of a fingerprint are keys, each of a block of equal bits and of
the codewords near a 23-bit piece (see golay). In one table two sets of that similarity share a key with probability 0.32, so
in one of all with over 0.9999 (sets of 4 and 5 shingles, whose bits differ more: 0.997). Sets with a common key are held
against each other by two words of their fingerprints that the key is not cut from. What comes near goes on with all of its
fingerprint and is joined to clusters by stars, so no pairs are listed; within a cluster whole sets are held against each other
where they lie, and only links that join two groups are given out.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, comb, floor, pi, sqrt

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import golay
from .common import annotate, cut, groups_of, mix, small_batches, text_bytes, tidy
from .components import components
from .lm import word_keys, words_of
from .winnow import grams

WORDS = 5
SIMILARITY = 0.8
#: Pieces of a fingerprint that are keys, and the bits of each that have to be equal beside its codeword.
TABLES, BLOCK = 26, 4
PIECE = golay.LENGTH + BLOCK
#: Words of 64 bits of a fingerprint, and how many of them go with each key for a first estimate: the first of them, or the
#: last if the key's piece lies in the first.
LANES, CHECK = -(-TABLES * PIECE // 64), 2
WITHIN = -(-64 * CHECK // PIECE)
#: Sets of up to so many shingles are judged by limits of their own, as more of their bits differ by chance.
SMALL = 16
#: A set has up to 6 keys in a table, 5.3 on average.
BANDS = 6 * TABLES
#: Runs of sets with a common key up to this long are compared all at once, longer ones ROWS sets at a time.
PAIRED, ROWS = 256, 64
#: Comparisons made at once, whose arrays fit a CPU's cache.
AT_ONCE = 1 << 16
#: Characters of a part of a large cluster; two parts meet in a task.
PART = 1 << 21
_SALT = mix(np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Each text's set of hashed shingles, sorted. Texts of fewer words are one shingle, those of none too."""
    data, at = text_bytes(texts)
    for lo, hi in groups_of(at, 1 << 20):
        part, own = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        starts, ends, first = words_of(part, own)
        hashes = word_keys(part, starts, ends).view(np.uint64)
        runs = grams(hashes, words)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= words:
                own = np.sort(runs[a : b - words + 1])
                fresh = np.ones(len(own), bool)
                np.not_equal(own[1:], own[:-1], out=fresh[1:])
                yield own[fresh]
            else:
                yield grams(hashes[a:b], b - a)[:1] ^ np.uint64(b - a) if b > a else np.zeros(1, np.uint64)


def node_of(own: np.ndarray) -> np.int64:
    """64 bits that stand for a set."""
    return mix(mix(own).sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0]


def fingerprint(own: np.ndarray) -> np.ndarray:
    """The bits, in LANES words, that are set in over half of the hashes of a set's shingles."""
    set_in = np.zeros(64 * LANES, np.int64)
    for at in range(0, len(own), 255):  # sums of so many bits fit a byte
        hashes = mix(own[at : at + 255, None] ^ _SALT)
        set_in += np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(set_in * 2 > len(own), bitorder="little").view(np.uint64)


def join_keys(prints: np.ndarray) -> np.ndarray:
    """The keys of fingerprints (the first LANES words of rows): 6 columns for each table, -1 where there are fewer."""
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")[:, : TABLES * PIECE]
    pieces = bits.reshape(-1, PIECE).astype(np.int32) @ (1 << np.arange(PIECE, dtype=np.int32))
    codes = golay.keys(pieces & (1 << golay.LENGTH) - 1)
    table = np.tile(np.arange(TABLES), len(prints))
    head = (table << BLOCK | pieces >> golay.LENGTH) << golay.DATA
    return np.where(codes < 0, -1, head[:, None] | codes).astype(np.int32).reshape(len(prints), TABLES, 6)


def limits(least: float, bits: int = 64 * CHECK, sure: float = 4.7) -> tuple[int, int]:
    """How many of so many bits two sets of a similarity of least differ in: one standard deviation over the mean, and sure of
    them over it (4.7 leaves out one pair in 10^6, 3.2 one in 1,400)."""
    p = acos(2 * least / (1 + least)) / pi
    return floor(bits * p + sqrt(bits * p * (1 - p))), floor(bits * p + sure * sqrt(bits * p * (1 - p)))


def differing(n: int, m: int, common: int) -> float:
    """The share of bits in which sets of n and m shingles with so many in common differ."""
    over = lambda own, least: sum(comb(own, x) for x in range(max(0, least), own + 1)) / 2**own
    ends = [(over(n - common, n // 2 + 1 - k), over(m - common, m // 2 + 1 - k), comb(common, k) / 2**common) for k in range(common + 1)]
    return sum(share * (a * (1 - b) + b * (1 - a)) for a, b, share in ends)


def small_limit(least: float, bits: int = 64 * LANES, sure: float = 4.7) -> int:
    """The limit on so many bits for two sets of a similarity of least, one of them of up to SMALL shingles: over the mean as in
    limits(), for those sizes that differ most."""
    sizes = [(n, m, max(0, ceil(least * (n + m) / (1 + least) - 1e-9))) for n in range(1, SMALL + 1) for m in range(n, floor(n / least + 1e-9) + 1)]
    p = max([0.0, *(differing(n, m, common) for n, m, common in sizes if common <= n)])
    return floor(bits * p + sure * sqrt(bits * p * (1 - p)))


def distance(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.bitwise_count(one ^ other).sum(-1, dtype=np.int16)


def run_pairs(low: np.ndarray, edge: np.ndarray, far: int) -> Iterator[np.ndarray]:
    """All pairs (rows of two, i before j) within far of each other in runs that are not longer than PAIRED, whole runs at a
    time; edge: where runs begin. Runs of one length are compared together: each set with the half of its run that follows it
    in a circle, so that sets just opposite each other come twice."""
    size = np.diff(edge)
    for n in np.unique(size[(size > 1) & (size <= PAIRED)]).tolist():
        first, half = edge[:-1][size == n], n // 2
        step = max(1, AT_ONCE // (n * half))
        for at in range(0, len(first), step):
            rows = first[at : at + step, None] + np.arange(n)
            apart: np.ndarray | int = 0
            for lane in low.T:
                own = lane[rows]
                after = sliding_window_view(np.concatenate([own[:, 1:], own[:, :half]], axis=1), half, axis=1)
                apart = apart + np.bitwise_count(own[:, :, None] ^ after)
            hit = np.flatnonzero(apart <= far)
            if len(hit):
                run, i, ahead = np.unravel_index(hit, (len(rows), n, half))
                yield np.sort(np.c_[rows[run, i], rows[run, (i + ahead + 1) % n]], axis=1)


def met_in(low: np.ndarray, far: int) -> np.ndarray:
    """For each set of a long run another within far of it, -1 if there is none.

    ROWS sets that none has met yet are held against all that are left, and are done with then. Sets that have been met need
    not be, so a crowd of near copies takes few rounds, and any run at most half of all pairs, of which none are kept."""
    met, left, lanes = np.full(len(low), -1), np.arange(len(low)), np.ascontiguousarray(low.T)
    while True:
        place = np.flatnonzero(met[left] < 0)[:ROWS]
        if not len(place):
            return met
        own, step = lanes[:, place, None], AT_ONCE // ROWS
        for at in range(0, len(left), step):
            apart = sum(np.bitwise_count(x ^ lane[at : at + step]) for x, lane in zip(own, lanes))
            hit = np.flatnonzero(apart <= far)
            if len(hit):
                i, j = np.divmod(hit, apart.shape[1])
                other = place[i] != j + at
                i, j = left[place[i[other]]], left[j[other] + at]
                met[i], met[j] = j, i
        rest = np.ones(len(left), bool)
        rest[place] = False
        left, lanes = left[rest], lanes[:, rest]


def long_runs(edge: np.ndarray) -> list[tuple[int, int]]:
    long = np.diff(edge) > PAIRED
    return list(zip(edge[:-1][long].tolist(), edge[1:][long].tolist()))


def met_pairs(low: np.ndarray, edge: np.ndarray, far: int) -> np.ndarray:
    """For each set that is within far of another of its run one such pair."""
    met = np.full(len(low), -1)
    for pairs in run_pairs(low, edge, far):
        met[pairs[:, 0]], met[pairs[:, 1]] = pairs[:, 1], pairs[:, 0]
    for lo, hi in long_runs(edge):
        own = met_in(low[lo:hi], far)
        met[lo:hi] = np.where(own < 0, -1, own + lo)
    found = np.flatnonzero(met >= 0)
    return np.c_[found, met[found]]


def cross_pairs(low: np.ndarray, k: np.ndarray, edge: np.ndarray, prints: np.ndarray, root: np.ndarray, far: int, farthest: int) -> np.ndarray:
    """All pairs of all runs with different roots, within far and (whole fingerprints) farthest, that have no smaller common key,
    where they are tried."""
    out = [np.zeros((0, 2), np.int64), *(p[root[p[:, 0]] != root[p[:, 1]]] for p in run_pairs(low, edge, far))]
    for lo, hi in long_runs(edge):
        if (root[lo:hi] != root[lo]).any():
            for x in range(lo, hi - 1):
                y = x + 1 + np.flatnonzero(root[x + 1 : hi] != root[x])
                y = y[distance(low[y], low[x]) <= far]
                out.append(np.c_[np.full(len(y), x), y])
    pairs = np.concatenate(out)
    for_sure = (prints[:, LANES] <= SMALL)[pairs].any(1)
    near = [distance(prints[p[:, 0], :LANES], prints[p[:, 1], :LANES]) <= farthest for p in np.array_split(pairs, 1 + len(pairs) // (1 << 16))]
    pairs = pairs[for_sure | np.concatenate(near)]
    if not len(pairs):
        return pairs
    own, place = np.unique(pairs, return_inverse=True)
    keys, place, first = join_keys(prints[own]), place.reshape(-1, 2), np.zeros(len(pairs), bool)
    for at in range(0, len(pairs), 1 << 12):
        a, b = (keys[p] for p in place[at : at + (1 << 12)].T)
        common = np.where((a[:, :, :, None] == b[:, :, None, :]) & (a[:, :, :, None] >= 0), a[:, :, :, None], 1 << 30)
        first[at : at + (1 << 12)] = common.reshape(len(a), -1).min(1) == k[pairs[at : at + (1 << 12), 0]]
    return pairs[first]


def runs(held: list[tuple[np.ndarray, ...]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of rows sorted by their first column, and where its runs begin."""
    cols = [np.concatenate(x) for x in zip(*held)]
    return cols, np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1], True])


def by_run(batches: Iterator[pa.RecordBatch], read) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Whole runs of sorted batches at a time, as runs() gives them; read makes the columns of a batch."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if batch.num_rows:
            held.append(read(batch))
            if held[0][0][0] != held[-1][0][-1]:
                all_of = [np.concatenate(x) for x in zip(*held)]
                last = int(np.searchsorted(all_of[0], all_of[0][-1]))
                yield runs([tuple(x[:last] for x in all_of)])
                held = [tuple(x[last:].copy() for x in all_of)]
    if held:
        yield runs(held)


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("k").sortWithinPartitions("k")  # one number, so that Spark need not compare rows


def sketches_of(docs: DataFrame, text: str, words: int) -> DataFrame:
    """node and sketch (fingerprint and number of shingles) of every text: about 100 bytes each, whatever the text's length."""
    return described(docs, text, words, []).dropDuplicates(["node"])


def described(docs: DataFrame, text: str, words: int, keep: list[str]) -> DataFrame:
    """docs' kept columns, and of each text its node (the same for texts of the same shingles) and sketch."""

    def make():
        def describe(texts: pa.Array) -> list[pa.Array]:
            own, sketches = [], []
            for s in shingles(texts, words):
                own.append(node_of(s))
                sketches.append(fingerprint(s).tobytes() + np.uint64(len(s)).tobytes())
            return [pa.array(np.array(own, np.int64)), pa.array(sketches, pa.binary())]

        return describe

    return annotate(docs, [text], [T.StructField("node", T.LongType()), T.StructField("sketch", T.BinaryType())], make, keep)


def marked(doc_id: str, text: str) -> list[Column]:
    """Two numbers that stand for a row's id and text, as columns i and h: what is known of a row is joined to it by these, so
    that its shingles are made once."""
    return [F.xxhash64(F.col(f"`{doc_id}`")).alias("i"), F.xxhash64(F.col(f"`{text}`")).alias("h")]


def shared_bands(sketches: DataFrame, whole: bool = True, least: float = 0) -> DataFrame:
    """A row for every key (k) of every node: with CHECK words of the fingerprint (low) that the key's piece is not cut from, so
    that sets which share no more than the key are no nearer in them than any two, and the whole sketch if asked for.

    A column root of sketches goes along. Sets that are too small to have a similarity of least to any other have no rows.
    """
    fewest = least / (1 - least) - 1e-9 if least < 1 else float("inf")  # one shingle more has to leave that similarity
    more = [c for c in ("root",) if c in sketches.columns]
    names = ["k", "node", *(f"low{i}" for i in range(CHECK)), *more, *(["sketch"] if whole else [])]
    kinds = {"k": "int", "sketch": "binary"}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                prints = text_bytes(batch.column(1))[0].view(np.uint64).reshape(-1, LANES + 1)
                keys = join_keys(prints).reshape(len(prints), -1)
                row, column = np.nonzero((keys >= 0) & (prints[:, LANES:] >= fewest))
                start = np.where(column < 6 * WITHIN, LANES - CHECK, 0)
                lows = [prints[row, start + i].view(np.int64) for i in range(CHECK)]
                more_of = [batch.column(2 + i).to_numpy()[row] for i in range(len(more))]
                arrays = [pa.array(x) for x in (keys[row, column], batch.column(0).to_numpy()[row], *lows, *more_of)]
                yield pa.RecordBatch.from_arrays([*arrays, *([batch.column(1).take(pa.array(row))] if whole else [])], names=names)

    small_batches(sketches.sparkSession, 1024)
    return sketches.select("node", "sketch", *more).mapInArrow(tidy(spread), ", ".join(f"{c} {kinds.get(c, 'long')}" for c in names))


def candidates(shared: DataFrame, least: float, roots: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of nodes with a common key: for each that may be linked to another one such pair. With roots, or a column
    root, all pairs of different roots that may have a similarity of least or more."""
    far = limits(least)[1]
    farthest = limits(least, 64 * LANES, 3.2)[1]
    if roots is not None:
        of = roots.select(F.col("node").alias("of"), "root")
        shared = shared.join(of, shared["node"] == of["of"], "left").select(*shared.columns, F.coalesce("root", "node").alias("root"))
    across = "root" in shared.columns
    lows = [f"low{i}" for i in range(CHECK)]

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        number = lambda c: batch.column(c).to_numpy()
        low = np.stack([number(c) for c in lows], 1).view(np.uint64)
        more = (number("root"), text_bytes(batch.column("sketch"))[0].view(np.uint64).reshape(-1, LANES + 1)) if across else ()
        return number("k"), number("node"), low, *more

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (k, f, low, *more), edge in by_run(batches, read):
            found = cross_pairs(low, k, edge, more[1], more[0], far, farthest) if across else met_pairs(low, edge, far)
            if len(found):
                ends = np.unique(np.sort(f[found], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], names=["a", "b"])

    rows = _sorted(shared.select("k", "node", *lows, *(["root", "sketch"] if across else [])))
    small_batches(shared.sparkSession, 1 << 15)
    return rows.mapInArrow(tidy(pair), "a long, b long").distinct()


def joined(n: int, pairs: np.ndarray) -> np.ndarray:
    """The smallest of n numbers that each is joined to by pairs."""
    root = np.arange(n)
    while len(pairs):
        ends = root[pairs]
        np.minimum.at(root, ends.ravel(), np.repeat(ends.min(1), 2))  # a whole group goes with its smallest
        while (root != root[root]).any():
            root = root[root]
        pairs = pairs[root[pairs[:, 0]] != root[pairs[:, 1]]]
    return root


def stars_of(pairs: np.ndarray) -> np.ndarray:
    """Pairs of the first and all others of each group that pairs join."""
    own, place = np.unique(pairs, return_inverse=True)
    root = joined(len(own), place.reshape(-1, 2))
    others = np.flatnonzero(root != np.arange(len(own)))
    return np.c_[own[root[others]], own[others]]


def may_link(one: np.ndarray, other: np.ndarray, least: float, farthest: tuple[int, int]) -> np.ndarray:
    """Whether sets of these sketches may have a similarity of least or more: their sizes let them, and their whole fingerprints
    are within farthest (the second if one of them is small)."""
    smaller, larger = np.minimum(one[..., LANES], other[..., LANES]), np.maximum(one[..., LANES], other[..., LANES])
    return (smaller >= least * larger - 1e-9) & (distance(one[..., :LANES], other[..., :LANES]) <= np.where(smaller <= SMALL, farthest[1], farthest[0]))


def near_stars(low: np.ndarray, edge: np.ndarray, prints: np.ndarray, far: int, least: float, farthest: tuple[int, int]) -> np.ndarray:
    """Pairs of the first and all others of each run's sets that a chain of sets joins which are within far and may_link()."""
    out = [np.zeros((0, 2), np.int64)]
    for pairs in run_pairs(low, edge, far):
        out.append(stars_of(pairs[may_link(prints[pairs[:, 0]], prints[pairs[:, 1]], least, farthest)]))
    for lo, hi in long_runs(edge):
        left = lo + np.flatnonzero(met_in(low[lo:hi], far) >= 0)
        while len(left):
            first, left = left[0], left[1:]
            queue = [first]
            while queue and len(left):
                x = queue.pop()
                place = np.flatnonzero(distance(low[left], low[x]) <= far)
                place = place[may_link(prints[left[place]], prints[x], least, farthest)]
                out.append(np.c_[np.full(len(place), first), left[place]])
                queue.extend(left[place].tolist())
                left = np.delete(left, place)
    return np.concatenate(out)


def clusters(shared: DataFrame, least: float) -> DataFrame:
    """Stars (a, b) of nodes that have a common key and may have a similarity of least or more, or that a chain of such joins:
    of each key fewer than it has nodes."""
    far, farthest = limits(least)[1], (limits(least, 64 * LANES, 3.2)[1], small_limit(least))
    lows = [f"low{i}" for i in range(CHECK)]

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        low = np.stack([batch.column(c).to_numpy() for c in lows], 1).view(np.uint64)
        return batch.column("k").to_numpy(), batch.column("node").to_numpy(), low, text_bytes(batch.column("sketch"))[0].view(np.uint64).reshape(-1, LANES + 1)

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, f, low, prints), edge in by_run(batches, read):
            found = stars_of(f[near_stars(low, edge, prints, far, least, farthest)])  # of all these runs together
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["a", "b"])

    rows = _sorted(shared.select("k", "node", *lows, "sketch"))
    small_batches(shared.sparkSession, 1 << 15)
    return rows.mapInArrow(tidy(star), "a long, b long").distinct()


def exact_links(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Pairs of sets of a Jaccard similarity of least or more that hold all together which such pairs join: fewer than sets."""
    size = np.array([len(s) for s in sets])
    member = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.split(member, np.cumsum(size)[:-1])
    mark = np.zeros(member.max() + 1, np.int32)
    left, out = np.arange(len(sets)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        member = member[len(own[queue[0]]) :]  # those of left
        while queue and len(left):
            x = queue.pop()
            mark[own[x]] = 1
            common = np.add.reduceat(mark[member], np.r_[0, np.cumsum(size[left])[:-1]])
            mark[own[x]] = 0
            good = common >= least * (size[x] + size[left] - common) - 1e-9
            if good.any():
                out.append(np.c_[np.full(good.sum(), x), left[good]])
                queue.extend(left[good].tolist())
                member, left = member[np.repeat(~good, size[left])], left[~good]
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def links(of: DataFrame, sets: DataFrame, docs: DataFrame, doc_id: str, text: str, words: int, least: float) -> DataFrame:
    """Pairs (a, b) of exact similarity that hold the groups of each cluster together. of: node and root of every node of a
    cluster; sets: node and marks of a row of docs for each node, whose text is read.

    A cluster of up to 2 * PART characters is read by one task. Larger ones are dealt by their nodes' hashes into parts of
    about PART, and every two parts meet in one task, so that memory is bounded and any number of tasks can share a cluster.
    """
    one = sets.select("node", "x.h", "x.i").join(of, "node")
    source = docs.select(F.col(f"`{text}`").alias("text"), *marked(doc_id, text))
    texts = cut(source.join(one, ["h", "i"]).dropDuplicates(["h", "i"]).select("root", "node", "text"))
    large = texts.groupBy("root").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n")).where(F.col("n") > 2 * PART)
    large = large.select("root", F.ceil(F.col("n") / PART).cast("int").alias("parts"))  # one row for each 2 * PART characters at most
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: j != mine)
    met = F.transform(others, lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j")))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    rows = texts.join(F.broadcast(large), "root", "left").select("root", "node", "text", F.explode(F.when(F.col("parts").isNull(), alone).otherwise(met)).alias("at"))
    rows = rows.select("root", "at.i", "at.j", "node", "text").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, sets = None, [], []

        def found() -> pa.RecordBatch:
            ends = np.sort(np.array(own, np.int64)[exact_links(sets, least)], 1)
            own.clear()
            sets.clear()
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], names=["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in range(3)))
            for at, node, s in zip(keys, batch.column(3).to_pylist(), shingles(batch.column(4), words)):
                if at != key and own:
                    yield found()
                key = at
                own.append(node)
                sets.append(s)
        if own:
            yield found()

    small_batches(docs.sparkSession)
    return rows.mapInArrow(tidy(link), "a long, b long")


def groups(sets: DataFrame, docs: DataFrame, doc_id: str, text: str, words: int, least: float) -> DataFrame:
    """node and root of every node that is linked to a smaller one. sets: node, sketch and a row's marks of every node of docs.

    Nodes that may be near another by a part of their fingerprints go on with all of it. Those that may be linked make
    clusters, held together by stars, and each cluster's sets are compared exactly, but for those that links join already.
    So no link within a cluster is lost, and whatever a group's size, rows grow as its nodes.
    """
    sketches = sets.select("node", "sketch")
    first = candidates(shared_bands(sketches, whole=False, least=least), least)
    near = cut(first.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    stars = components(clusters(shared_bands(sketches.join(near, "node"), least=least), least))
    of = cut(stars.union(stars.select(F.col("root").alias("node"), "root").distinct()))
    return components(links(of, sets, docs, doc_id, text, words, least))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near-duplicates, that of the smallest doc_id.

    Two rows are linked if the Jaccard similarity of their sets of shingles is least or more; groups are what links lead
    to. Only A-Z are lower-cased, white space parts words. Texts without words (null, empty) are alike. A null doc_id
    stays only where its group has no other; any number of groups may have no doc_id or the same one, and each keeps a
    row. Rows that repeat count as copies, and so do ties; an empty table stays empty. Whole texts count, however long.
    Columns of docs keep their names, whatever they are.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), *marked(doc_id, text), F.col(f"`{text}`").alias("text"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "node", "h", "i")
    sets = described(rows, "text", words, ["id", "i", "h"]).groupBy("node").agg(F.min(order).alias("x"), F.first("sketch").alias("sketch"))
    sets = cut(sets)  # copies are summed up where they are read, and their first row stands for all
    of = sets.join(groups(sets, docs, doc_id, text, words, least), "node", "left").select(F.coalesce("root", "node").alias("root"), "x")
    kept = cut(of.groupBy("root").agg(F.min("x").alias("x")).select("x.h", "x.i"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *marked(doc_id, text))
    return rows.join(kept, ["h", "i"], "left_semi").dropDuplicates(["h", "i"]).select("row.*")
