"""Near-duplicates by SimHash fingerprints that are joined on Golay codewords.

If two 64-bit fingerprints differ in at most 4 bits, at least one of 5 blocks is equal, and of the other bits one of two
23-bit halves differs in at most 2. So the two share a key of equal block and codeword near a half (see golay). There are
10 such kinds of key of 25 bits, and at most 6 keys of a kind. Pairs with a common key are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import golay
from .common import annotate, cut, small_batches
from .components import components

WORDS = 4
BITS = 4
SEED = 42
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Runs of fingerprints with a common key up to this long are compared pair by pair, longer ones by absorption.
PAIRED = 12
#: Longer runs than this are cut: where two fingerprints within the limit differ in few bits, one of SHARES shares of the bits
#: that vary in the run is equal, so shorter runs of equal shares hold the same links.
LONG = 8192
SHARES = BITS + 1


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The bits that are set in over half of the shingles' hashes. Only A-Z are lower-cased; no words give 0."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    if len(parts) < words:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED)
    runs = map(b" ".join, zip(*[parts[i:] for i in range(words)]))
    n = len(parts) - words + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, n)
    set_in = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        part = hashes[at : at + (1 << 14)]
        set_in += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(set_in * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, words: int = WORDS) -> DataFrame:
    """docs with the column fp, the fingerprint of the whole text as a signed number."""

    def make():
        one = partial(fingerprint, words=words)
        return lambda texts: [pa.array(np.array([one(t.as_py()) for t in texts], np.uint64).view(np.int64))]

    return annotate(docs, [text], [T.StructField("fp", T.LongType())], make, keep)


def join_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All join keys of distinct fingerprints: the keys, and the fingerprint of each."""
    fps = fps.view(np.uint64)
    out_keys, out_fps = [], []
    for kind, (at, size) in enumerate(BLOCKS):
        exact = (fps >> np.uint64(at)) & np.uint64((1 << size) - 1)
        rest = (fps & np.uint64((1 << at) - 1)) | ((fps >> np.uint64(at + size)) << np.uint64(at))
        for half in range(2):
            codes = golay.keys((rest >> np.uint64(half * golay.LENGTH)) & np.uint64((1 << golay.LENGTH) - 1))
            row, column = np.nonzero(codes >= 0)
            out_keys.append(((kind * 2 + half) << 25) | (exact[row].astype(np.int64) << 12) | codes[row, column])
            out_fps.append(fps[row])
    return np.concatenate(out_keys), np.concatenate(out_fps).view(np.int64)


def absorb(run: np.ndarray, bits: int) -> list[np.ndarray]:
    """Links (rows of two) that connect a run as all its links would. Each fingerprint is held against those not yet reached."""
    out, left = [], run
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= bits
            if near.any():
                reached, left = left[near], left[~near]
                out.append(np.stack([np.full(len(reached), x), reached], 1))
                queue.extend(reached)
    return out


def shares(run: np.ndarray) -> list[np.ndarray]:
    """Masks of SHARES shares of the bits that vary in a run, about equal in how evenly they part it."""
    varies = np.bitwise_or.reduce(run ^ run[0])
    places = [p for p in range(64) if int(varies) >> p & 1]
    ones = [int(np.count_nonzero(run >> np.uint64(p) & np.uint64(1))) for p in places]
    order = [p for _, p in sorted(zip((abs(2 * n - len(run)) for n in ones), places))]
    return [np.bitwise_or.reduce(np.array([np.uint64(1) << np.uint64(p) for p in order[k::SHARES]], np.uint64)) for k in range(min(SHARES, len(order)))]


def cut_run(run: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Shorter runs of a long one that hold all its links: those of equal bits in one of its shares.

    Runs of up to LONG are left to absorb(). A run in which no more bits vary than may differ is a chain of links as it is.
    """
    waiting = [run]
    while waiting:
        own = waiting.pop()
        if len(own) <= LONG:
            yield own
            continue
        masks = shares(own)
        for mask in masks:
            part = own & mask
            order = np.argsort(part, kind="stable")
            edge = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1], True])
            waiting += [own[order[a:b]] for a, b in zip(edge[:-1], edge[1:]) if b - a > 1]


def links_of_runs(keys: np.ndarray, fps: np.ndarray, bits: int) -> np.ndarray:
    """Links (pairs of fingerprints) within the runs of equal keys."""
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[edge, len(keys)])
    found = []
    fps = fps.view(np.uint64)
    small = np.repeat(size <= PAIRED, size)
    for shift in range(1, min(PAIRED, int(size.max(initial=1)))):
        i = np.flatnonzero(small[shift:] & (keys[shift:] == keys[:-shift]))
        if not len(i):
            break
        i = i[np.bitwise_count(fps[i] ^ fps[i + shift]) <= bits]
        found.append(np.stack([fps[i], fps[i + shift]], 1))
    for start, n in zip(edge[size > PAIRED], size[size > PAIRED]):
        for part in cut_run(fps[start : start + n], bits):
            found += absorb(part, bits)
    return np.concatenate(found).view(np.int64) if found else np.zeros((0, 2), np.int64)


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints (fp) that connect all that differ in at most bits bits.

    Keys are dealt out and sorted; a task streams through them and holds one run of 8-byte fingerprints at most. Copies
    have one fingerprint, and a run of near copies gives a tree of links, not all its pairs.
    """
    if not 0 <= bits <= BITS:
        raise ValueError(f"the keys find up to {BITS} differing bits")
    small_batches(distinct.sparkSession, 10_000)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                k, f = join_keys(batch.column(0).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(f)], names=["k", "fp"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def made(k, f):
            got = links_of_runs(k, f, bits)
            return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
            if held[0][0][0] != held[-1][0][-1]:
                k, f = (np.concatenate(x) for x in zip(*held))
                last = int(np.searchsorted(k, k[-1]))
                yield made(k[:last], f[:last])
                held = [(k[last:], f[last:])]
        if held:
            yield made(*(np.concatenate(x) for x in zip(*held)))

    keyed = distinct.select("fp").mapInArrow(emit, "k int, fp long").repartition("k").sortWithinPartitions("k", "fp")
    return keyed.mapInArrow(pair, "a long, b long").distinct()


def labelled(docs: DataFrame, doc_id: str, text: str, words: int, bits: int) -> DataFrame:
    """doc_id, fp, component_id and root (which names the component) of each row of docs."""
    known = cut(fingerprints(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), keep=["doc_id"], words=words))
    smallest = known.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(smallest.select("fp"), bits))
    of = smallest.join(roots, smallest.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of = cut(of)
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = of.join(least, "root").select("fp", "component_id", "root")
    return known.join(labels, "fp", "left").select("doc_id", "fp", "component_id", "root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """One row for each row of docs: doc_id, fp and component_id, the smallest doc_id that links lead to.

    Two documents are linked if their fingerprints differ in at most bits bits. Texts without words (null, empty) have
    fingerprint 0 and link like any other. Copies, rows that repeat and ties share a fingerprint and so a component. A
    null doc_id counts only where its component has no other. Whole texts count, however long. An empty table gives no
    rows. Other columns are not read, whatever their names.
    """
    return labelled(docs, doc_id, text, words, bits).drop("root")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """docs with one row of each component: of the smallest doc_id, and of its rows one of the smallest fingerprint.

    A null doc_id stays only where its component has no other, but then in each such component. Of components with the
    same smallest doc_id that of the smallest fingerprint keeps its row; neardup.keep_one keeps a row of each.
    """
    found = labelled(docs, doc_id, text, words, bits)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("fp").alias("fp"))
    kept = found.groupBy("root").agg(F.min(order).alias("x")).select(F.col("x.id").alias("kept_id"), F.col("x.fp").alias("kept_fp"))
    kept = cut(kept.groupBy("kept_id", F.when(F.col("kept_id").isNull(), F.col("kept_fp")).alias("each")).agg(F.min("kept_fp").alias("kept_fp")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("content"))
    rows = fingerprints(rows, "content", ["row", "id"], words)
    left = rows.join(kept, (rows["fp"] == kept["kept_fp"]) & rows["id"].eqNullSafe(kept["kept_id"]), "left_semi")
    return left.dropDuplicates(["id", "fp"]).select("row.*")
