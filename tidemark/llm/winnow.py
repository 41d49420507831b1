"""Benchmark decontamination by winnowing.

The smallest hash of the k-grams in every window is kept of training and benchmark texts alike; equal hashes are joined
and each match is extended to the spans around it, by whole spans: those of all items are kept once each, with the items
that hold them, so that a header which many items share is extended once and not for every item. Of every shared span of at
least k + window - 1 words at least one hash is kept on both sides, so none is missed.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words, annotate, bool_lut, find_keys, groups_of, mix, span_hashes, text_bytes

SPAN = 10  # words in a window of the contract
K = 5  # words in a k-gram
WINDOW = SPAN - K + 1  # k-grams in a window
#: Benchmark text that is held in memory, and broadcast, at a time.
BLOCK_BYTES = 16 << 20
CHUNK = 1 << 20


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words, across rows too."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    return mix(out)


def window_minima(kgrams: np.ndarray, window: int) -> np.ndarray:
    n = len(kgrams) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = kgrams[:n].copy()
    for j in range(1, window):
        np.minimum(out, kgrams[j : j + n], out=out)
    return out


def starts_within(first: np.ndarray, size: int, total: int) -> np.ndarray:
    """Whether a run of size words that starts at each word ends in the same row."""
    ok = np.zeros(max(0, total - size + 1), bool)
    edge = np.zeros(len(ok) + 1, np.int32)
    lo, hi = first[:-1], first[1:] - size + 1
    good = hi > lo
    np.add.at(edge, lo[good], 1)
    np.add.at(edge, hi[good], -1)
    return np.cumsum(edge[:-1]) > 0 if len(ok) else ok


class Index:
    """Benchmark items: kept k-gram hashes and spans of the long ones, and whole hashes of the short ones."""

    def __init__(self, rows: list[tuple[str, str]]):
        classes: dict[bytes, int] = {}
        self.items: list[list[str]] = []
        self.bytes: list[list[bytes]] = []
        words: list[np.ndarray] = []
        for item, text in rows:
            raw = (text or "").encode()
            data = np.frombuffer(raw, np.uint8)
            h, s, e, _ = alnum_words(data, np.array([0, len(data)]))
            if not len(h):
                continue
            own = [raw[a:b].lower() for a, b in zip(s, e)]
            key = b" ".join(own)
            if key not in classes:
                classes[key] = len(self.items)
                self.items.append([])
                words.append(h)
                self.bytes.append(own)
            self.items[classes[key]].append(item)
        kept, spans, holders, places = [], [], [], []
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, h in enumerate(words):
            if len(h) < SPAN:
                self.short[len(h)][int(grams(h, len(h))[0])].append(i)
                continue
            kept.append(np.unique(window_minima(grams(h, K), WINDOW)))
            own = grams(h, SPAN)
            spans.append(own)
            holders.append(np.full(len(own), i, np.int32))
            places.append(np.arange(len(own), dtype=np.int32))
        self.short = {m: dict(x) for m, x in self.short.items()}
        self.keys = np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.uint64)
        self.lut = bool_lut(self.keys)
        # Spans by hash: where each begins among (item, place), of which the first is the one that bytes are held against.
        every = np.concatenate(spans) if spans else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.spans, self.first = np.unique(every[order], return_index=True)
        self.first = np.append(self.first, len(every))
        self.holders = np.concatenate(holders)[order] if spans else np.zeros(0, np.int32)
        self.places = np.concatenate(places)[order] if spans else np.zeros(0, np.int32)
        self.span_lut = bool_lut(self.spans)
        self.short_keys = {m: np.sort(np.array(list(x), np.uint64)) for m, x in self.short.items()}
        self.short_lut = {m: bool_lut(k) for m, k in self.short_keys.items()}

    def match(self, data: np.ndarray, at: np.ndarray) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each row its number of words, the hit runs of words, and the items of which windows occur."""
        words, starts, ends, first = alnum_words(data, at)
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        held: dict[int, set[int]] = defaultdict(set)  # of each row: numbers of spans, and of short items below zero
        same = lambda i, q, p, n: all(data[starts[p + j] : ends[p + j]].tobytes().lower() == self.bytes[i][q + j] for j in range(n))
        if len(self.keys):
            low = window_minima(grams(words, K), WINDOW)
            tried = np.flatnonzero(starts_within(first, SPAN, len(words)))
            hit, _ = find_keys(self.keys, self.lut, low[tried])
            tried = tried[hit]
            hit, number = find_keys(self.spans, self.span_lut, grams(words, SPAN)[tried])
            tried = tried[hit]
            rows = np.searchsorted(first, tried, side="right") - 1
            for w, k, row in zip(tried.tolist(), number.tolist(), rows.tolist()):
                f = self.first[k]
                if same(self.holders[f], self.places[f], w, SPAN):
                    found[row].append((w - int(first[row]), w + SPAN - int(first[row])))
                    held[row].add(k)
        for m, table in self.short.items():
            ok = starts_within(first, m, len(words))
            tried = np.flatnonzero(ok)
            runs = grams(words, m)[tried]
            hit, _ = find_keys(self.short_keys[m], self.short_lut[m], runs)
            for w in tried[hit]:
                row = int(np.searchsorted(first, w, side="right")) - 1
                for i in table[int(grams(words[w : w + m], m)[0])]:
                    if same(i, 0, int(w), m):
                        found[row].append((int(w - first[row]), int(w + m - first[row])))
                        held[row].add(-1 - i)
        out = []
        for row in range(len(at) - 1):
            own = held.get(row, ())
            parts = [self.holders[self.first[k] : self.first[k + 1]] for k in own if k >= 0]
            holders = np.unique(np.concatenate([*parts, np.array([-1 - k for k in own if k < 0], np.int32)])) if own else ()
            out.append((int(first[row + 1] - first[row]), merged(found.get(row, [])), sorted({x for i in holders for x in self.items[i]})))
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_BUILT: list = [None, None]


def built(rows: list[tuple[str, str]]) -> Index:
    """The index of these rows, made once in each worker: a worker reads a broadcast value once and keeps it."""
    if _BUILT[0] is not rows:
        _BUILT[:] = [rows, Index(rows)]
    return _BUILT[1]


SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))


def find_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, hit_spans (runs of words) and hit_items (sorted as strings) of every whole text.

    A window is SPAN consecutive words of an item; an item of fewer words is one window; an item or text without words
    has none. Null texts have no words, a null item_id counts as the empty string, and ids that repeat count once.
    Rows of docs are taken one by one, repeated rows and ties too; texts are taken whole, however long; empty tables give
    no rows or no hits. Result columns replace columns of docs that have their names; others keep theirs.

    The benchmark's size is measured first. It is held in memory and broadcast in blocks of block_bytes, and every
    document is held against every block: documents are never shuffled, and what is broadcast does not grow.
    """
    spark = docs.sparkSession
    known = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    size = known.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit_spans", SPANS), T.StructField("hit_items", T.ArrayType(T.StringType()))]
    out = docs
    for b in range(blocks):
        rows = [(r.i, r.t) for r in known.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).toLocalIterator()]
        shared = spark.sparkContext.broadcast(rows)
        before = ["hit_spans", "hit_items"] if b else []

        def make(shared=shared):
            index = built(shared.value)

            def compute(texts: pa.Array, *old: pa.Array) -> list[pa.Array]:
                data, at = text_bytes(texts)
                got = []
                for lo, hi in groups_of(at, CHUNK):
                    got += index.match(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                if old:
                    got = [
                        (n, merged([*s, *((x["first"], x["end"]) for x in a.as_py())]), sorted({*i, *c.as_py()}))
                        for (n, s, i), a, c in zip(got, *old)
                    ]
                kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
                return [
                    pa.array([n for n, _, _ in got], pa.int64()),
                    pa.array([sum(e - f for f, e in s) for _, s, _ in got], pa.int64()),
                    pa.array([[{"first": f, "end": e} for f, e in s] for _, s, _ in got], kind),
                    pa.array([i for _, _, i in got], pa.list_(pa.string())),
                ]

            return compute

        columns = keep if keep is not None else docs.columns
        columns = [c for c in dict.fromkeys([*columns, *([text] if b < blocks - 1 else [])]) if c not in {f.name for f in fields} or c == text]
        out = annotate(out, [text, *before], fields, make, columns)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **names: str) -> DataFrame:
    """The documents in which no window of a benchmark item occurs, with their own columns; see find_spans."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("content"))
    return find_spans(rows, benchmark, text="content", keep=["row"], **names).where("n_hit = 0").select("row.*")
