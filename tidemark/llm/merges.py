"""Token counts by merging byte pairs: symbols in a linked list, pairs that can merge in a heap by rank and place.

Each step merges the leftmost pair of the lowest rank, drops one symbol and offers the two new pairs. What is left is the
number of symbols less the number of merges; no identifiers are written.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import bpe
from .common import annotate

LIMIT = 2048


class MergeCounter(dict):
    """Numbers of tokens by piece of a text. Pieces are kept until they take bpe.WORDS_BYTES; long ones for one text only."""

    def __init__(self, coder: bpe.WordBpe):
        self.coder, self.bytes = coder, 0
        self.ranked = {pair: (coder.order[whole], whole) for pair, whole in coder.joined.items()}

    def count(self, piece: str) -> int:
        """Tokens of one pre-token."""
        coder, ranked = self.coder, self.ranked
        table, ids = coder.table, coder.ids
        symbols = [table[b] for b in piece.encode()]
        symbols[-1] += bpe.END
        at = [ids[s] for s in symbols]
        n = len(at)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(*found, i, at[i], at[i + 1]) for i in range(n - 1) if (found := ranked.get((at[i], at[i + 1])))]
        heapify(heap)
        merges = 0
        while heap:
            _, whole, i, left, right = heappop(heap)
            j = after[i]
            if at[i] != left or j >= n or at[j] != right:
                continue  # one of the two has merged since
            merges += 1
            at[i], at[j] = whole, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := ranked.get((whole, at[k])):
                    heappush(heap, (*found, i, whole, at[k]))
            h = before[i]
            if h >= 0 and (found := ranked.get((at[h], whole))):
                heappush(heap, (*found, h, at[h], whole))
        return n - merges

    def __missing__(self, piece: str) -> int:
        n = 1 if piece in self.coder.added else self.count(piece)
        if len(piece) < bpe.LONG_WORD:
            self[piece] = n
            self.bytes += len(piece) + bpe.ENTRY_BYTES
        return n

    def tokens(self, text: str) -> int:
        if self.bytes > bpe.WORDS_BYTES:
            self.clear()
            self.bytes = 0
        return sum(map(self.__getitem__, self.coder.pieces(text)))


def count_tokens(docs: DataFrame, vocabulary: str | None = None, text: str = "text", limit: int = LIMIT, keep: list[str] | None = None) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (more tokens than the limit) of every whole text.

    A null or empty text has none of both. Strings of special tokens inside a text count as one token each, as the
    library takes them. Rows are taken one by one, so repeated rows, ties and an empty table need no care; a very long word
    takes n log n steps. A column of docs with the name of a result gives way to it, other columns keep theirs. The
    vocabulary file is read on the driver and broadcast (under 2 MB).
    """
    spark: SparkSession = docs.sparkSession
    with open(vocabulary or bpe.default_vocabulary(), encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]

    def make():
        counter = MergeCounter(bpe.loaded(shared.value))

        def compute(texts: pa.Array) -> list[pa.Array]:
            n = [counter.tokens(value.as_py() or "") for value in texts]
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            return [size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]

        return compute

    return annotate(docs, [text], fields, make, keep)
