"""Spelling variants: words one edit apart, found by range reporting in two orders.

A word with an edit at place i shares the i characters before it and all characters after it with its variant. Words of
one length are sorted forwards and backwards; the words with a given beginning are an interval of the first order, those
with a given ending one of the second. A wavelet tree over the permutation between both orders reports the words that lie
in both intervals. Replacements are looked up among words of the same length, insertions among those of one more; a
deletion is an insertion the other way round.

Words are dealt so that variants meet: the edit is in the first or the second half of the longer word, so either the other
half agrees. Halves that many words share are halved again, down to one place, where at most one character differs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, tidy
from .sqltext import crc32_sql, utf8_codes

#: Shortest word, least occurrences, and how many times as often a form stands as its variant.
SHORTEST, LEAST, FACTOR = 5, 3, 2
#: One run in so many loses a character.
NOISE = 97
#: A worker hands on its counts beyond so many different words or bytes.
WORDS_KEPT, BYTES_KEPT = 300_000, 32 << 20
#: Words (and bytes) of one shared half beyond which it is halved again, and those that a task takes on average.
GROUP, GROUP_BYTES = 50_000, 16 << 20
TASK, TASK_BYTES = 150_000, 16 << 20
#: Hot halves are broadcast up to so many (about 40 bytes each).
HOT_BROADCAST = 200_000
#: (word, place) pairs that are looked up together, and the text that is searched for runs at once.
TOGETHER, PIECE = 1 << 17, 1 << 20

_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
_RUN = re.compile(f"[a-zÀ-ÿ]{{{SHORTEST},}}")
_OTHER = re.compile("[^a-zÀ-ÿ]")


def runs_of(text: str) -> Iterator[list[str]]:
    """Lower-cased runs of letters of at least SHORTEST characters, a piece of the text at a time."""
    low = text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
    at = 0
    while at < len(low):
        border = _OTHER.search(low, at + PIECE) if at + PIECE < len(low) else None
        end = border.start() if border else len(low)
        yield _RUN.findall(low, at, end)
        at = end


def noisy(run: str, seed: int) -> str:
    """The run, less a character if NOISE divides its checksum with the document's."""
    h = zlib.crc32(run.encode(), seed)
    if h % NOISE:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n of all documents: occurrences of every word of at least SHORTEST characters."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for runs in runs_of(value.as_py() or ""):
                    for word, n in Counter(runs).items():
                        word = noisy(word, seed)
                        if len(word) >= SHORTEST:
                            size += len(word)
                            counts[word] += n
                    if len(counts) > WORDS_KEPT or size > BYTES_KEPT:
                        yield out()
                        counts.clear()
                        size = 0
        if counts:
            yield out()

    rows = docs.select(F.col(f"`{key}`").cast("string").alias("doc"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class WaveletTree:
    """A permutation, level by level of its values' bits, from the highest."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length()) if len(values) else 1
        self.zeros: list[np.ndarray] = []
        for level in range(self.bits - 1, -1, -1):
            one = (values >> level) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - one)]))
            values = np.concatenate([values[one == 0], values[one == 1]])

    def report(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) for every value in [c, d) at a place in [a, b) of each query."""
        query = np.flatnonzero((a < b) & (c < d))
        a, b, low = a[query], b[query], np.zeros(len(query), np.int64)
        for k, zeros in enumerate(self.zeros):
            width = 1 << (self.bits - 1 - k)
            left, right = zeros[a], zeros[b]
            keep0 = (left < right) & (low < d[query]) & (low + width > c[query])
            base = zeros[-1]
            up = low + width
            keep1 = (b - right > a - left) & (up < d[query]) & (up + width > c[query])
            a = np.concatenate([left[keep0], base + (a - left)[keep1]])
            b = np.concatenate([right[keep0], base + (b - right)[keep1]])
            low = np.concatenate([low[keep0], up[keep1]])
            query = np.concatenate([query[keep0], query[keep1]])
        return query, low


class Order:
    """Rows of characters in sorted order, with the common beginnings of neighbours."""

    def __init__(self, rows: np.ndarray):
        n, width = rows.shape
        rows = np.ascontiguousarray(rows)
        self.order = np.argsort(rows.view(f"S{width}").ravel(), kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        self.common = np.full(n + 1, -1, np.int64)  # with the row before
        step = max(1, (8 << 20) // width)
        for lo in range(1, n, step):
            hi = min(n, lo + step)
            differ = rows[self.order[lo:hi]] != rows[self.order[lo - 1 : hi - 1]]
            self.common[lo:hi] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        self.least = [self.common]  # minima of 2^k neighbours from each on
        while (half := 1 << (len(self.least) - 1)) * 2 <= n + 1:
            last = self.least[-1]
            self.least.append(np.minimum(last[:-half], last[half:]))

    def reach(self) -> np.ndarray:
        """The longest beginning that each row shares with another."""
        return np.maximum(self.common[:-1], self.common[1:])[self.place]

    def interval(self, row: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows that share so many characters with a row."""
        lo = self.place[row].copy()
        hi = lo + 1
        for k in range(len(self.least) - 1, -1, -1):
            least, size = self.least[k], 1 << k
            start = lo - size + 1
            good = start >= 0
            good[good] = least[start[good]] >= length[good]
            lo[good] -= size
            good = hi < len(least)
            good[good] = least[hi[good]] >= length[good]
            hi[good] += size
        return lo, hi


def pairs_of_length(index: np.ndarray, short: np.ndarray, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words of index that differ from others by one edit at a place in [lo, hi) of the entries.

    index holds words of one length as rows of characters, short words of one less. rows are the entries' numbers in both,
    one after the other. Yields entries, numbers in index and whether it is an insertion. Each pair comes once: of the places
    that an inserted character can have, the first counts.
    """
    n, length = index.shape
    every = np.zeros((n + len(short), length), np.uint8)
    every[:n] = index
    every[n:, : length - 1] = short
    ahead = Order(every)
    every[:n] = index[:, ::-1]
    every[n:, : length - 1] = short[:, ::-1]
    back = Order(every)
    before_ahead = np.concatenate([[0], np.cumsum(ahead.order < n)])  # index words among the first so many
    before_back = np.concatenate([[0], np.cumsum(back.order < n)])
    by_back = back.order[back.order < n]
    tree = WaveletTree(before_back[back.place[ahead.order[ahead.order < n]]])
    first = np.maximum(lo, length - 1 - back.reach()[rows])
    last = np.minimum(hi - 1, ahead.reach()[rows])
    some = np.flatnonzero(first <= last)
    for entry, place in places(some, first[some], last[some]):
        row = rows[entry]
        a, b = ahead.interval(row, place)
        c, d = back.interval(row, length - 1 - place)
        query, value = tree.report(before_ahead[a], before_ahead[b], before_back[c], before_back[d])
        found, entry, row, place = by_back[value], entry[query], row[query], place[query]
        longer = row >= n
        own = short[row[longer] - n, np.maximum(place[longer] - 1, 0)] if len(short) else np.zeros(0, np.uint8)
        good = found != row
        good[longer] = (place[longer] == 0) | (own != index[found[longer], place[longer]])
        yield entry[good], found[good], longer[good]


def places(entries: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(entry, place) for the places first to last of each entry, about TOGETHER at a time."""
    total = np.concatenate([[0], np.cumsum(last - first + 1)])
    for lo in range(0, int(total[-1]), TOGETHER):
        k = np.arange(lo, min(lo + TOGETHER, int(total[-1])))
        e = np.searchsorted(total, k, side="right") - 1
        yield entries[e], first[e] + k - total[e]


def characters(words: list[str], length: int) -> np.ndarray:
    """Words of one length as rows of characters; every letter that counts is one byte in Latin-1."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)


def near_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all entries (word, n, length, lo, hi) of a partition: word, near (variants found), and n and word of the best."""
    parts = list(batches)
    if not sum(len(b) for b in parts):
        return
    rows = pa.Table.from_batches(parts).combine_chunks()
    del parts
    coded = rows["word"].combine_chunks().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    words = coded.dictionary.take(pa.array(order)).to_pylist()
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    code = rank[coded.indices.to_numpy().astype(np.int64)]
    times = np.zeros(len(words), np.int64)
    times[code] = rows["n"].to_numpy()
    size = np.fromiter(map(len, words), np.int64, len(words))
    length, lo, hi = (rows[c].to_numpy().astype(np.int64) for c in ("length", "lo", "hi"))
    near = np.zeros(len(words), np.int64)
    best = np.full(len(words), -1, np.int64)

    def take(to: np.ndarray, other: np.ndarray) -> None:
        """Count variants, and keep of each word the most frequent one, of those the first."""
        np.add.at(near, to, 1)
        to, other = np.concatenate([to, np.flatnonzero(best >= 0)]), np.concatenate([other, best[best >= 0]])
        ranked = np.lexsort((other, -times[other], to))
        to, other = to[ranked], other[ranked]
        first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else ranked
        best[to[first]] = other[first]

    for m in np.unique(length).tolist():
        mine = np.flatnonzero(length == m)
        used = np.unique(code[mine])
        index, short = used[size[used] == m], used[size[used] == m - 1]
        if not len(index):
            continue
        number = np.zeros(len(words), np.int64)
        number[index], number[short] = np.arange(len(index)), len(index) + np.arange(len(short))
        found = pairs_of_length(characters([words[i] for i in index], m), characters([words[i] for i in short], m - 1), number[code[mine]], lo[mine], hi[mine])
        for entry, other, inserted in found:
            source, target = code[mine[entry]], index[other]
            take(np.concatenate([source, target[inserted]]), np.concatenate([target, source[inserted]]))
    some = np.flatnonzero(near)
    for k in range(0, len(some), 10_000):
        part = some[k : k + 10_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([words[i] for i in part], pa.string()), pa.array(near[part]), pa.array(times[best[part]]), pa.array([words[i] for i in best[part]], pa.string())],
            names=["word", "near", "best_n", "best"],
        )


def _keyed(entries: DataFrame) -> DataFrame:
    """entries with h, a hash of what must agree: the characters before lo and, of the longer word, from hi on."""
    short = F.col("length") - F.length("word")
    head = F.substring("word", F.lit(1), F.col("lo"))
    tail = F.substring(F.col("word"), F.col("hi") - short + 1, F.length("word"))
    return entries.withColumn("h", F.xxhash64("length", "lo", "hi", head, tail))


def _halves(entries: DataFrame) -> DataFrame:
    """Two entries in place of each, for the first and second half of its places."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    both = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi")))
    return entries.select("word", "n", "length", F.explode(both).alias("x")).select("word", "n", "length", "x.lo", "x.hi")


def deal(words: DataFrame) -> DataFrame:
    """Entries (word, n, length, lo, hi, h) of each word among words of its length and of one more."""
    lengths = F.array(F.length("word"), F.length("word") + 1)
    whole = words.select("word", "n", F.explode(lengths).alias("length")).withColumns({"lo": F.lit(0), "hi": F.col("length")})
    entries = cut(_keyed(_halves(whole)))
    while True:
        sizes = entries.groupBy("h").agg(F.count("*").alias("k"), F.sum(F.length("word")).alias("bytes"), F.max(F.col("hi") - F.col("lo")).alias("wide"))
        hot = cut(sizes.where(((F.col("k") > GROUP) | (F.col("bytes") > GROUP_BYTES)) & (F.col("wide") > 1)).select("h", F.lit(True).alias("hot")))
        n = hot.count()
        if not n:
            return entries
        marked = entries.join(F.broadcast(hot) if n <= HOT_BROADCAST else hot, "h", "left")
        split = (F.col("hot")) & (F.col("hi") - F.col("lo") > 1)
        again = _keyed(_halves(marked.where(split)))
        entries = cut(marked.where(~F.coalesce(split, F.lit(False))).drop("hot").unionByName(again))


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best and best_n of the words (word, n) that have variants among them."""
    entries = deal(words)
    total = entries.agg(F.count("*").alias("k"), F.sum(F.length("word")).alias("bytes")).first()
    tasks = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total["k"] // TASK), -(-(total["bytes"] or 0) // TASK_BYTES))
    dealt = entries.repartition(tasks, "h").select("word", "n", "length", "lo", "hi")
    found = dealt.mapInArrow(tidy(near_in_task), "word string, near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("low"), "best"))
    rows = found.groupBy("word").agg(F.sum("near").alias("n_near"), first.alias("x"))
    return rows.select("word", "n_near", F.col("x.best").alias("best"), (-F.col("x.low")).alias("best_n"))


def last_forms(forms: DataFrame) -> DataFrame:
    """word and root of (word, form) rows: forms are followed to the last, twice as far each round."""
    links = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = cut(links.join(onward, "root", "left"))
        more = stepped.where("further is not null").limit(1).count()
        links = stepped.select("word", F.coalesce("further", "root").alias("root"))
        if not more:
            return links


def group_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of docs of at least SHORTEST characters and LEAST occurrences.

    A word's form is the most frequent word one edit away (ties: the first in code-point order), if that stands FACTOR times
    as often; root follows forms to the last. Words are runs of letters; those whose checksum with the document's key NOISE
    divides lose a character. Null and empty texts have no words, a null key counts as the empty text; repeated rows count each time. An
    empty table gives no rows. Other columns do not count, whatever their names. Very long texts are searched in pieces between
    runs; very long words are looked up only at places where another word agrees on both sides.
    """
    words = cut(count_words(docs, key, text).where(F.col("n") >= LEAST))
    near = cut(near_words(words))
    found = words.join(near, "word", "left")
    kept = F.col("best_n") >= F.col("n") * FACTOR
    found = cut(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(kept, F.col("best")).alias("form"), F.when(kept, F.col("best_n")).alias("form_n")))
    roots = last_forms(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_LETTERS = "a-zÀ-ÿ"
ORACLE = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{_LETTERS}]+')) AS run FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run
), hashed AS (
  SELECT *, {crc32_sql(utf8_codes("(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)"))} AS h FROM counted
), spelled AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed
), words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), cuts AS (
  SELECT word, p, substr(word, 1, p) || substr(word, p + 2) AS rest FROM (SELECT word, unnest(range(0, length(word))) AS p FROM words)
), near AS (
  SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON w.word = c.rest
  UNION SELECT w.word, c.word FROM cuts c JOIN words w ON w.word = c.rest
), placed AS (
  SELECT a.word, a.other, w.n, row_number() OVER (PARTITION BY a.word ORDER BY w.n DESC, a.other) AS r, count(*) OVER (PARTITION BY a.word) AS n_near FROM near a JOIN words w ON w.word = a.other
), formed AS (
  SELECT w.word, w.n, coalesce(p.n_near, 0) AS n_near, CASE WHEN p.n >= 2 * w.n THEN p.other END AS form, CASE WHEN p.n >= 2 * w.n THEN p.n END AS form_n FROM words w LEFT JOIN placed p ON p.word = w.word AND p.r = 1
), chain AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL
), ends AS (
  SELECT c.word, c.root FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NULL
)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM formed f JOIN ends e ON e.word = f.word
"""
