"""Manifest, spelling variants and token counts against brute force: nulls, empty and long texts, ties, repeated rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, merges, merkle, quality, queries, spelling
from tidemark.llm.common import crc_mod

SF = "/root/testdata/sf0.001"
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, word string, n long, hash string, path string, place long, `by` string, h long"
LONG = "the lazy fox and the dog went over the hill\n" * 3000


@pytest.fixture(scope="module")
def rows(spark):
    real = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    odd = [
        (None, real[3][1], None, None, 5), (None, None, None, None, None), (90001, None, "en", "src0", None), (90002, "", None, "src0", 2**63 - 1), (90003, " \n\t ", "en", None, 0), (90004, LONG, "é", "src1", 7),
        real[5], real[5], (real[6][0], "another text", "en", "src2", -1), (90005, "ΣΑΣ İstanbul 日本 é́ <|endoftext|> x", "zz", "src1", 9), (90006, "x" * 30000 + " " + "ab" * 20000, "en", "s", 1),
    ]
    return [(*r, "w", 1, "h", "p", 3, "b", 4) for r in real + odd]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SHAPE).repartition(5).cache()


def key(values):
    return sorted(values, key=repr)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(hashes):
    """The root, and for each leaf its siblings as (hash or None, left)."""
    paths = [[] for _ in hashes]
    at = list(range(len(hashes)))
    while len(hashes) > 1:
        for i, k in enumerate(at):
            other = k ^ 1
            paths[i].append((hashes[other] if other < len(hashes) else None, k % 2 == 1))
            at[i] = k // 2
        hashes = [sha("".join(hashes[k : k + 2])) for k in range(0, len(hashes), 2)]
    return hashes[0], paths


def expected_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        changed = r[4] + 1 if r[4] is not None and zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 == 0 else r[4]
        groups[r[2]].append(((r[0] is not None, r[0] or 0), leaf(r[0], r[3], r[2], r[4], r[1]), leaf(r[0], r[3], r[2], changed, r[1]), r[0]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: tree([x[1] for x in sorted(groups[g], key=lambda x: x[:2])]) for g in order}
    root, tops = tree([made[g][0] for g in order])
    out = []
    for g, top in zip(order, tops):
        for x, low in zip(sorted(groups[g], key=lambda x: x[:2]), made[g][1]):
            node = x[2]
            for h, left in [*low, *top]:
                node = sha(node if h is None else h + node if left else node + h)
            out.append((x[3], x[1], made[g][0], root, sha("".join(h for h, _ in [*low, *top] if h)), node, node == root))
    return out


@pytest.mark.parametrize("depth", [1, 2, 10])
def test_manifest_against_a_plain_tree(docs, rows, depth):
    more = F.when(crc_mod("doc_id", 7) == 0, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    found = merkle.manifest(docs, change={"n_chars": more}, depth=depth)
    got = found.select("doc_id", "leaf", "subroot", "root", merkle.path_digest(F.col("path")), "folded", F.col("folded") == F.col("root"))
    assert key(tuple(r) for r in got.collect()) == key(expected_manifest(rows))


def test_manifest_of_few_rows(spark, docs):
    one = spark.createDataFrame([(1, "a", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    (row,) = merkle.manifest(one).collect()
    assert row.leaf == row.subroot == row.root == leaf(1, None, None, None, "a") and row.path == [] and "folded" not in row
    assert merkle.manifest(one.limit(0)).count() == 0
    assert leaf(None) != leaf("-") and leaf("", None) != leaf(None, "")


def test_manifest_blocks_meet_at_their_borders(spark):
    rows = [(i, f"t{i}", "en", "s", i) for i in range(33)] + [(i, f"t{i}", "fr", "s", i) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    full = [(*r[:5],) for r in rows]
    for depth in (1, 3, 5):
        found = merkle.manifest(docs, depth=depth, change={})
        assert key((r.doc_id, r.root) for r in found.collect()) == key((x[0], x[3]) for x in expected_manifest(full))


def test_manifest_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = con.sql(merkle.ORACLE).df()[columns]
    got = queries.op12_manifest(spark, SF).toPandas()[columns]
    assert key(map(tuple, got.values.tolist())) == key(map(tuple, want.values.tolist()))
    assert not got.verified.all() and got.verified.any()


def test_token_counts_are_the_librarys(docs, rows):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(bpe.default_vocabulary())
    expected = [(r[0], len((r[1] or "").encode()), n := len(own.encode(r[1] or "", add_special_tokens=False).ids), n > merges.LIMIT) for r in rows]
    got = merges.count_tokens(docs, keep=["doc_id"])
    assert key(tuple(r) for r in got.collect()) == key(expected)
    assert merges.count_tokens(docs.limit(0)).count() == 0
    assert merges.count_tokens(docs.withColumn("n_tokens", F.lit("x"))).columns.count("n_tokens") == 1


def test_merges_on_random_words():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(bpe.default_vocabulary())
    counter = merges.MergeCounter(bpe.WordBpe(open(bpe.default_vocabulary()).read()))
    r = random.Random(4)
    words = ["".join(r.choice(letters) for _ in range(r.randrange(1, 60))) for letters in ("ab", "aeiounrst", "abcdefghijklmnopqrstuvwxyz", "aab!-..") for _ in range(150)]
    for w in words:
        assert counter.tokens(w) == len(own.encode(w, add_special_tokens=False).ids), w
    counter.bytes = bpe.WORDS_BYTES + 1
    assert counter.tokens("hello there") == 2 and len(counter) == 2  # the cache began anew


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def expected_variants(counts):
    words = sorted(w for w, n in counts.items() if n >= 3 and len(w) >= 5)
    near = {w: [] for w in words}
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def counted(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return counts


def text_of(r, n, letters):
    return " ".join("".join(r.choice(letters) for _ in range(r.choice([1, 4, 5, 6, 7, 8]))) for _ in range(n))


@pytest.mark.parametrize("group", [spelling.GROUP, 12])
def test_variants_against_all_pairs(spark, monkeypatch, group):
    monkeypatch.setattr(spelling, "GROUP", group)
    monkeypatch.setattr(spelling, "TASK", 300)
    monkeypatch.setattr(spelling, "TOGETHER", 97)
    monkeypatch.setattr(spelling, "PIECE", 50)
    monkeypatch.setattr(spelling, "WORDS_KEPT", 40)
    r = random.Random(8)
    rows = [(i, text_of(r, 900, letters)) for i, letters in enumerate(("ab", "aB", "abéÿ", "abcD"))]
    rows += [(None, text_of(r, 500, "ab")), (7, None), (8, ""), (9, "123 \n"), (10, rows[0][1]), (10, rows[0][1]), (11, "x" * 3000 + " " + "x" * 2999 + " " + "x" * 1500 + "y" + "x" * 1499)]
    rows += [(12 + i, rows[-1][1]) for i in range(3)] + [(20, "weiß×÷ Straße STRASSE strasse " * 4)]
    docs = spark.createDataFrame([(*x, "w", 1, "f") for x in rows], "doc_id long, text string, word string, n long, form string").repartition(4)
    got = [tuple(x) for x in spelling.group_variants(docs).collect()]
    want = expected_variants(counted(rows))
    assert key(got) == key(want)
    assert any(len(w[0]) == 3000 and w[4] == 2 for w in want) and max(w[4] for w in want) > 15
    assert spelling.group_variants(docs.limit(0)).count() == 0


def test_forms_are_followed_to_the_last(spark):
    chain = [(f"word{i:03d}", f"word{i + 1:03d}") for i in range(70)]
    got = {r.word: r.root for r in spelling.last_forms(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {a: "word070" for a, _ in chain}


def test_wavelet_tree_reports_rectangles():
    r = np.random.default_rng(3)
    for n in (1, 2, 7, 64, 200):
        values = r.permutation(n)
        tree = spelling.WaveletTree(values)
        a, b, c, d = (r.integers(0, n + 1, 300) for _ in range(4))
        got = sorted(zip(*(x.tolist() for x in tree.report(a, b, c, d))))
        assert got == sorted((q, int(v)) for q in range(300) for v in values[a[q] : b[q]] if c[q] <= v < d[q])


def test_variants_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    want = con.sql(spelling.ORACLE).fetchall()
    names = [c[0] for c in con.sql(spelling.ORACLE).description]
    want = [tuple(dict(zip(names, x))[c] for c in columns) for x in want]
    assert key(tuple(x) for x in queries.op11_spelling(spark, SF).select(*columns).collect()) == key(want)


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.01"])
def test_quality_sql(spark, folder):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    found = con.sql(quality.ORACLE)
    columns = found.columns
    want = [tuple(x) for x in found.fetchall()]
    got = [tuple(x) for x in queries.op6_quality(spark, folder).select(*columns).collect()]
    assert key(got) == key(want)
    assert sum(x[columns.index("kept")] for x in want) > len(want) // 2 and any(x[columns.index("word_distance")] is None for x in want)
