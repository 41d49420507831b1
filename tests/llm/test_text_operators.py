"""Text operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, other columns."""

from __future__ import annotations

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import bpe, components, golay, langid, licenses, linededup, lm, neardup, quality, simhash, substrings, toxicity, winnow
from tidemark.llm.common import crc_mod

SF = "/root/testdata/sf0.001"
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, n_words long, fp long, score string, kept string"
LONG = "the lazy fox and the dog went over the hill\n" * 3000


@pytest.fixture(scope="module")
def rows(spark):
    real = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    odd = [(None, real[3][1], None, None), (90001, None, "en", "src0"), (90002, "", None, "src0"), (90003, " \n\t ", "en", None), (90004, LONG, "en", "src1"), real[5], real[5], (real[6][0], "another text", "en", "src2"), (90005, "ΣΑΣ İstanbul 日本 é́ <|endoftext|> x", "fr", "src1")]
    return [(*r, None, 7, 7, "s", "k") for r in real + odd]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SHAPE).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def key(values):
    return sorted(values, key=repr)


def test_bpe_is_the_librarys(docs, rows, empty):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(bpe.default_vocabulary())
    expected = []
    for r in rows:
        ids = own.encode(r[1] or "", add_special_tokens=False).ids
        back = own.decode(ids, skip_special_tokens=False)
        expected.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = bpe.encode_texts(docs, keep=["doc_id"])
    assert key(tuple(r)[:4] for r in got.collect()) == key(expected)
    assert bpe.encode_texts(empty).count() == 0
    coder = bpe.WordBpe(open(bpe.default_vocabulary()).read())
    assert coder.decode(coder.encode("Hello there!")) == own.decode(own.encode("Hello there!", add_special_tokens=False).ids, skip_special_tokens=False)


def test_golay_keys_meet_within_two_bits():
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 23, 3000)
    for flips in (0, 1, 2):
        y = x.copy()
        for _ in range(flips):
            y ^= 1 << r.integers(0, 23, len(x))
        a, b = golay.keys(x), golay.keys(y)
        assert all(set(p[p >= 0]) & set(q[q >= 0]) for p, q in zip(a, b))


def test_simhash_keys_meet_within_four_bits():
    r = np.random.default_rng(2)
    for _ in range(300):
        x = int(r.integers(0, 1 << 63)) * 2 + 1
        y = x
        for b in r.choice(64, 4, replace=False):
            y ^= 1 << int(b)
        a, b = (set(simhash.join_keys(np.array([v], np.uint64).view(np.int64))[0].tolist()) for v in (x, y))
        assert a & b


def reached(fps, ids):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(len(fps)):
        least[find(i)].append(ids[i])
    return [min((x for x in least[find(i)] if x is not None), default=None) for i in range(len(fps))]


def shingle_fp(text):
    words = re.findall("[^\x20\x09-\x0d]+", low(text))
    runs = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(docs, rows, empty):
    fps = [shingle_fp(r[1]) for r in rows]
    expected = key((r[0], fp - (1 << 64) if fp >> 63 else fp, c) for r, fp, c in zip(rows, fps, reached(fps, [r[0] for r in rows])))
    assert key(map(tuple, simhash.near_duplicates(docs).collect())) == expected
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and key(r.doc_id for r in kept.select("doc_id").collect()) == key({c for _, _, c in expected})


def test_long_runs_are_linked_as_all_pairs_would(spark):
    r = np.random.default_rng(4)
    base = int(r.integers(0, 1 << 62))
    fps = sorted({base} | {base ^ sum(1 << int(b) for b in r.choice(64, int(r.integers(1, 7)), replace=False)) for _ in range(150)})
    df = spark.createDataFrame([(x if x < 1 << 63 else x - (1 << 64),) for x in fps], "fp long")
    edges = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(df).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in edges)
    place = {x: i for i, x in enumerate(fps)}
    root = list(range(len(fps)))
    for a, b in edges:
        old, new = root[place[a]], root[place[b]]
        root = [new if x == old else x for x in root]
    expected = reached(fps, list(range(len(fps))))
    assert len(set(root)) == len(set(expected)) and len(set(zip(root, expected))) == len(set(expected))


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.node: r.root for r in components.components(df).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, 101: 100}
    assert components.components(df.limit(0)).count() == 0


def covered(texts, length, least):
    count = Counter(b[i : i + n] for n in (length, least) for b in texts for i in range(len(b) - n + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[: len(b)]
        shared = {j for i in range(len(b) - least + 1) if count[b[i : i + least]] > 1 for j in range(i, i + least)}
        rest = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(rest).hexdigest(), len(shared)))
    return out


@pytest.mark.parametrize("together", [1000, 3, 1])
def test_substrings(spark, rows, empty, together):
    some = [(r[0], r[1]) for r in rows[:60]] + [(r[0], r[1]) for r in rows[-9:] if r[1] != LONG] + [(8, "ab" * 500), (9, "x" * 399), (10, "z" * 401), (11, "one two\n" * 90), (12, None)]
    passage = rows[9][1].encode()[:430].decode(errors="ignore")  # in many places, between different words: a hot anchor
    some += [(100 + i, f"before {i * i} {passage[: 330 + 7 * i]} {i} after {i}") for i in range(14)]
    df = spark.createDataFrame(some, "doc_id long, text string")
    got = substrings.remove_repeats(df, together=together)
    expected = [(d, *x) for (d, _), x in zip(some, covered([(t or "").encode() for _, t in some], 400, 304))]
    assert key(tuple(r)[:6] for r in got.collect()) == key(expected)
    assert substrings.remove_repeats(empty).count() == 0


def test_periods_leave_every_repeat_to_be_seen():
    r = np.random.default_rng(12)
    for turn in range(60):
        rows = []
        for _ in range(int(r.integers(1, 4))):
            parts = []
            for _ in range(int(r.integers(1, 5))):
                unit = bytes(r.choice(list(b"ab-"), int(r.choice([1, 2, 3, 7, 20, 61]))))
                parts.append((unit * 600)[: int(r.integers(1, 400))] if r.random() < 0.8 else bytes(r.choice(list(b"xyz"), 50)))
            rows.append(b"".join(parts))
        at, length, least = np.cumsum([0, *map(len, rows)]), 80, 60
        data = np.frombuffer(b"".join(rows), np.uint8)
        row, first, count, size, *_ = substrings.anchors(data, at, length, least, k=8)
        where = [(int(i), int(x) + j, bool(z)) for i, x, n, z in zip(row, first, count, size) for j in range(int(n))]
        assert sorted(w[:2] for w in where) == [(i, x) for i, t in enumerate(rows) for x in range(len(t) - least + 1)]
        for n in (length, least):
            strings = {(i, x): rows[i][x : x + n] for i, x, _ in where if x + n <= len(rows[i])}
            every, seen = Counter(strings.values()), Counter(strings[i, x] for i, x, z in where if z and (i, x) in strings)
            assert all((every[strings[i, x]] > 1) == (not z or seen[strings[i, x]] > 1) for i, x, z in where if (i, x) in strings)


def test_a_run_of_one_byte_has_few_intervals(spark):
    dashes = np.full(400_000, ord("-"), np.uint8)
    row, _, count, size, *_ = substrings.anchors(dashes, np.array([0, len(dashes)]))
    assert len(row) < 1_000 and count.sum() == 400_000 - substrings.LEAST + 1 and size.sum() < 100_000
    df = spark.createDataFrame([(1, "-" * 400_000), (2, "x" + "-" * 400), (3, "y" + "-" * 399), (4, "ab" * 3_000 + "c"), (5, "z" * 400)], "doc_id long, text string")
    assert {x.doc_id: (x.n_removed, x.n_spans) for x in substrings.remove_repeats(df).collect()} == {1: (400_000, 1), 2: (400, 1), 3: (0, 0), 4: (6_000, 1), 5: (0, 0)}


def test_suffix_arrays_see_two_copies_of_every_repeat(spark, monkeypatch):
    text = " ".join(f"w{x}" for x in np.random.default_rng(1).integers(0, 1 << 40, 300))
    df = spark.createDataFrame([(i, text + f" {i}") for i in range(5)], "doc_id long, text string").withColumn("key", F.col("doc_id"))
    marks = substrings.mark_intervals(df.select("key", "text"), 400, 304).cache()
    often = {(x.h, x.r) for x in marks.groupBy("h", "r").count().where("count > 1").collect()}
    sorted_of = []
    whole = substrings.sort_regions
    monkeypatch.setattr(substrings, "sort_regions", lambda regions, *x: sorted_of.append(regions) or whole(regions, *x))
    substrings.remove_repeats(df).collect()
    rows = sorted_of[0].collect()
    pair = [x for x in rows if x.g in {y.g for y in rows if y.copy == 1}]
    starts = {(x.h, x.r): x.n for x in marks.collect() if (x.h, x.r) in often}
    assert len(often) > 5 and sorted(x.copy for x in pair) == [0, 1] and len({x.region for x in pair}) == 1
    assert text.startswith(pair[0].region.decode()) and pair[0].n == sum(starts.values())


def test_suffix_array_orders_suffixes():
    r = np.random.default_rng(3)
    for _ in range(40):
        raw = bytes(r.choice(list(b"aab "), 60)) + b"\xff" + bytes(r.choice(list(b"ab"), 50)) + b"\xff"
        text = np.frombuffer(raw, np.uint8)
        breaks = np.flatnonzero(text == 255)
        array = substrings.suffix_array(text, breaks[np.searchsorted(breaks, np.arange(len(text)))] - np.arange(len(text)), 400)
        suffixes = [raw[i : raw.index(255, i) + 1] for i in array]
        assert sorted(array.tolist()) == list(range(len(raw))) and all(a[:50] <= b[:50] for a, b in zip(suffixes, suffixes[1:]))


def test_suffix_array_sorts_long_near_copies_in_few_steps(monkeypatch):
    r = np.random.default_rng(5)
    words = [bytes(r.choice(list(b"abcdefgh"), int(r.integers(2, 9)))) for _ in range(300)]
    passage = b" ".join(words[i] for i in r.integers(0, 300, 90))[:420]
    regions = [passage[:k] + b"%d" % (k * k) + passage[k:] + b"\xff" for k in range(5, 400, 5)]
    text = np.frombuffer(b"".join(regions), np.uint8)
    breaks = np.flatnonzero(text == 255)
    left = breaks[np.searchsorted(breaks, np.arange(len(text)))] - np.arange(len(text))
    moved = []
    argsort, lexsort = np.argsort, np.lexsort
    monkeypatch.setattr(np, "argsort", lambda a, *x, **y: moved.append(len(a)) or argsort(a, *x, **y))
    monkeypatch.setattr(np, "lexsort", lambda keys, *x, **y: moved.append(len(keys[0])) or lexsort(keys, *x, **y))
    array = substrings.suffix_array(text, left, 400)
    raw = text.tobytes()
    suffixes = [raw[i : raw.index(255, i) + 1][:400] for i in array.tolist()]
    assert sorted(array.tolist()) == list(range(len(raw))) and all(a <= b for a, b in zip(suffixes, suffixes[1:]))
    assert sum(moved) < 5 * len(text), sum(moved) / len(text)


def test_ranges_of_many_rows_are_merged_within_each():
    runs = [[(0, 3), (20, 20), (2, 5)], None, [(1, 1)], [], [(0, 0), (4, 4)]]
    lists = pa.array([None if x is None else [{"first": a, "last": b} for a, b in x] for x in runs], substrings.as_lists(*[np.zeros(0, np.int64)] * 3, 0).type)
    assert [list(map(int, x)) for x in zip(*substrings.covered(lists, 4))] == [[0, 0, 9], [0, 20, 24], [2, 1, 5], [4, 0, 8]]
    assert [len(x) for x in substrings.covered(lists.slice(1, 1), 4)] == [0, 0, 0]


def test_language(docs, rows, empty):
    labelled = docs.where(crc_mod("doc_id", 3) != 1).select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"))
    found = langid.identify(docs, langid.train(labelled)).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    for r in found:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")), r
    right = [r.lang_pred == r.lang for r in found if r.lang and r.doc_id is not None and r.doc_id < 90000 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean(right) > 0.95
    assert langid.train(labelled.limit(0)) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"} and langid.identify(empty, None).count() == 0


def test_lines(spark, docs, rows, empty):
    fixed = [(i, f"MENU\nbody {i}\n\nMENU", "a") for i in range(6)] + [(20 + i, f"RARE {i % 2}\nMENU", "b") for i in range(4)] + [(30, None, "a"), (31, "MENU", None)]
    df = spark.createDataFrame(fixed, "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in linededup.drop_boilerplate(df).collect()}
    assert got[0] == ("body 0\n", 2) and got[20] == ("RARE 0\nMENU", 0) and got[30] == (None, 0) and got[31] == ("MENU", 0)
    out = linededup.drop_boilerplate(docs, ratio=0.1)
    pages, seen = Counter(r[3] for r in rows), Counter()
    for r in rows:
        seen.update({(r[3], x) for x in (r[1] or "").split("\n") if re.search("[^ \t-\r]", x)})
    often = {k for k, n in seen.items() if n >= linededup.MIN_PAGES and n > 0.1 * pages[k[0]]}
    expected = [(r[0], None if r[1] is None else "\n".join(x for x in r[1].split("\n") if (r[3], x) not in often)) for r in rows]
    assert key((r.doc_id, r.text) for r in out.collect()) == key(expected)
    assert linededup.drop_boilerplate(empty).count() == 0


def base_counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            repeated += line in seen
            seen.add(line)
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(runs)
    marked = {j for i, x in enumerate(runs) if count[x] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), repeated, len(marked)


def test_quality(docs, rows, empty):
    found = quality.judge(docs).collect()
    assert key((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == key((r[0], *base_counts(r[1])) for r in rows)
    for r in found:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    assert np.mean([r.kept for r in found]) > 0.6 and quality.judge(empty).count() == 0


def test_js_distance(spark):
    array = lambda *x: F.array(*[F.lit(a) for a in x])
    get = lambda p, q: spark.range(1).select(quality.js_distance(p, q).alias("d")).first()["d"]
    assert get(array(1.0, 0.0), array(0.0, 1.0)) == 1 and get(array(0.5, 0.5), array(0.5, 0.5)) == 0


@pytest.mark.parametrize("head", [1 << 19, 300])
def test_lm_base(docs, rows, empty, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    found = lm.score(docs, crc_mod("doc_id", 10) != 0).collect()
    tokens = lambda t: [*low(t).encode().split(), None]
    count = Counter(x for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 10 for x in tokens(r[1]))
    n, v = sum(count.values()), len(count)
    expected = [(r[0], len(tokens(r[1])), sum(count[x] > 0 for x in tokens(r[1])), n, round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(r[1])), 3)) for r in rows]
    assert key((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in found) == key(expected)
    assert all(r.score < 0 for r in found) and lm.score(empty, F.lit(True)).count() == 0


@pytest.fixture(scope="module")
def small_lm():
    """A vocabulary of the classes of a few words, a bias and weights that are all in use."""
    r = np.random.default_rng(0)
    text = pa.array(["the a of to in " * 50 + " ".join(f"word{x} thing{x}s" for x in r.integers(0, 300, 400))])
    data, at = lm.text_bytes(text)
    starts, ends, _ = lm.words_of(data, at)
    keys, first, n = np.unique(lm.word_keys(data, starts, ends), return_index=True, return_counts=True)
    own = lm.word_endings(data, starts[first], ends[first])
    e, place = np.unique(own, return_inverse=True)
    endings = pa.table({"e": e, "c": np.bincount(place, weights=n).astype(int), "n": np.bincount(place)})
    v = lm.Vocabulary.of(pa.table({"k": keys, "c": n, "e": own}), endings, 1)
    w = {k: x + r.normal(0, 0.2, x.shape).astype(np.float32) for k, x in lm.fresh_weights().items()}
    return v, lm.pair_bias(r.integers(0, 9, (lm.CLASSES + 1, lm.CLASSES))), w


def attended(v, bias, w, text):
    """Log-probability of each class of a text's words, and their classes, one word at a time."""
    rows, classes, _ = v.split(*lm.text_bytes(pa.array([text])))
    before, last = [lm.START, *rows[:-1]], [lm.CLASSES, *classes[:-1]]
    out = []
    for t in range(len(rows)):
        q, _, _ = np.split(w["embed"][before[t]].astype(float) @ w["mix"], 3)
        see = range(max(0, t // lm.STRIDE * lm.STRIDE - lm.STRIDE), t + 1)
        parts = [np.split(w["embed"][before[j]].astype(float) @ w["mix"], 3) for j in see]
        s = np.array([q @ k * lm.WIDTH**-0.5 + w["near"][t - j] for j, (_, k, _) in zip(see, parts)])
        a = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        z = w["embed"][before[t]] + sum(x * y for x, (_, _, y) in zip(a, parts))
        h = z + np.maximum(z @ w["up"] + w["lift"], 0) @ w["down"]
        soft = lambda x: x - np.log(np.exp(x).sum())
        group = soft(bias[0][last[t]] + h @ w["group"])
        out.append(np.concatenate([group[g] + soft(bias[1][last[t], g] + h @ w["inner"][g]) for g in range(lm.GROUPS)]))
    return np.array(out), classes


def test_lm_attention_is_that_of_single_words(small_lm):
    v, bias, w = small_lm
    texts = ["the word1 of thing2s " * 30, "", "a", "unheard-of words and the word7 " * 11]
    got = lm.log_gains(v, bias, w, *lm.text_bytes(pa.array(texts)))
    for text, gain in zip(texts, got):
        logs, classes = attended(v, bias, w, text)
        assert np.allclose(np.exp(logs).sum(1), 1)
        assert np.isclose(gain, (logs[np.arange(len(classes)), classes] - v.mass[classes]).sum() / np.log(10), rtol=1e-3, atol=1e-3)
    alone = [lm.log_gains(v, bias, w, *lm.text_bytes(pa.array([t])))[0] for t in texts]
    assert np.allclose(got, alone, atol=1e-3)


def test_lm_gradients(small_lm):
    v, bias, w = small_lm
    w = {k: x.astype(np.float64) for k, x in w.items()}
    rows, classes, first = v.split(*lm.text_bytes(pa.array(["the word1 of thing2s a word3 " * 9, "in to a"])))
    before, last, target = lm.windows(rows, classes, first)
    run = lambda: lm.forward(w, bias, before, last, target >= 0, target, classes[np.maximum(target, 0)])
    got = lm.backward(w, run())
    r = np.random.default_rng(1)
    for name, g in got.items():
        if name == "embed":
            full = np.zeros_like(w["embed"])
            full[g[0]] = g[1]
            g = full
        flat = w[name].reshape(-1)
        for i in r.choice(np.flatnonzero(np.abs(g.reshape(-1)) > 1e-4), 5):
            old, step = flat[i], 1e-3
            ends = []
            for x in (old + step, old - step):
                flat[i] = x
                ends.append(-run()["log"].astype(float).mean())
            flat[i] = old
            assert np.isclose((ends[0] - ends[1]) / (2 * step), g.reshape(-1)[i], rtol=0.05, atol=2e-4), name


def test_lm_attention_reads_blocks_where_they_lie(small_lm):
    v, bias, w = small_lm
    rows, classes, first = v.split(*lm.text_bytes(pa.array(["the word1 of thing2s a word3 " * 9, "in to a", "", "b " * 40])))
    before, last, target = lm.windows(rows, classes, first)
    f = lm.forward(w, bias, before, last, target >= 0, target, classes[np.maximum(target, 0)])
    assert np.shares_memory(f["keys"], f["values"]) and np.shares_memory(f["keys"][0], f["keys"][1]) and np.shares_memory(f["q"], f["keys"])
    assert f["keys"].shape == (len(before) // lm.STRIDE - 1, 2 * lm.STRIDE, lm.WIDTH) and sorted(f["number"]) == list(range(len(rows)))
    assert all(np.isfinite(x[1] if k == "embed" else x).all() for k, x in lm.backward(w, f).items())


def test_lm_learns_from_every_window(small_lm):
    v, bias, _ = small_lm
    texts = ["a " * 9000, "", "a", None, "b c " * 900, *["a b"] * 300]
    trainer = lm.Trainer(v, bias, lm.fresh_weights())
    for part in (texts[:3], texts[3:]):
        trainer.add(*lm.text_bytes(pa.array(part)))
    trainer.finish()
    assert trainer.seen == sum(len((t or "").split()) + 1 for t in texts) and not trainer.held
    assert all(np.isfinite(x).all() for x in trainer.w.values())
    assert lm.WIDTH == 32 and lm.CLASSES == 256


def test_lm_attention_adds_to_class_pairs(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")

    def held_out() -> float:
        found = lm.score(docs, crc_mod("doc_id", 10) != 0).where(crc_mod("doc_id", 10) == 0)
        row = found.agg(F.sum("score").alias("s"), F.sum("n_tokens").alias("n")).first()
        return row["s"] / row["n"]

    trained = held_out()
    monkeypatch.setattr(lm, "ROUNDS", 0)  # the weights that training starts from: class pairs alone
    assert trained > held_out() + 0.03


def test_lm_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = [r for r in lm.score(docs, crc_mod("doc_id", 10) != 0).collect() if zlib.crc32(str(r.doc_id).encode()) % 10 == 0]
    tokens = sum(r.n_tokens for r in found)
    assert sum(r.score for r in found) / tokens > sum(r.base_score for r in found) / tokens + 0.2


def test_near_duplicates_are_those_of_similarity_08(spark):
    r = np.random.default_rng(3)
    base = [f"w{x}" for x in r.integers(0, 500, 200)]
    edited = lambda *at: " ".join("new" if i in at else w for i, w in enumerate(base))
    texts = {1: edited(), 2: edited(20), 3: edited(40, 80), 4: edited(*range(100)), 5: "", 6: " \n", 7: "a b", 8: "A  b", 9: "a c"}
    texts |= {20 + i: edited(i * 3, 100 + i) for i in range(60)}  # a long run
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")

    def own(text):
        w = low(text).split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {i: own(t) for i, t in texts.items()}
    root = {i: i for i in texts}
    for _ in range(3):
        for i in texts:
            for j in texts:
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns and key(x.doc_id for x in kept.collect()) == key(set(root.values())) == [1, 4, 5, 7, 9]
    assert neardup.keep_one(df.limit(0)).count() == 0


def test_crowds_near_the_similarity_are_grouped_as_all_pairs_would(spark):
    rng = np.random.default_rng(5)
    base, texts = [f"w{i}" for i in rng.integers(0, 5000, 200)], []
    for i in range(150):  # pairs of similarity 0.6 to 0.95, most of them near 0.8
        own = list(base)
        for j in rng.choice(200, 1 + i % 6, replace=False):
            own[j] = f"n{i}x{j}"
        texts.append(" ".join(own))
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(196)) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    kept = neardup.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(group))


def test_copies_give_pairs_in_proportion(spark):
    base = [f"w{i}" for i in range(300)]
    texts = [(" ".join([*base[:i], f"n{i}", *base[i + 1 :]]),) for i in range(300)]  # every pair is similar
    shared = neardup.shared_bands(neardup.sketches_of(spark.createDataFrame(texts, "text string"), "text", 5)).cache()
    roots = spark.createDataFrame([], "node long, root long")
    assert neardup.candidates(shared, 0.8).count() < shared.count() <= 300 * neardup.BANDS
    assert neardup.candidates(shared, 0.8, roots).count() > 30_000  # what trees leave out
    one = shared.select("node", F.lit(1).cast("long").alias("root")).distinct()
    assert neardup.candidates(shared, 0.8, one).count() == 0


def test_rows_of_a_crowd_near_the_similarity_grow_as_its_texts(spark, monkeypatch):
    r, n, written = np.random.default_rng(11), 300, []
    base, texts = [f"w{i}" for i in range(300)], []
    for i in range(n):  # most pairs have a similarity of about 0.71; the last 10 are linked to the 10 before them
        own = list(base)
        for j in r.choice(np.arange(5, 295, 10), 5, replace=False):
            own[j] = f"n{i}x{j}"
        texts.append(" ".join(own))
    texts[-10:] = [t + " more" for t in texts[-20:-10]]

    def counted(df, cut=neardup.cut):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(neardup, "cut", counted)
    monkeypatch.setattr(components, "cut", counted)
    kept = {row.doc_id for row in neardup.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for t in texts]
    group = list(range(n))
    for i in range(n):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    assert kept == set(group) and len(kept) < n
    assert max(written) <= 4 * n, written
    # Parts of a large cluster meet two by two, and give the same groups.
    monkeypatch.setattr(neardup, "PART", 1 << 17)
    parts = neardup.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {row.doc_id for row in parts.collect()} == kept


def test_stars_and_exact_links_hold_together_what_all_pairs_would():
    r = np.random.default_rng(12)
    pool = [r.integers(0, 60, 30) for _ in range(4)]
    sets = [np.unique(np.r_[pool[i % 4][: 20 + i % 11], r.integers(0, 60, i % 7)]).astype(np.uint64) for i in range(120)]
    want = [(i, j) for i in range(120) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9]
    found = neardup.exact_links(sets, 0.8)
    assert len(found) < len(sets) < len(want) and {tuple(sorted(p)[::-1]) for p in found.tolist()} <= set(want)
    assert neardup.joined(120, found).tolist() == neardup.joined(120, np.array(want)).tolist()
    assert neardup.joined(5, np.array([[4, 3], [3, 1], [0, 2]])).tolist() == [0, 1, 0, 1, 1]
    assert len({int(k) >> 16 for k in neardup.join_keys(np.array([neardup.fingerprint(sets[0])])).ravel() if k >= 0}) == neardup.TABLES


def test_sets_of_similarity_08_share_a_golay_key():
    r = np.random.default_rng(4)
    for common, own in ((8, 1), (40, 5), (320, 40)):
        found = []
        for _ in range(300):
            s = r.integers(0, 2**63, common + 2 * own).astype(np.uint64)
            a, b = (np.array([neardup.fingerprint(x)]) for x in (s[: common + own], np.r_[s[:common], s[common + own :]]))
            keys = [set(neardup.join_keys(x).ravel().tolist()) - {-1} for x in (a, b)]
            low = [x[0, : neardup.CHECK] for x in (a, b)]
            found.append(bool(keys[0] & keys[1]) and neardup.distance(*low) <= neardup.limits(0.8)[1])
        assert sum(found) >= 299
    piece = int.from_bytes(a[0].tobytes(), "little") & (1 << neardup.PIECE) - 1
    codes = golay.keys(np.array([piece & (1 << golay.LENGTH) - 1]))[0]
    assert neardup.join_keys(a)[0, 0].tolist() == [c if c < 0 else piece >> golay.LENGTH << golay.DATA | c for c in codes.tolist()]


def test_sets_that_share_no_more_than_a_key_are_not_near(spark):
    r = np.random.default_rng(6)
    prints = r.integers(0, 2**64, (3000, neardup.LANES + 1), dtype=np.uint64)
    piece = np.uint64((1 << neardup.PIECE) - 1)
    prints[:, 0] = prints[:, 0] & ~piece | prints[0, 0] & piece
    prints[:, neardup.LANES] = 100
    sketches = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(prints)], "node long, sketch binary")
    shared = neardup.shared_bands(sketches, whole=False).where(F.col("k") < 1 << neardup.BLOCK + golay.DATA)  # of the first piece
    assert shared.count() >= 3000 and neardup.candidates(shared, 0.8).count() < 100


def test_short_texts_make_no_clusters_by_chance(spark):
    r = np.random.default_rng(8)
    texts = [(" ".join(f"w{x}" for x in r.integers(0, 10**6, 5 + i % 8)),) for i in range(6000)]
    pairs = [(f"a{i} b c d e f g h i", f"x a{i} b c d e f g h i") for i in range(50)]  # 5 and 6 shingles, 5 in common
    sketches = neardup.sketches_of(spark.createDataFrame(texts, "text string"), "text", 5).cache()
    assert neardup.clusters(neardup.shared_bands(sketches), 0.8).count() == 0
    kept = neardup.keep_one(spark.createDataFrame([(i, t[j]) for j in (0, 1) for i, t in enumerate(pairs, 50 * j)], "doc_id long, text string"))
    assert kept.count() < 60
    few = neardup.shared_bands(sketches, least=0.8)
    assert few.select("node").distinct().count() == sum(5 + i % 8 >= 8 for i in range(6000))  # 4 shingles and more


def test_runs_of_a_key_are_compared_in_blocks(monkeypatch):
    r = np.random.default_rng(7)
    size = np.r_[r.integers(1, 9, 200), r.integers(9, neardup.PAIRED + 1, 20), neardup.PAIRED, neardup.PAIRED + 1, 700, 2000]
    edge = np.r_[0, np.cumsum(size)]
    prints = r.integers(0, 2**64, (edge[-1], neardup.LANES + 1), dtype=np.uint64)
    prints[:, neardup.LANES] = 100
    prints[-2000:-10] = prints[-1]  # near copies
    prints[-2000:-10, 0] ^= np.uint64(1) << r.integers(0, 64, 1990, dtype=np.uint64)
    for lo, hi in zip(edge[:-1], edge[1:]):  # chains
        prints[lo + 1 : hi : 5] = prints[lo : hi - 1 : 5]
        prints[lo + 1 : hi : 5, :2] ^= np.uint64(0xFFFF)
    low, calls, count = np.ascontiguousarray(prints[:, :2]), [], np.bitwise_count
    near = np.zeros((0, 2), np.int64)
    for lo, hi in zip(edge[:-1], edge[1:]):
        near = np.r_[near, lo + np.argwhere(np.triu(count(low[lo:hi, None] ^ low[None, lo:hi]).sum(2) <= 38, 1))]
    monkeypatch.setattr(np, "bitwise_count", lambda x: calls.append(x.size) or count(x))
    found = neardup.met_pairs(low, edge, 38)
    assert len(calls) < len(low) / 4 and sum(calls) < 2.5 * (size * size / 2).sum()
    assert found[:, 0].tolist() == np.unique(near).tolist() and {tuple(x) for x in np.sort(found, 1).tolist()} <= {tuple(x) for x in near.tolist()}
    stars = neardup.near_stars(low, edge, prints, 38, 0.8, (200, 180))
    near = near[count(prints[near[:, 0], :-1] ^ prints[near[:, 1], :-1]).sum(1) <= 200]
    assert len(stars) < len(low) and neardup.joined(len(low), stars).tolist() == neardup.joined(len(low), near).tolist()


@pytest.mark.parametrize("keep_one", [simhash.keep_one, neardup.keep_one])
def test_each_component_keeps_a_row(spark, keep_one):
    r = np.random.default_rng(5)
    text = lambda: " ".join(f"w{x}" for x in r.integers(0, 9999, 60))
    a, b, c, d, e, f = (text() for _ in range(6))
    some = [(None, a), (None, b), (None, b), (None, c), (3, c), (1, d), (7, d), (7, e), (7, e), (9, f), (9, a)]
    df = spark.createDataFrame(some, "doc_id long, text string")
    # a has doc_id 9, b none, c 3, d 1; e is of 7 alone, though another text of 7 copies d.
    both = [(9, a), (9, f)] if keep_one is neardup.keep_one else [min([(9, a), (9, f)], key=lambda x: (shingle_fp(x[1]) ^ 1 << 63))]
    assert key(map(tuple, keep_one(df).collect())) == key([*both, (None, b), (3, c), (1, d), (7, e)])
    nulls = df.where("doc_id is null")
    assert key(x.text for x in keep_one(nulls).collect()) == key([a, b, c])


def test_lines_of_a_tenth_of_a_sites_pages_go(spark):
    texts = ["\n".join(["footer"] * (i % 12 == 0) + ["seldom"] * (i % 25 == 0) + [f"own {i}"]) for i in range(100)]
    df = spark.createDataFrame([(i, "site", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in linededup.drop_boilerplate(df).collect()}
    assert got == {i: (t.removeprefix("footer\n"), int(i % 12 == 0)) for i, t in enumerate(texts)}


def test_toxicity(spark, empty):
    r = np.random.default_rng(0)
    words = [f"w{i}" for i in range(60)]
    texts, toxic = [], []
    for i in range(400):
        own = list(r.choice(words, 30))
        toxic.append(i % 4 == 0)
        if toxic[-1]:
            for w in ("vile", "nasty", "vile"):
                own.insert(int(r.integers(0, len(own))), w)
        texts.append(" ".join(own))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic) if i < 300] + [(5, None), (None, 1)], "id long, toxic int")
    chain = toxicity.train(docs, labels)
    found = {x.id: x for x in toxicity.score(docs, chain).collect()}
    assert all(found[i].predicted == int(toxic[i]) for i in range(300, 400))
    span = found[300].toxic_spans[0]
    assert texts[300].encode()[span.start : span.end].decode().split()[0] in ("vile", "nasty")
    odd = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, LONG, 0.5), (3, LONG, 0.5)], "id long, text string, score double")
    assert all(0 <= x.score < 0.5 for x in toxicity.score(odd, chain).collect())
    assert toxicity.drop_toxic(docs, chain).count() == 300 and toxicity.score(empty, chain).count() == 0
    assert toxicity.train(docs, labels.limit(0)) is None


def test_toxicity_learns_in_a_task_from_1500_of_each_class(spark, monkeypatch):
    assert (toxicity.SAMPLE, toxicity.SAMPLE_BYTES) == (1_500, 8 << 20)
    docs = spark.createDataFrame([(i, f"w{i % 9} w{i % 7} vile{i % 2} w{i % 5}") for i in range(2600)], "id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2600)], "id long, toxic int")
    monkeypatch.setattr(toxicity.Chain, "odds", None)  # of the driver only
    chain = toxicity.train(docs, labels)
    w = chain.keys.tolist()
    assert len(w) == 11 and np.isfinite(chain.weight).all()


def test_chain_is_solved_as_step_by_step():
    r = np.random.default_rng(0)
    for n in (1, 63, 64, 65, 1000):
        gain, a, x, expected = r.random(n) + 0.1, [r.random(n) for _ in range(4)], 0.7, []
        for t in range(n):
            x = gain[t] * (a[0][t] + a[1][t] * x) / (a[2][t] + a[3][t] * x)
            expected.append(x)
        assert np.allclose(toxicity.solve(gain, tuple(a), 0.7), expected)


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve."), (2, "short Item here"), (3, ""), (4, None), (5, "short item HERE"), (6, "one two three four five six seven eight nine ten other words follow on")]


def hits(text, items):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words = pattern.findall(low(text))
    marked, found = set(), set()
    for item, t in items:
        own = pattern.findall(low(t))
        size = min(10, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                marked |= set(range(i, i + size))
                found.add(str(item))
    return len(words), len(marked), sorted(found)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_winnowing(spark, docs, rows, empty, block):
    real = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()][: 40 if block > 40 else 3]
    items = ITEMS + real
    bench = spark.createDataFrame(items, "item_id long, text string")
    more = [(800, "x ONE two, three four-five six seven eight nine ten eleven! y short item here"), (801, "two three four five six seven eight nine ten eleven twelve" * 2), (802, "one two three four five six seven eight nine")]
    some = [(r[0], r[1]) for r in rows[: 200 if block > 40 else 20]] + [(r[0], r[1]) for r in rows[-9:]] + more
    df = spark.createDataFrame(some, "doc_id long, text string")
    got = winnow.find_spans(df, bench, keep=["doc_id"], block_bytes=block)
    assert key((r.doc_id, r.n_words, r.n_hit, r.hit_items) for r in got.collect()) == key((d, *hits(t, items)) for d, t in some)
    left = winnow.decontaminate(df, bench)
    assert left.columns == ["doc_id", "text"] and left.count() == sum(not hits(t, items)[1] for _, t in some)
    assert winnow.find_spans(empty, bench).count() == 0 and winnow.find_spans(df, bench.limit(0)).where("n_hit > 0").count() == 0


def test_licenses(spark, docs, empty):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 200)
    texts = [(1, "Intro\nReleased under the MIT license\nend"), (2, None), (3, ""), (4, "one"), (5, "Copyright\n" + mit.replace(". ", ".\n") + "\nend"), (6, "licensed under nothing at all"), (7, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.")]
    found = {r.doc_id: r for r in licenses.find_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [found[i].license for i in range(1, 8)] == ["MIT", None, None, None, "MIT", None, "CC-BY-NC-4.0"]
    assert found[5].dice == 1 and found[5].matches[0].first_line == 1 and found[7].n_matches >= 2
    assert licenses.find_licenses(docs).count() == docs.count() and licenses.find_licenses(empty).count() == 0


def test_licenses_against_brute_force(spark, docs):
    sets = [(n, set(licenses.bigrams(t).tolist())) for n, t in licenses.TEMPLATES]
    for r in licenses.find_licenses(docs.where(F.length("text") < 3000).limit(60)).collect():
        lines, best = (r.text or "").split("\n"), 0.0
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                own = set(licenses.bigrams("\n".join(lines[a : b + 1])).tolist())
                best = max([best, *(2 * len(own & s) / (len(own) + len(s)) for _, s in sets)])
        assert r.dice == pytest.approx(best if best >= licenses.THRESHOLD else 0.0)


def test_a_header_that_many_items_share():
    header = "this is the common header of all items in the benchmark set".split()
    rows = [(str(i), " ".join(header + [f"w{i}x{j}" for j in range(20)])) for i in range(2000)]
    index = winnow.Index(rows)
    text = (" ".join(header) + " and then some more words . ") * 100 + " ".join(["b", *header[3:], "w7x0", "w7x1", "w7x2"])
    data = np.frombuffer(text.encode(), np.uint8)
    began = time.perf_counter()
    ((n, spans, items),) = index.match(data, np.array([0, len(data)]))
    took = time.perf_counter() - began
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    windows = defaultdict(set)
    for i, t in rows:
        w = t.split()
        for j in range(len(w) - 9):
            windows[tuple(w[j : j + 10])].add(i)
    hit, held = set(), set()
    for j in range(len(words) - 9):
        if own := windows.get(tuple(words[j : j + 10])):
            hit |= set(range(j, j + 10))
            held |= own
    assert n == len(words) and {k for a, b in spans for k in range(a, b)} == hit and items == sorted(held) and len(items) == 2000
    assert took < 1


def roots_of(fps, pairs):
    root = {int(x): int(x) for x in fps}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in pairs:
        a, b = find(int(a)), find(int(b))
        root[max(a, b)] = min(a, b)
    return [find(int(x)) for x in fps]


def test_long_runs_of_fingerprints_are_cut(monkeypatch):
    r = np.random.default_rng(5)
    chain = [r.integers(0, 1 << 40, dtype=np.uint64)]
    for _ in range(20_000):
        chain.append(chain[-1] ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 40, int(r.integers(1, 5)), dtype=np.uint64)))
    chain = np.unique(np.array(chain, np.uint64))
    began = time.perf_counter()
    links = simhash.links_of_runs(np.zeros(len(chain), np.int64), chain.view(np.int64), 4).view(np.uint64)
    assert time.perf_counter() - began < 30
    assert (np.bitwise_count(links[:, 0] ^ links[:, 1]) <= 4).all() and len(set(roots_of(chain, links))) == 1
    monkeypatch.setattr(simhash, "LONG", 20)
    for bits, n in ((9, 120), (14, 300), (40, 300)):
        own = np.unique(r.integers(0, 1 << bits, n, dtype=np.uint64))
        every = [(a, b) for i, a in enumerate(own) for b in own[:i] if int(a ^ b).bit_count() <= 4]
        got = simhash.links_of_runs(np.zeros(len(own), np.int64), own.view(np.int64), 4).view(np.uint64)
        assert roots_of(own, got) == roots_of(own, every)


def best_runs(text):
    """The best coefficient of each license over all runs of lines."""
    lines, out = text.split("\n"), {}
    sets = [(n, set(licenses.bigrams(t).tolist())) for n, t in licenses.TEMPLATES]
    for a in range(len(lines)):
        for b in range(a, len(lines)):
            own = set(licenses.bigrams("\n".join(lines[a : b + 1])).tolist())
            for n, s in sets:
                out[n] = max(out.get(n, 0.0), 2 * len(own & s) / (len(own) + len(s)))
    return out


@pytest.mark.parametrize("times", [0, 1, 17, 18, 30])
def test_licenses_with_a_line_that_repeats(spark, times):
    words = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 200).split()
    lines = [" ".join(words[k * len(words) // 8 : (k + 1) * len(words) // 8]) for k in range(8)]
    text = "\n".join(lines[:4] + [lines[3]] * times + lines[4:])
    (got,) = licenses.find_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert got.license == "MIT" and got.dice == pytest.approx(best_runs(text)["MIT"]) and got.dice > 0.95


def test_licenses_over_repeated_lines_against_brute_force(spark):
    r = np.random.default_rng(3)
    parts = [p for _, t in licenses.TEMPLATES for p in re.split(r"(?<=[.,]) ", t) if p.strip()]
    texts = []
    for i in range(40):
        own = [parts[k] for k in r.integers(0, len(parts), 3)] + re.split(r"(?<=[.,]) ", licenses.TEMPLATES[i % len(licenses.TEMPLATES)][1])
        texts.append("\n".join(x for p in own for x in [p] * int(r.choice([1, 1, 1, 2, 25])) + (["other words", ""] if r.random() < 0.1 else []))[:4000])
    rows = licenses.find_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sum(x.license is not None for x in rows) > 20
    for x in rows:
        best = max(best_runs(x.text).values())
        assert x.dice == pytest.approx(best if best >= licenses.THRESHOLD else 0.0)


def test_licenses_behind_many_repeats(spark):
    words = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 200).split()
    lines = [" ".join(words[k * len(words) // 8 : (k + 1) * len(words) // 8]) for k in range(8)]
    began = time.monotonic()
    (got,) = licenses.find_licenses(spark.createDataFrame([(1, "\n".join(lines[:4] + [lines[3]] * 20_000 + lines[4:]))], "doc_id long, text string")).collect()
    assert got.license == "MIT" and got.dice > 0.95 and time.monotonic() - began < 30


PRIVATE = ["row", "site", "lines", "kept", "key", "id", "content", "fp", "__node", "__of", "__id", "__t", "__words", "__row", "__lang", "__text", "__key", "in0", "text_", "h", "r"]


def test_columns_of_any_name_are_kept(spark):
    some = [(i, f"a b c d e f {i} MENU\nline {i % 2}", "en", "s", *[i] * len(PRIVATE)) for i in range(8)]
    df = spark.createDataFrame(some, ["doc_id", "text", "lang", "source", *PRIVATE])
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    full = {
        "op2": bpe.encode_texts(df), "op3": langid.identify(df, None), "op4": simhash.keep_one(df), "near": neardup.keep_one(df), "op5": linededup.drop_boilerplate(df),
        "op6": quality.judge(df), "op8": toxicity.drop_toxic(df, None), "op8s": toxicity.score(df, None), "op9": winnow.find_spans(df, bench), "op9d": winnow.decontaminate(df, bench), "op10": licenses.find_licenses(df),
    }
    for name, out in full.items():
        own = [c for c in PRIVATE if not (name == "op6" and c == "kept")]
        rows = out.collect()
        assert rows and all(r[c] == r.doc_id for r in rows for c in own), name
    for out in (simhash.near_duplicates(df), substrings.remove_repeats(df), lm.score(df, F.col("key") > 2)):
        assert out.count() == 8


def test_long_pages_take_time_in_proportion(spark):
    began = time.monotonic()
    df = spark.createDataFrame([(i, "\n".join(["MENU", *(f"line {i} {j}" for j in range(200_000))]), "s") for i in range(6)], "doc_id long, text string, source string")
    assert {r.n_dropped for r in linededup.drop_boilerplate(df).select("n_dropped").collect()} == {1}
    same = spark.createDataFrame([(1, "Released under the MIT License.\n" * 20_000)], "doc_id long, text string")
    got = licenses.find_licenses(same, keep=["doc_id"]).first()
    assert got.license == "MIT" and got.n_matches >= 20_000
    assert time.monotonic() - began < 150


def test_substrings_of_a_very_long_text(spark):
    r = np.random.default_rng(6)
    text = " ".join(f"w{x}" for x in r.integers(0, 1 << 40, 120_000))
    assert len(text) > 1 << 20
    part = text[(1 << 20) - 300 : (1 << 20) + 300]  # over the border of two pieces
    df = spark.createDataFrame([(1, text), (2, "x " + part + " y"), (3, text[50:380])], "doc_id long, text string")
    got = {x.doc_id: (x.n_removed, x.n_spans, x.n_shared, x.removed_spans) for x in substrings.remove_repeats(df).collect()}
    assert got[1][:3] == (600, 1, 930) and got[1][3][0].start == (1 << 20) - 300 and got[2][:3] == (600, 1, 600) and got[3][:3] == (0, 0, 330)


def near_texts(texts):
    """The smallest id of each group of texts (by id) with five-word similarity of 0.8 or more."""
    sets = {}
    for i, t in texts.items():
        w = low(t).split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i in sorted(texts):
        common = Counter(j for x in sets[i] for j in holders[x])
        for j, n in common.items():
            if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for x in sets[i]:
            holders[x].append(i)
    return {find(i) for i in texts}


def test_pipeline_against_its_stages_by_hand(spark):
    import corpus_pipeline
    from tidemark.llm import queries

    assert "op9_winnow" in queries.queries()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()}
    pages, seen = Counter(r.source for r in rows.values()), Counter()
    for r in rows.values():
        seen.update({(r.source, x) for x in r.text.split("\n") if re.search("[^ \t-\r]", x)})
    often = {k for k, n in seen.items() if n >= linededup.MIN_PAGES and n > linededup.RATIO * pages[k[0]]}
    texts = {d: "\n".join(x for x in r.text.split("\n") if (r.source, x) not in often) for d, r in rows.items()}
    left = {d for d in near_texts(texts) if not hits(texts[d], bench)[1]}
    out = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    coder = bpe.WordBpe(open(bpe.default_vocabulary()).read())
    assert out == {d: hashlib.sha256(" ".join(map(str, coder.encode(texts[d]))).encode()).hexdigest() for d in left}


def test_pipeline_takes_odd_rows(spark, tmp_path):
    import corpus_pipeline

    shape = "doc_id long, text string, lang string, source string, n_chars long, row string, id long"
    texts = [(None, "one two three four five six"), (None, "other words stand in this text"), (1, None), (2, ""), (3, "one two three four five six"), (3, "a third text of id three with words"), (3, "a third text of id three with words"), (4, LONG)]
    spark.createDataFrame([(i, t, None, None, None, "r", 7) for i, t in texts], shape).write.parquet(f"{tmp_path}/documents.parquet")
    for name, kind in (("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert key(r.doc_id for r in got) == key([None, 1, 3, 3, 4])
    spark.createDataFrame([], shape).write.parquet(f"{tmp_path}/none/documents.parquet")
    for name, kind in (("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
