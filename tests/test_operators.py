"""Operators on small fixtures, and against plain loops on random ones."""

from __future__ import annotations

import json
import random
import time
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import setting, truthy
from tidemark.functions import text
from tidemark.functions.numeric import even, exact_round, fixed
from tidemark.operators import captions, debug, layout, scoring, selection, series, tracking, windows
from tidemark.plans import render
from tidemark.sources import ingest, jobs, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


SEGMENTS = "job_id string, seg_idx int, start_s double, end_s double, text string"


def contiguous(spark):
    return spark.createDataFrame([("a", i, 10.0 * i, 10.0 * i + 10, f"s{i}.") for i in range(6)], SEGMENTS)


def test_windows_of_ten_second_segments(spark):
    got = {(r.start_s, r.end_s) for r in windows.enumerate_windows(contiguous(spark)).collect()}
    assert got == {(0, 20), (0, 30), (0, 40), (10, 30), (10, 40), (10, 50), (20, 40), (20, 50), (20, 60), (30, 50), (30, 60), (40, 60)}
    found = [(r.id, r.start_s, r.end_s) for r in windows.candidates(contiguous(spark)).orderBy("id").collect()]
    assert found == [(0, 0, 40), (1, 10, 50), (2, 20, 60), (3, 30, 60), (4, 40, 60)]


def test_windows_against_a_loop(spark):
    r = random.Random(5)
    rows, expected = [], set()
    for job in "abcdef":
        t, own = 0.0, []
        for i in range(60):
            length = r.choice([1, 3, 8, 15, 25, 61])
            own.append((t, t + length))
            t += length + r.choice([0, 0, 5])
        rows += [(job, i, s, e, f"t{i}") for i, (s, e) in enumerate(own)]
        for i, (s, _) in enumerate(own):
            for j in range(i, len(own)):
                d = own[j][1] - s
                if d > 60:
                    break
                if d >= 20:
                    expected.add((job, i, j))
                    if d >= 40:
                        break
    df = spark.createDataFrame(rows, SEGMENTS)
    assert {(x.job_id, x.i, x.j) for x in windows.enumerate_windows(df).collect()} == expected
    assert {(x.job_id, x.i, x.j) for x in windows.binned_windows(df).collect()} == expected
    off = df.withColumns({"start_s": F.col("start_s") * 1.0003 + 0.005, "end_s": F.col("end_s") * 1.0003 + 0.005})
    want = sorted(map(tuple, windows.thin(windows.enumerate_windows(off)).collect()))
    assert sorted(map(tuple, windows.thin_windows(off).collect())) == want
    assert sorted(map(tuple, windows.thin_windows(off, texts=False).drop("text").collect())) == [x[:-1] for x in want]


@pytest.mark.parametrize("n", [40, 41, 164, 368])
def test_even_choice_in_doubles(spark, n):
    df = spark.createDataFrame([("a", 10.0 * i, 10.0 * i + 30, "") for i in range(n)], "job_id string, start_s double, end_s double, text string")
    got = [int(r.start_s // 10) for r in windows.number(df).orderBy("id").collect()]
    assert got == (list(range(n)) if n <= 40 else [int(k * (n / 40)) for k in range(40)])


def greedy(rows, most=None):
    chosen = []
    for w in sorted(rows, key=lambda w: (-w[3], w[0])):
        if not any(w[1] < o[2] and o[1] < w[2] for o in chosen):
            chosen.append(w)
            if most and len(chosen) == most:
                break
    return chosen


def test_selection_in_rounds_is_the_fold(spark):
    r = random.Random(4)
    shape = "job_id string, id int, start_s double, end_s double, text string, score double"
    rows = [(job, i, s := r.choice([r.uniform(0, 900), float(r.randrange(900))]), s + r.choice([0.0, 5.0, 20.0, 60.0, 200.0]), f"t{i}", float(r.randrange(30))) for job in "abc" for i in range(r.randrange(80, 200))]
    df = spark.createDataFrame(rows, shape)
    got = {(x.job_id, x.id) for x in selection.independent(df).collect()}
    assert got == {(j, w[0]) for j in "abc" for w in greedy([x[1:4] + (x[5],) for x in rows if x[0] == j])}
    both = [sorted(map(tuple, f(df).select("job_id", "clip_idx", "id", "start_s", "end_s", "text", "score").collect())) for f in (selection.select_best, selection.select_spread)]
    assert both[0] == both[1] and len(both[0]) == 15
    assert selection.select_spread(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        selection.independent(spark.createDataFrame([("a", 1, 0.0, 1.0, "", 1.0), ("a", 1, 90.0, 99.0, "", 1.0), ("a", 1, 45.0, 99.0, "", 1.0)], shape)).count()


def test_a_large_job_is_dealt_over_tasks(spark):
    n = 100_000
    df = spark.range(n).select(F.lit("a").alias("job_id"), F.col("id").cast("int").alias("id"), (F.col("id") * 0.7).alias("start_s"), (F.col("id") * 0.7 + 20 + F.col("id") % 40).alias("end_s"), F.lit("").alias("text"), (F.xxhash64("id") % 1000).cast("double").alias("score"))
    rows = [tuple(x) for x in df.select("id", "start_s", "end_s", "score").collect()]
    end, want = [], set()
    from bisect import bisect_left, insort

    for i, s, e, x in sorted(rows, key=lambda w: (-w[3], w[0])):  # chosen windows do not overlap, so neighbours decide
        k = bisect_left(end, (s, e))
        if (k == 0 or end[k - 1][1] <= s) and (k == len(end) or end[k][0] >= e):
            insort(end, (s, e))
            want.add(i)
    found = selection.independent(df)
    assert {x.id for x in found.collect()} == want


def test_selection(spark):
    shape = "job_id string, id int, start_s double, end_s double, text string, score double"
    spans = [(0.0, 40.0, 5.0), (10.0, 50.0, 9.0), (20.0, 60.0, 5.0), (30.0, 60.0, 7.0), (40.0, 60.0, 7.0)]
    df = spark.createDataFrame([("a", i, s, e, "", x) for i, (s, e, x) in enumerate(spans)], shape)
    assert [(r.start_s, r.end_s) for r in selection.select_best(df).collect()] == [(10, 50)]
    touching = spark.createDataFrame([("a", 0, 0.0, 30.0, "", 1.0), ("a", 1, 30.0, 60.0, "", 1.0)], shape)
    assert selection.select_best(touching).count() == 2
    many = spark.createDataFrame([("a", i, 60.0 * i, 60.0 * i + 30, "", float(i)) for i in range(9)], shape)
    assert [r.id for r in selection.select_best(many).orderBy("clip_idx").collect()] == [4, 5, 6, 7, 8]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ('[{"id":0,"score":7},{"id":"1","score":"3"},5]', {0: 7, 1: 3}),
        ('{"scores":[{"id":0,"score":7}]}', {0: 7}),
        ('{"z":[{"id":1,"score":2}],"a":[{"id":0,"score":7}]}', {1: 2}),
        ('{"0":7,"1":3}', {0: 7, 1: 3}),
        ('Sure: [{"id":0,"score":7}]\n ok', {0: 7}),
        ('{"id":0,"score":7}', {}),
        ('[{"id":0,"score":1},{"id":0,"score":2}]', {0: 2}),
        ('[{"id":3.7,"score":1},{"id":"3.7","score":1}]', {3: 1}),
        ('[{"id":0,"score":NaN}]', {0: 0}),
        ("nothing", {}),
        ("", {}),
        (None, {}),
    ],
)
def test_replies(raw, expected):
    assert scoring.read_reply(raw) == expected


def test_native_replies_are_those_of_the_reader(spark):
    r = random.Random(12)
    number = lambda: r.choice([3, 7.5, "4", " 5 ", "6.25", -2, 1e3, "x", "", None, True, [1], {"a": 1}, "1_0", "nan", 12345678901234567890, 0.1])
    item = lambda: r.choice([{"id": number(), "score": number()}, {"id": r.randrange(4), "score": r.randrange(9)}, {"id": r.randrange(4)}, {"score": 1, "x": 2}, 5, None, "t", [1]])
    raws = []
    for _ in range(400):
        items = [item() for _ in range(r.randrange(6))]
        made = r.choice([items, {"scores": items}, {"z": items, "a": [item()]}, {"n": 1, "list": items}, {str(r.choice([1, 2, "a", "01", -3])): number() for _ in range(3)}, 5, "text"])
        raw = json.dumps(made, indent=r.choice([None, 1]))
        raws.append(r.choice(["", "Sure: ", "the list ", "[x] ", "\n"]) + raw + r.choice(["", " ok", "\nbye", "]"]))
    raws += ['{"a":[{"id":1,"score":1}],"a":[{"id":1,"score":2}]}', '[{"id":1,"id":2,"score":2}]', '[{"id":0,"score":NaN}]', "", None, "nothing", "[", "S [1] [2]", '{"id":0,"score":7}']
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate(raws)], "job_id string, raw string")
    got = {}
    for x in scoring.parse_replies(df).collect():
        got.setdefault(x.job_id, {})[x.id] = x.score
    for i, raw in enumerate(raws):
        want = {k: v for k, v in (scoring.read_reply(raw) or {}).items() if abs(k) < 2**63}
        assert got.get(str(i), {}) == want, raw
    usual = ['[{"id":0,"score":7},{"id":"1","score":"3.5"},5]', '{"scores":[{"id":0,"score":7.25}],"model":"m"}', '{"0":7,"1":3}', 'Sure: [{"id":0,"score":7}] ok', '[{"id":0,"score":1},{"id":0,"score":2}]', "Sorry.", "[]"]
    native = spark.createDataFrame([(x,) for x in usual], "raw string").select("raw", scoring.read_native(F.col("raw")).alias("x")).collect()
    assert all({k: v for k, v in x.x} == scoring.read_reply(x.raw) for x in native)


def test_a_reply_with_an_infinite_id_is_unusable():
    assert scoring.read_reply('[{"id":Infinity,"score":1},{"id":0,"score":1}]') is None


def test_heuristic(spark):
    df = spark.createDataFrame([("a", 0, 0.0, 40.0, " ".join(["w"] * 99 + ["w."]))], "job_id string, id int, start_s double, end_s double, text string")
    assert scoring.heuristic(df).first()["score"] == 10.0


def test_captions(spark):
    words = spark.createDataFrame([("a", i, 50 * i, 50 * i + 40, f"w{i}") for i in range(6)], "job_id string, word_idx int, start_cs long, end_cs long, word string")
    clips = spark.createDataFrame([("a", 0, 0, 300), ("a", 1, 40, 50)], "job_id string, clip_idx int, start_cs long, end_cs long")
    parts = captions.chunks(captions.clip_words(words, clips)).orderBy("chunk_idx").collect()
    assert [(r.text, r.from_cs, r.to_cs) for r in parts] == [("w0 w1 w2 w3", 0, 190), ("w4 w5", 200, 290)]


def test_captions_against_a_loop(spark):
    r = random.Random(2)
    rows, expected = [], []
    for job in "abcd":
        t, chunk = 0, []
        for i in range(80):
            t += r.choice([0, 20, 100, 101, 300])
            word = r.choice(["a", "b,", "c.", "d!"])
            rows.append((job, 0, i, t, t + 30, word))
            if chunk and (len(chunk) >= 4 or t - chunk[-1][1] > 100):
                expected.append((job, " ".join(x[0] for x in chunk)))
                chunk = []
            chunk.append((word, t + 30))
            if word[-1] in ".!?,":
                expected.append((job, " ".join(x[0] for x in chunk)))
                chunk = []
            t += 30
        if chunk:
            expected.append((job, " ".join(x[0] for x in chunk)))
    df = spark.createDataFrame(rows, "job_id string, clip_idx int, word_idx int, from_cs long, to_cs long, word string")
    assert [(x.job_id, x.text) for x in captions.chunks(df).orderBy("job_id", "chunk_idx").collect()] == expected


def boxes(tracks):
    return [("c", t, s, cx - 40.0, 260.0, 80.0, 80.0) for t, (cx, at) in enumerate(tracks) for s in at]


ALL = range(100)
CASES = {
    "two present": ([(330, ALL), (950, ALL)], "TWO_PERSON", [0, 1]),
    "right one first": ([(950, ALL), (330, ALL)], "TWO_PERSON", [1, 0]),
    "turning away": ([(330, ALL), (950, [i for i in ALL if i % 20 < 9])], "TWO_PERSON", [0, 1]),
    "spanning, rarer": ([(330, ALL), (950, [i for i in ALL if i % 10 < 3])], "TWO_PERSON", [0, 1]),
    "walk-in": ([(330, ALL), (950, range(40))], "SINGLE_PERSON", [0]),
    "sporadic": ([(330, ALL), (950, [i for i in ALL if i % 10 == 0])], "SINGLE_PERSON", [0]),
    "too close": ([(600, ALL), (700, ALL)], "SINGLE_PERSON", [0]),
    "solo": ([(640, ALL)], "SINGLE_PERSON", [0]),
    "rare": ([(640, range(10))], "CENTER_CROP", []),
    "persistent but seldom": ([(640, [*range(26), 90])], "CENTER_CROP", []),
    "a third is ignored": ([(330, ALL), (400, ALL), (950, range(95))], "SINGLE_PERSON", [0]),
}


@pytest.mark.parametrize("name", CASES)
def test_layout(spark, name):
    tracks, expected, shown = CASES[name]
    df = spark.createDataFrame(boxes(tracks), "clip_id string, track_id int, sample_idx int, x double, y double, w double, h double")
    clips = spark.createDataFrame([("c", 1280), ("none", 1280)], "clip_id string, width int")
    plan = {r.clip_id: r for r in layout.note(layout.plan_layout(layout.track_stats(df, 100), clips).join(clips.select("clip_id"), "clip_id"), 100).collect()}
    assert (plan["c"].layout, plan["c"].reason == "too close") == (expected, name in ("too close", "a third is ignored"))
    full = {r.clip_id: r.tracks for r in layout.plan_layout(layout.track_stats(df, 100), clips).collect()}
    assert full["c"] == shown and plan["none"].layout == "CENTER_CROP"
    if name == "turning away":
        assert plan["c"].note == "two persistent faces (coverage 100% / 45%, ratio 0.45, span 89%, gap 6s, separation 48%, samples 100)"
    if name == "rare":
        assert plan["c"].note == "faces too sporadic (best coverage 10%, samples 100)"
    if name == "sporadic":
        assert plan["c"].note == "one persistent face (coverage 100%, samples 100, second face coverage 10% span 91% separation 48%)"


@pytest.mark.parametrize("name, at", [("two present", None), ("solo", None), ("solo", 300)])
def test_crop_regions(spark, name, at):
    tracks, kind, shown = CASES[name]
    rows = [(c, t, s, x, y + (s if at else 0), w, h) for c, t, s, x, y, w, h in boxes(tracks) if s % 7 or s < 3]
    df = spark.createDataFrame(rows, "clip_id string, track_id int, sample_idx int, x double, y double, w double, h double")
    clips = spark.createDataFrame([("c", 1280, 720)], "clip_id string, width int, height int")
    plan = layout.plan_layout(layout.track_stats(df, 100), clips)
    (row,) = layout.crop_regions(plan, df, clips, 100).collect()
    assert row.layout == kind and [r.track_id for r in row.regions] == shown
    if kind == "SINGLE_PERSON":
        (r,) = row.regions
        centre = [300 + (s if at else 0) for s in range(100)]
        ys = np.interp(range(100), [s for s in range(100) if s % 7 or s < 3], [centre[s] for s in range(100) if s % 7 or s < 3])
        assert (r.w, r.h) == (404, 720) and {k.v for k in r.x_keys} == {640 - 202.0}
        assert [(k.t, k.v) for k in r.y_keys] == [(0.0, round(float(np.clip(np.median(ys) - 288, 0, 0)), 1))]
    else:
        h = round(np.clip(80 * 3.2, 324, 720) / 2) * 2
        w = round(324 * 9 / 8 / 2) * 2
        assert [(r.w, r.h) for r in row.regions] == [(w, h)] * 2
        assert [{k.v for k in r.x_keys} for r in row.regions] == [{330 - w / 2}, {950 - w / 2}]
        assert [{k.v for k in r.y_keys} for r in row.regions] == [{round(300 + h * 0.08 - h / 2, 1)}] * 2


def merged(tracks):
    rows = [(t, i, *box) for t, own in enumerate(tracks) for i, box in own.items()]
    track, sample, boxes = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2:] for r in rows])
    whole, pieces = tracking.merge(track, sample, boxes)
    return sorted({(int(t), int(n), int((whole == t).sum())) for t, n in zip(whole, pieces)})


def test_fragments_are_merged():
    a = {i: np.array([290.0, 260, 80, 80]) for i in ALL}
    b = {i: np.array([910.0, 260, 80, 80]) for i in range(30)}
    c = {i: np.array([915.0, 260, 80, 80]) for i in range(70, 100)}
    assert merged([a, b, c]) == [(0, 1, 100), (1, 2, 60)]
    even_odd = [{i: np.array([0.0, 0, 80, 80]) for i in range(k, 20, 2)} for k in (0, 1)]
    assert len(merged(even_odd)) == 1
    same_time = [{i: np.array([x, 260.0, 80, 80]) for i in ALL} for x in (290.0, 320.0)]
    assert len(merged(same_time)) == 2


def test_pairs_on_a_grid_are_all_pairs(monkeypatch):
    r = np.random.default_rng(7)
    for n, m in ((40, 50), (1, 90), (300, 200)):
        boxes = [np.column_stack([r.uniform(-500, 500, (k, 2)), r.uniform(5, 40, (k, 2))]) for k in (n, m)]
        monkeypatch.setattr(tracking, "DENSE", 10**9)
        every = sorted(zip(*(x.tolist() for x in tracking.near_pairs(*boxes, 1.0))))
        monkeypatch.setattr(tracking, "DENSE", 0)
        assert sorted(zip(*(x.tolist() for x in tracking.near_pairs(*boxes, 1.0)))) == every and (every or n == 1)


def test_links_against_a_loop(spark):
    r = random.Random(9)
    rows = [("c", s, d, r.uniform(0, 300), 20.0, r.choice([20.0, 40.0]), 30.0, r.choice([0.7, 0.9])) for s in range(80) for d in range(r.randrange(4)) if s % 30 < 12]
    tracks = []  # [boxes by sample, last sample]
    by_sample = {}
    for row in rows:
        by_sample.setdefault(row[1], []).append(row)
    for s in sorted(by_sample):
        found = sorted(by_sample[s], key=lambda x: (-x[7], x[2]))
        pairs = []
        for t, (own, last) in enumerate(tracks):
            if s - last <= 16:
                b = own[last]
                for i, d in enumerate(found):
                    dist = np.hypot(d[3] + d[5] / 2 - (b[0] + b[2] / 2), 0) / max(b[2], d[5])
                    if dist <= 1:
                        pairs.append((dist, t, i))
        used_t, used_d = set(), set()
        for _, t, i in sorted(pairs):
            if t not in used_t and i not in used_d:
                used_t.add(t)
                used_d.add(i)
                tracks[t][0][s] = found[i][3:7]
                tracks[t][1] = s
        for i, d in enumerate(found):
            if i not in used_d:
                tracks.append([{s: d[3:7]}, s])
    df = spark.createDataFrame(rows, "clip_id string, sample_idx int, det_idx int, x double, y double, w double, h double, score double")
    got = {(x.track_id, x.sample_idx, x.x) for x in tracking.link_tracks(df).collect()}
    assert got == {(t, s, b[0]) for t, (own, _) in enumerate(tracks) for s, b in own.items()}


def test_series(spark):
    array = lambda *x: F.array(*[F.lit(float(a)) for a in x])
    assert one(spark, series.dead_zone(array(0, 3, 6, 7, 20), F.lit(5.0))) == [0, 0, 6, 6, 20]
    assert one(spark, series.moving_average(array(0, 3, 6), 1)) == [1, 3, 5]
    assert one(spark, series.moving_average(array(4), 1)) == [4]
    points = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(float(v)).alias("v")) for s, v in ((1, 2), (3, 4))])
    assert one(spark, series.fill(points, 5)) == [2, 2, 3, 4, 4]
    assert [tuple(k) for k in one(spark, series.keyframes(array(0, 0.1, 0.2, 5, 5)))] == [(0.0, 0.0), (1.0, 0.2), (1.5, 5.0), (2.0, 5.0)]
    assert one(spark, series.debug_tiles(F.lit(100))) == [int(x) for x in np.linspace(0, 99, 12)]


def test_long_series_take_linear_time(spark):
    n = 100_000
    r = np.random.default_rng(1)
    v = np.cumsum(r.normal(size=n))
    known = np.sort(r.choice(n, n // 3, replace=False))
    points = spark.createDataFrame([([(int(i), float(v[i])) for i in known],)], "points array<struct<s:int,v:double>>")
    began = time.perf_counter()
    filled = points.select(series.fill(F.col("points"), n).alias("v"))
    row = filled.select(series.dead_zone(F.col("v"), F.lit(3.0)).alias("dead"), series.keyframes(series.dead_zone(F.col("v"), F.lit(3.0))).alias("keys"), "v").first()
    assert np.allclose(row["v"], np.interp(np.arange(n), known, v[known]))
    anchor, want = row["v"][0], []
    for x in row["v"]:
        anchor = x if abs(x - anchor) > 3 else anchor
        want.append(anchor)
    assert row["dead"] == want
    keys = spark.createDataFrame([([tuple(k) for k in row["keys"]],)], "keys array<struct<t:double,v:double>>")
    times = F.sequence(F.lit(0), F.lit(n - 1))
    found = keys.select(F.transform(times, lambda i: series.value_at(F.col("keys"), i / 2 + 0.125)).alias("x")).first()["x"]
    assert np.allclose(found, np.interp(np.arange(n) / 2 + 0.125, [k.t for k in row["keys"]], [k.v for k in row["keys"]]))
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize("points, n", [([(1, 2.0), (3, 4.0)], 5), ([(0, 1.0)], 3), ([(4, 1.0)], 3), ([(-2, 0.0), (2, 4.0), (9, 8.0)], 6), ([(1, 1.0), (2, 5.0)], 0), ([], 2)])
def test_fill_as_interpolation(spark, points, n):
    df = spark.createDataFrame([(points,)], "points array<struct<s:int,v:double>>")
    got = df.select(series.fill(F.col("points"), n).alias("x")).first()["x"]
    assert got == (np.interp(range(n), *zip(*points)).tolist() if points else [None] * n)


def test_value_at_keyframes(spark):
    keys = F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(v)).alias("v")) for t, v in ((0, 0), (1, 10), (4, 40))])
    assert [one(spark, series.value_at(keys, F.lit(float(t)))) for t in (-1, 0, 0.5, 1, 2.5, 4, 9)] == [0, 0, 5, 10, 25, 40, 40]
    assert one(spark, series.value_at(F.slice(keys, F.lit(1), F.lit(0)), F.lit(1.0))) is None


def test_rounding(spark):
    assert [one(spark, even(F.lit(x))) for x in (405.0, 364.5)] == [404, 364]
    r = random.Random(11)
    values = [0.0, 1.005, 2.675, 0.125, 0.375, 2.5, 3.5, 0.5, 1e-9, 1e-300, 5e-324, 0.05, 0.15, 0.25, 0.35, 999.9995, 0.9999999, 1234567.0005, 2.0**52 - 0.5, 2.0**52 + 1, 9.0e15, 1e300, 4503599627370495.5]
    values += [r.uniform(0, 10 ** r.randrange(-6, 12)) for _ in range(400)] + [r.randrange(10**6) / 2 ** r.randrange(1, 20) for _ in range(400)] + [r.randrange(10**7) / 1000 + 0.0005 for _ in range(200)]
    values += [-x for x in values]
    df = spark.createDataFrame([(x,) for x in [*values, None, float("nan"), float("inf")]], "x double")
    digits = (0, 1, 2, 3, 6)
    got = df.select("x", *[exact_round(F.col("x"), d).alias(f"r{d}") for d in digits], *[fixed(F.col("x"), d).alias(f"f{d}") for d in digits]).collect()
    for row in got:
        for d in digits:
            if row.x is None or row.x != row.x or row.x == float("inf"):
                assert row[f"f{d}"] is None and repr(row[f"r{d}"]) == repr(row.x)
            else:
                assert row[f"r{d}"] == round(row.x, d), (row.x, d)
                assert row[f"f{d}"] == (f"{row.x:.{d}f}" if abs(row.x) < 2**63 else None) or row.x == 0, (row.x, d)
    plan = df.select(exact_round(F.col("x"), 2), fixed(F.col("x"), 2))._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_text(spark):
    lit = F.lit
    assert [one(spark, text.caption_time(lit(x))) for x in (-5, 0, 190, 366001)] == ["0:00:00.00", "0:00:00.00", "0:00:01.90", "1:01:00.01"]
    assert one(spark, text.caption_escape(lit("a\\{b}"))) == "a\\\\(b)"
    assert one(spark, text.filter_path(lit("C:\\a'b"))) == "C\\:/a\\'b"
    assert [one(spark, text.encoder_major(lit(f"ffmpeg version {x}"))) for x in ("9.0.2-full", "6.1.1-3", "n7.1", "N-127233")] == [9, 6, 7, None]
    assert [one(spark, text.filter_option(lit(x).cast("int"))) for x in (6, 7, None)] == ["-filter_complex_script", "-/filter_complex", "-/filter_complex"]
    assert [one(spark, text.count_words(lit(x))) for x in ("", " \u00a0", "a\u00a0b  c ")] == [0, 0, 3]
    assert [one(spark, text.is_public_file(lit(x))) for x in ("clip_1.mp4", "clip_1.mp4\n", "xclip_1.mp4")] == [True, False, False]


def test_paths_below_a_root(spark):
    lit = F.lit
    cases = {"a/b": True, "a/../../b": False, "../out/a": True, ".": False, "./.": False, "a/./b/..": True, "/etc/passwd": False, "/srv/out/x": True, "/srv/outside/x": False, "a//b": True, "a/..": False}
    assert {p: one(spark, text.under(lit("/srv/out"), lit(p))) for p in cases} == cases
    served = lambda folder, name: one(spark, text.is_served(lit("/srv/out"), lit(folder), lit(name)))
    assert served("job", "clip_1.mp4") and not served("..", "clip_1.mp4") and not served("job/../..", "clip_1.mp4") and not served("job", "source.mp4") and not served("job", "../clip_1.mp4")


def test_filter_text(spark):
    keys = F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(v)).alias("v")) for t, v in ((0, 100), (1, 100), (2, 140), (3, 140))])
    expected = "if(lt(t,1.000),(100.0+(0.0)*(t-0.000)/1.000),if(lt(t,2.000),(100.0+(40.0)*(t-1.000)/1.000),if(lt(t,3.000),(140.0+(0.0)*(t-2.000)/1.000),140.0)))"
    assert one(spark, render.expression(keys)) == expected
    region = F.struct(F.lit(400).alias("w"), F.lit(356).alias("h"), keys.alias("x_keys"), F.slice(keys, F.lit(1), F.lit(1)).alias("y_keys"))
    graph = one(spark, render.filter_graph(F.lit("TWO_PERSON"), F.array(region, region), F.lit("a.ass")))
    assert "vstack=inputs=2,ass='a.ass'[v]" in graph and f"crop=400:356:x='{expected}':y='100.0'" in graph
    assert one(spark, render.filter_graph(F.lit("CENTER_CROP"), F.array(region), F.lit(None).cast("string"))) is None


def test_transcripts_and_sinks(spark, tmp_path):
    folder = tmp_path / "in" / "job7"
    folder.mkdir(parents=True)
    (folder / "transcript.json").write_text('{"language":"en",\n"segments":[{"start":0,"end":1,"text":" hi "},{"start":1,"end":2,"text":" \u00a0"}],"words":[{"start":0,"end":1,"word":" hi"}]}')
    read = ingest.read_transcripts(spark, str(tmp_path / "in" / "*" / "transcript.json"))
    assert [tuple(r) for r in ingest.transcript_segments(read).collect()] == [("job7", 0, 0.0, 1.0, "hi")]
    assert [tuple(r) for r in ingest.transcript_words(read).collect()] == [("job7", 0, 0.0, 1.0, "hi")]
    lines = spark.createDataFrame([("j", 0, 1, "b"), ("j", 0, 0, "a")], "job_id string, clip_idx int, chunk_idx int, line string")
    files = sinks.caption_files(lines, split=True)
    assert files.first()["value"].endswith("Effect, Text\na\nb\n") and ",5,60,60," in files.first()["value"]
    sinks.write_text(files, str(tmp_path / "out"), ["job_id", "clip_idx"])
    sinks.write_json(lines, str(tmp_path / "json"), ["job_id"])
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    assert ingest.media_files(spark, str(folder)).count() == 1


def test_layout_record(spark):
    tracks, _, _ = CASES["turning away"]
    df = spark.createDataFrame(boxes(tracks), "clip_id string, track_id int, sample_idx int, x double, y double, w double, h double")
    clips = spark.createDataFrame([("c", 1280), ("none", 1280)], "clip_id string, width int")
    rows = {r["clip_id"]: json.loads(r["json"]) for r in sinks.as_json(layout.metrics(layout.track_stats(df, 100), clips, 100), "clip_id").collect()}
    m = rows["c"]
    assert (m["samples"], m["sample_fps"], m["clip_seconds"], m["strength_ratio"], m["separation"], m["second_span"], m["second_longest_gap_s"]) == (100, 2.0, 50.0, 0.45, 0.484, 0.89, 5.5)
    assert m["thresholds"] == {"persistent_coverage": 0.4, "span_coverage": 0.25, "span_frac": 0.7, "single_min_coverage": 0.3, "dominance_ratio": 0.5, "min_separation_frac": 0.15}
    assert m["tracks"][0] == {"id": 0, "coverage": 1.0, "span": 1.0, "longest_gap_s": 0.0, "fragments": 1, "median_box": [290.0, 260.0, 80.0, 80.0]}
    assert rows["none"]["tracks"] == [] and "separation" not in rows["none"]


def test_debug_sheet(spark):
    tracks, kind, shown = CASES["two present"]
    df = spark.createDataFrame(boxes(tracks), "clip_id string, track_id int, sample_idx int, x double, y double, w double, h double")
    clips = spark.createDataFrame([("c", 1280, 720), ("none", 1280, 720)], "clip_id string, width int, height int")
    stats = layout.track_stats(df, 100)
    plan = layout.note(layout.plan_layout(stats, clips), 100)
    regions = layout.crop_regions(plan, df, clips, 100)
    tiles = debug.tiles(clips, 100)
    own = [r for r in tiles.where("clip_id = 'c'").orderBy("tile").collect()]
    assert [r.sample_idx for r in own] == [int(x) for x in np.linspace(0, 99, 12)] and (own[4].row, own[4].column, own[1].caption) == (1, 1, "t=4.5s")
    found = debug.track_boxes(tiles, df, stats, scale=2.0).where("tile = 0").orderBy("track_id").collect()
    assert [(r.x1, r.y1, r.x2, r.y2, r.label, r.label_y) for r in found] == [(145, 130, 185, 170, "#0 100%", 126), (455, 130, 495, 170, "#1 100%", 126)]
    (first,) = regions.collect()
    drawn = debug.region_boxes(tiles, regions).where("tile = 3").orderBy("place").collect()
    assert [(r.x1, r.y1, r.x2 - r.x1, r.y2 - r.y1) for r in drawn] == [(int(r.x_keys[0].v), int(r.y_keys[0].v), r.w, r.h) for r in first.regions]
    told = {r.clip_id: json.loads(r.json) for r in debug.summary(plan, layout.metrics(stats, clips, 100), regions, "stub", 100).collect()}
    assert told["none"]["regions"] == [] and told["none"]["layout"] == "CENTER_CROP" and [r["track"] for r in told["c"]["regions"]] == [0, 1]
    assert told["c"]["classification"]["thresholds"]["dominance_ratio"] == 0.5 and (told["c"]["detector"], told["c"]["samples"]) == ("stub", 100)
    line = plan.where("clip_id = 'none'").select(debug.title(F.col("layout"), F.col("note"), F.lit("stub"), 100).alias("x")).first()["x"]
    assert line == "CENTER_CROP | no frames or no faces detected | detector=stub | samples=100"


def test_notes(spark):
    shape = "job_id string, model string, language string, duration_seconds double"
    rows = spark.createDataFrame([("a", "small", "en", 61.5), ("b", None, None, None)], shape)
    assert {r.job_id: r.note for r in ingest.transcription_note(rows).collect()} == {"a": "transcribed with whisper small (language en, 62 s)", "b": "transcribed with whisper ? (language ?, 0 s)"}
    cands = spark.createDataFrame([(j, 0, 0.0, 40.0, "a.") for j in "abc"], "job_id string, id int, start_s double, end_s double, text string")
    scores = spark.createDataFrame([("a", 0, 7.0)], "job_id string, id long, score double")
    failed = spark.createDataFrame([("b", "ConnectionError: refused")], "job_id string, error string")
    notes = {r.job_id: r.note for r in scoring.rank(cands, scores, "m", failures=failed).collect()}
    assert notes == {"a": "ranked by m", "b": "Ollama unavailable (ConnectionError); used heuristic ranking", "c": "Ollama unavailable (ValueError); used heuristic ranking"}


def test_probe_grid_and_job_ids(spark):
    probe = spark.createDataFrame([("a", '{"streams":[{"width":1920,"height":1080},{"width":1}]}'), ("b", "{}"), ("c", None)], "job_id string, raw string")
    assert {r.job_id: (r.width, r.height) for r in ingest.probe_size(probe).collect()} == {"a": (1920, 1080), "b": (None, None), "c": (None, None)}
    size = lambda w, h: spark.range(1).select(*ingest.detection_size(F.lit(w), F.lit(h))).first()
    assert [tuple(size(*x)) for x in ((1920, 1080), (641, 480), (333, 250))] == [(640, 360), (640, 478), (332, 248)]
    clips = spark.createDataFrame([("a", 1.0, 3.6), ("none", 1.0, 1.4)], "clip_id string, start_s double, end_s double")
    assert [tuple(r) for r in ingest.sample_grid(clips).orderBy("sample_idx").collect()] == [("a", i, i / 2) for i in range(5)]
    made = jobs.new_jobs(spark.createDataFrame([(" https://youtu.be/x ",), ("https://example.org",)], "url string")).collect()
    assert len(made) == 1 and len(made[0].id) == 12 and made[0].url == "https://youtu.be/x" and made[0].stage == "queued"


def test_segments_within_rows_are_those_of_words(spark):
    r = random.Random(6)
    rows = [(j, t, " ".join(r.choice(["a", "b.", "c!", "d,", "  e"]) for _ in range(r.randrange(30)))) for j in "abc" for t in range(6)] + [("d", 0, ""), ("e", 3, None), ("f", 1, "x")]
    texts = spark.createDataFrame(rows, "job_id string, turn int, text string")
    want = sorted(map(tuple, ingest.sentences(ingest.timeline(texts)).collect()))
    assert sorted(map(tuple, ingest.segments(texts).collect())) == want
    single = texts.where("turn = 0")
    assert sorted(map(tuple, ingest.segments(single, one_turn=True).collect())) == sorted(map(tuple, ingest.sentences(ingest.timeline(single)).collect()))


def test_events_of_two_years_all_count(spark, tmp_path):
    rows = [(i, datetime(2023 + i % 2, 1 + i % 12, 1 + i % 27, 5 * (i % 5)), i % 3, f"k{i % 2}", float(i % 50)) for i in range(300)] + [(999, None, 1, "k", 1.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    first, n = ingest.event_grid(spark, str(tmp_path))
    days = [r[1] for r in rows if r[1]]
    assert first == min(days).date() and n == (max(days).date() - first).days * 2 + max(days).hour // 12 + 1 > 700
    bins = ingest.event_bins(spark, str(tmp_path))
    assert bins.count() == 300 and bins.agg(F.max("sample_idx")).first()[0] == n - 1
    assert sum(r.samples for r in layout.track_stats(ingest.event_boxes(spark, str(tmp_path)), n).collect()) == len({(r[2], r[3], (r[1].date() - first).days * 2 + r[1].hour // 12) for r in rows if r[1]})
    assert tracking.link_tracks(ingest.event_detections(spark, str(tmp_path))).count() == 300
    spark.createDataFrame([], "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(str(tmp_path / "none" / "events.parquet"))
    assert ingest.event_grid(spark, str(tmp_path / "none")) == (None, 0) and ingest.event_bins(spark, str(tmp_path / "none")).count() == 0


def test_settings():
    assert setting("X", "small", {"X": "  "}) == "small" and setting("X", "small", {"X": " m "}) == "m"
    assert [truthy(x) for x in (" Yes", "on", "0", None)] == [True, True, False, False]


def test_filter_graphs_cover_every_clip(spark):
    from tidemark.plans import queries

    sf = "/root/testdata/sf0.001"
    rows = queries.QUERIES["filter_graphs"](spark, sf).collect()
    assert len(rows) == queries.event_clips(spark, sf).count()
    assert all((r.graph is None) == (r.layout == "CENTER_CROP") for r in rows)


def test_tasks_do_not_grow_with_the_input(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "TASK", 1000)
    rows = spark.range(200).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("word " * 20).alias("text"))
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    dealt = ingest.conversations(spark, str(tmp_path))
    sizes = [x["n"] for x in ingest.timeline(dealt).groupBy(F.spark_partition_id()).agg(F.sum(F.length("word")).alias("n")).collect()]
    assert dealt.rdd.getNumPartitions() == 20 and max(sizes) < 4000 and sum(sizes) == 200 * 80
    assert ingest.conversations(spark, str(tmp_path)).count() == 200


def test_windows_of_a_segment_are_sorted_once(spark):
    plan = windows.thin_windows(contiguous(spark), texts=False)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_sort") == 1
    texts = spark.createDataFrame([("a", 0, "one two. three. " * 60)], "job_id string, turn int, text string")
    full, bare = (ingest.segments(texts, one_turn=True, keep_text=k) for k in (True, False))
    assert full.drop("text").collect() == bare.drop("text").collect() and bare.where("text is not null").count() == 0
    thin = [sorted(map(tuple, windows.candidates(ingest.seconds(x), texts=False).collect())) for x in (full, bare)]
    assert thin[0] == thin[1] and thin[0]


def test_spread_selection_without_texts_is_the_same(spark):
    shape = "job_id string, id int, start_s double, end_s double, text string, score double"
    df = spark.createDataFrame([("a", i, 7.0 * i, 7.0 * i + 30, "t", float(i * 5 % 11)) for i in range(40)], shape)
    full, bare = (sorted(map(tuple, selection.select_spread(df, texts=t).drop("text").collect())) for t in (True, False))
    assert full == bare and len(full) == 5
