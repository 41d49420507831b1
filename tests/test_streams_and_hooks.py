"""Streams that are stopped, replayed and out of order; the file sink; hooks for models."""

from __future__ import annotations

import os
import random
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from tidemark.config import Tracking
from tidemark.operators import hooks, tracking
from tidemark.sources import clip_files
from tidemark.streaming import intake
from tidemark.streaming.tracks import link_stream

DETECTION = "clip_id string, sample_idx int, det_idx int, x double, y double, w double, h double, score double, at timestamp"
START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def detection(clip, sample, det, x, score=0.9):
    return (clip, sample, det, float(x), 20.0, 20.0, 30.0, score, START + timedelta(milliseconds=500 * sample))


def put(spark, folder, rows, k):
    spark.createDataFrame(rows, DETECTION).coalesce(1).write.parquet(f"{folder}/part={k}")


def run(spark, folder, checkpoint, name):
    stream = spark.readStream.schema(DETECTION).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")
    writer = link_stream(stream, delay="5 seconds").writeStream.format("parquet").option("path", f"{folder}-out").outputMode("append").option("checkpointLocation", checkpoint)
    query = writer.trigger(availableNow=True).start()
    assert query.awaitTermination(180)


def test_a_stream_links_as_a_batch_does(spark, tmp_path):
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    r = random.Random(3)
    gap = Tracking().link_gap
    samples = [s for s in range(70) if s < 12 or s in (12 + gap, 40, 41, 60, 61)]  # the second step is just in reach, the third and fourth are not
    rows = [detection(clip, s, d, 100.0 * d + r.uniform(-4, 4), r.choice([0.5, 0.9])) for clip in "ab" for s in samples for d in range(2)]
    early = [x for x in rows if x[1] < 10]
    r.shuffle(early)  # within the delay, over two batches
    put(spark, folder, early[: len(early) // 2], 0)
    put(spark, folder, early[len(early) // 2 :], 1)
    run(spark, folder, checkpoint, "one")
    put(spark, folder, [x for x in rows if 10 <= x[1] < 41], 2)  # after a restart from the checkpoint
    put(spark, folder, [x for x in rows if x[1] >= 41] + [detection("end", 200, 0, 1)], 3)
    put(spark, folder, [detection("a", 5, 7, 1), detection("end", 400, 0, 1)], 4)  # far too late
    put(spark, folder, [detection("end", 600, 0, 1)], 5)
    run(spark, folder, checkpoint, "two")
    got = {(x.clip_id, x.sample_idx, x.det_idx, x.track_id) for x in spark.read.parquet(f"{folder}-out").where("clip_id <> 'end'").collect()}
    at = {(x[0], x[1], x[3]): x[2] for x in rows}
    want = {(x.clip_id, x.sample_idx, at[x.clip_id, x.sample_idx, x.x], x.track_id) for x in tracking.link_tracks(spark.createDataFrame(rows, DETECTION)).collect()}
    assert got == want and len(got) == len(rows)
    assert len({t for c, *_, t in want if c == "a"}) > 4  # tracks ended and new ones began


def requests(spark, rows):
    return spark.createDataFrame(rows, "request_id string, url string")


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    ledger = intake.Ledger(spark, str(tmp_path))
    first = requests(spark, [("r1", " https://youtu.be/a "), ("r2", "https://example.org"), ("r1", " https://youtu.be/a "), ("r3", None)])
    assert intake.take_batch(ledger, first, 0) == 3
    before = sorted(map(tuple, ledger.read("jobs", intake.JOBS).collect()), key=repr)
    assert intake.take_batch(ledger, first, 0) == 0
    assert sorted(map(tuple, ledger.read("jobs", intake.JOBS).collect()), key=repr) == before
    assert {r[2]: (r[4], r[8]) for r in before} == {"r1": ("queued", True), "r2": ("error", False), "r3": ("error", False)}
    ledger.forget(0)  # as if the run had ended between its table and its entry
    assert ledger.read("jobs", intake.JOBS).count() == 0
    assert intake.take_batch(ledger, first, 0) == 3
    assert sorted(map(tuple, ledger.read("jobs", intake.JOBS).collect()), key=repr) == before
    assert intake.take_batch(ledger, requests(spark, [("r1", "https://youtu.be/a"), ("r4", "https://youtu.be/b")]), 1) == 1
    assert ledger.done().count() == 2 and ledger.read("jobs", intake.JOBS).count() == 4


def test_intake_as_a_stream(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "jobs")
    for k in range(3):
        requests(spark, [(f"r{k}", "https://youtu.be/a"), ("same", "https://youtu.be/b")]).coalesce(1).write.parquet(f"{source}/part={k}")
    stream = spark.readStream.schema("request_id string, url string").option("maxFilesPerTrigger", 1).parquet(f"{source}/part=*")
    for checkpoint in ("one", "two"):  # with a lost checkpoint all batches run again
        assert intake.start_intake(stream, folder, str(tmp_path / checkpoint)).awaitTermination(180)
        jobs = intake.Ledger(spark, folder).read("jobs", intake.JOBS)
        assert sorted(r.request_id for r in jobs.collect()) == ["r0", "r1", "r2", "same"]


def test_states_and_slots(spark):
    jobs = spark.createDataFrame([("a", "queued", "", "", None), ("b", "queued", "", "", None)], "id string, stage string, status string, detail string, error string")
    events = spark.createDataFrame([("a", 2, "ranking", "x", None), ("a", 1, "importing", "", None), ("a", 2, "ranking", "x", None), ("zz", 9, "done", "", None)], "id string, seq long, stage string, detail string, error string")
    rows = {r.id: (r.stage, r.status, r.detail) for r in intake.latest_states(jobs, events).collect()}
    assert rows == {"a": ("ranking", "Finding best moments...", "x"), "b": ("queued", "Waiting for a free slot...", "")}
    queue = spark.createDataFrame([("a", "ranking", 1), ("b", "queued", 3), ("c", "queued", 2), ("d", "done", 0)], "id string, stage string, arrived long")
    assert [r.id for r in intake.admit(queue, 2).collect()] == ["c"] and intake.admit(queue, 1).count() == 0


def tree(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, files in os.walk(path) for f in files)


def test_files_beside_clips(spark, tmp_path):
    path = str(tmp_path / "out")
    clips = spark.createDataFrame([("j1", 0, "cap é\n", "graph"), ("j1", 1, "cap2\n", None), ("j2", 0, "cap3\n", "g2")], "job_id string, clip_idx int, captions string, graph string").repartition(3)
    files = clip_files.side_files(clips)
    clip_files.write_files(files, path)
    assert tree(path) == ["j1/clip_1.ass", "j1/clip_1.filter", "j1/clip_2.ass", "j2/clip_1.ass", "j2/clip_1.filter"]
    assert open(f"{path}/j1/clip_1.ass", encoding="utf-8").read() == "cap é\n" and open(f"{path}/j1/clip_1.filter").read() == "graph"
    with pytest.raises(Exception, match="clip_1"):
        clip_files.write_files(files, path, overwrite=False)
    clip_files.write_files(files.withColumn("value", F.lit("new")), path)
    assert open(f"{path}/j2/clip_1.ass").read() == "new" and len(tree(path)) == 5


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"j{i}", "clip_1.ass", "x") for i in range(8)] + [("../..", "clip_1.ass", "x")], "folder string, name string, value string").repartition(4)
    with pytest.raises(Exception, match="outside"):
        clip_files.write_files(rows, path)
    assert tree(path) == [] and os.listdir(tmp_path) in ([], ["out"])
    twice = spark.createDataFrame([("j", "a", "x"), ("j", "a", "y")], "folder string, name string, value string")
    with pytest.raises(Exception, match="same file"):
        clip_files.write_files(twice, path)
    assert tree(path) == []


def brightness():
    """A stub that finds a face for each byte over 200, and fails on files that say none."""
    def model(content: bytes):
        if content == b"none":
            raise ValueError("nothing to see")
        if content == b"bad":
            return [{"sample_idx": 0}]
        return [{"sample_idx": i, "det_idx": 0, "x": float(b), "y": 0.0, "w": 40.0, "h": 40.0, "score": 1.0} for i, b in enumerate(content) if b > 200]

    return model


def test_detector_over_files(spark, tmp_path):
    for name, content in {"a": bytes([10, 210, 250]), "b": b"none", "c": b"bad", "d": bytes([1])}.items():
        (tmp_path / f"{name}.bin").write_bytes(content)
    media = spark.read.format("binaryFile").load(str(tmp_path)).select(F.regexp_extract("path", r"([a-z])\.bin$", 1).alias("clip_id"), "content")
    hook = hooks.Hook("stub", ("content",), hooks.DETECTIONS, brightness, batch=2)
    found, failed = hooks.detect(media, hook)
    assert sorted((r.clip_id, r.sample_idx, r.x) for r in found.collect()) == [("a", 1, 210.0), ("a", 2, 250.0)]
    assert {r.clip_id: r.error.split(":")[0] for r in failed.collect()} == {"b": "ValueError", "c": "TypeError"}
    assert tracking.link_tracks(found).count() == 2


def test_scorer_and_transcriber(spark):
    listings = spark.createDataFrame([("a", "[id=0] (40s) x"), ("b", None)], "job_id string, listing string")
    hooks.register(hooks.Hook("scorer", ("listing",), hooks.REPLY, lambda: lambda text: '[{"id":0,"score":%d}]' % len(text)))
    rows = {r.job_id: (r.raw, r.error) for r in hooks.reply(listings, "scorer").collect()}
    assert rows["a"] == ('[{"id":0,"score":14}]', None) and rows["b"][0] is None and rows["b"][1].startswith("TypeError")
    made = {"language": "en", "duration_seconds": 1.0, "segments": [{"start": 0.0, "end": 1.0, "text": "hi"}], "words": []}
    audio = spark.createDataFrame([("a", "p")], "job_id string, path string")
    (row,) = hooks.transcribe(audio, hooks.Hook("speech", ("path",), hooks.TRANSCRIPT, lambda: lambda path: made)).collect()
    assert row.language == "en" and row.segments[0].text == "hi" and row.error is None
    with pytest.raises(ValueError):
        hooks.register(hooks.Hook("scorer", ("listing",), hooks.REPLY, brightness))
    with pytest.raises(KeyError):
        hooks.get("none")
    with pytest.raises(ValueError):
        hooks.run_hook(audio, hooks.Hook("x", ("missing",), hooks.REPLY, brightness))


def test_a_model_that_does_not_start_fails_the_job(spark):
    def broken():
        raise RuntimeError("no weights")

    with pytest.raises(PythonException, match="no weights"):
        hooks.run_hook(spark.range(1), hooks.Hook("broken", ("id",), "string", broken)).collect()


def test_a_model_starts_once_in_a_worker(spark):
    started = []
    hook = hooks.Hook("counted", ("id",), "long", lambda: started.append(1) or (lambda x: x + 1), version="t")
    batch = pa.RecordBatch.from_pydict({"id": list(range(50))})
    for _ in range(3):
        assert hooks._started(hook)(1) == 2
    assert len(started) == 1 and batch.num_rows == 50
