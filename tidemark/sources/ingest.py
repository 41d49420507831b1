"""Timelines and tracks: from transcripts, and stand-ins derived from the driver's tables.

Times are whole centiseconds (cs), so that seconds are exact to two digits in any engine.
"""

from __future__ import annotations

from datetime import date
from math import ceil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import fixed, let
from ..functions.text import strip

#: Characters of conversations that a task gets; of documents, which are not cut into words, eight times as many.
TASK = 1 << 19

TRANSCRIPT = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("language_probability", T.DoubleType()),
        T.StructField("model", T.StringType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("audio_seconds", T.DoubleType()),
        T.StructField("segments", T.ArrayType(T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("text", T.StringType())]))),
        T.StructField("words", T.ArrayType(T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("word", T.StringType())]))),
    ]
)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts as JSON files of one object each; job_id is the name of the file's folder where the object has none."""
    read = spark.read.schema(TRANSCRIPT).option("multiLine", True).json(path)
    return read.withColumn("job_id", F.coalesce("job_id", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)))


def transcript_segments(transcripts: DataFrame) -> DataFrame:
    """Segments with text, numbered by their place among those."""
    full = F.filter("segments", lambda s: F.length(strip(s["text"])) > 0)
    rows = transcripts.select("job_id", F.posexplode(full).alias("seg_idx", "s"))
    return rows.select("job_id", F.col("seg_idx").cast("int").alias("seg_idx"), F.col("s.start").alias("start_s"), F.col("s.end").alias("end_s"), strip(F.col("s.text")).alias("text"))


def transcription_note(transcripts: DataFrame) -> DataFrame:
    """job_id and a sentence on how each transcript was made; what it does not say is shown as a question mark or nought."""
    known = lambda c: F.coalesce(F.col(c), F.lit("?"))
    seconds_ = fixed(F.coalesce("duration_seconds", F.lit(0.0)), 0)
    return transcripts.select("job_id", F.concat(F.lit("transcribed with whisper "), known("model"), F.lit(" (language "), known("language"), F.lit(", "), seconds_, F.lit(" s)")).alias("note"))


def transcript_words(transcripts: DataFrame) -> DataFrame:
    full = F.filter("words", lambda s: F.length(strip(s["word"])) > 0)
    rows = transcripts.select("job_id", F.posexplode(full).alias("word_idx", "w"))
    return rows.select("job_id", F.col("word_idx").cast("int").alias("word_idx"), F.col("w.start").alias("start_s"), F.col("w.end").alias("end_s"), strip(F.col("w.word")).alias("word"))


def media_files(spark: SparkSession, path: str) -> DataFrame:
    """Landed media files: path, size and time; contents are not read unless asked for."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")


def pick_source(files: DataFrame) -> DataFrame:
    """For each job (job_id, path) the first path that is mp4, else the first."""
    return files.groupBy("job_id").agg(F.min(F.struct((~F.lower("path").endswith(".mp4")).alias("other"), "path"))["path"].alias("path"))


def probe_size(probe: DataFrame) -> DataFrame:
    """job_id, width and height of the first video stream in a probe's JSON (job_id, raw)."""
    kind = "streams array<struct<width:int,height:int>>"
    first = F.try_element_at(F.from_json("raw", kind)["streams"], F.lit(1))
    return probe.select("job_id", first["width"].alias("width"), first["height"].alias("height"))


def detection_size(width, height, widest: int = 640):
    """Even width and height that frames are detected at."""
    w = F.least(F.lit(widest), width)
    w = w - w % 2
    h = F.bround(height * w / width).cast("int")
    return w.cast("int"), (h - h % 2).cast("int")


def sample_grid(clips: DataFrame, fps: float = 2.0) -> DataFrame:
    """A row for each sample of clips (clip_id, start_s, end_s): its number and time in the clip."""
    n = F.floor((F.col("end_s") - F.col("start_s")) * F.lit(fps)).cast("int")
    return clips.where(n > 0).select("clip_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("sample_idx")).withColumn("t", F.col("sample_idx") / F.lit(fps))


def timeline(texts: DataFrame) -> DataFrame:
    """Words of (job_id, turn, text) rows: word_idx, turn, start_cs, end_cs and word.

    A word takes 36 of 40 cs and each turn begins 150 cs later. Numbers come from counts of words in earlier turns, so
    that only turns, not words, are shuffled and sorted.
    """
    parts = texts.select("job_id", F.col("turn").cast("long").alias("turn"), F.filter(F.split("text", r"\s+"), lambda w: F.length(w) > 0).alias("parts"))
    before = Window.partitionBy("job_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum(F.size("parts")).over(before), F.lit(0)))
    rows = parts.select("job_id", "turn", "base", F.posexplode("parts").alias("pos", "word"))
    k = F.col("base") + F.col("pos")
    return rows.select("job_id", k.cast("int").alias("word_idx"), "turn", (k * 40 + F.col("turn") * 150).alias("start_cs"), "word").withColumn("end_cs", F.col("start_cs") + 36)


def seconds(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"start_s": F.col("start_cs") / F.lit(100.0), "end_s": F.col("end_cs") / F.lit(100.0)}).drop("start_cs", "end_cs")


def sentences(words: DataFrame) -> DataFrame:
    """Segments of a timeline: they end at a word with a full stop, question or exclamation mark, and with a turn."""
    order = Window.partitionBy("job_id").orderBy("word_idx")
    last = F.lag("word").over(order)
    fresh = F.coalesce(F.right(last, F.lit(1)).isin(".", "!", "?") | (F.lag("turn").over(order) != F.col("turn")), F.lit(True))
    marked = words.withColumn("seg", F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    parts = marked.groupBy("job_id", "seg").agg(F.min("start_cs").alias("start_cs"), F.max("end_cs").alias("end_cs"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "word"))), lambda x: x["word"]), " ").alias("text"))
    return parts.select("job_id", F.col("seg").cast("int").alias("seg_idx"), "start_cs", "end_cs", "text")


def segments(texts: DataFrame, one_turn: bool = False, keep_text: bool = True) -> DataFrame:
    """The segments of sentences(timeline(texts)), cut within each (job_id, turn, text) row.

    Only turns are numbered, never words; with one_turn, for jobs of one turn each, none are. Of rows that are dealt by job
    (see dealt) what groups by job afterwards needs no other shuffle. Without keep_text texts are not put together, and text is
    null: each copies its whole turn's words.
    """
    rows = texts.select("job_id", F.col("turn").cast("long").alias("turn"), F.filter(F.split("text", r"\s+"), lambda w: F.length(w) > 0).alias("parts"))
    n = F.size("parts")
    ends = lambda i: F.when((i == n - 1) | F.right(F.element_at("parts", i + 1), F.lit(1)).isin(".", "!", "?"), i)
    stops = F.filter(F.transform("parts", lambda _, i: ends(i)), lambda i: i.isNotNull())
    rows = rows.withColumn("stops", stops).withColumns({"words": n, "cut": F.size("stops")})
    before = Window.partitionBy("job_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda size: F.lit(0) if one_turn else F.coalesce(F.sum(size).over(before), F.lit(0))
    rows = rows.withColumns({"base": earlier("words"), "seg_base": earlier("cut")})
    first = lambda stops, i: F.when(i == 0, 0).otherwise(F.get(stops, i - 1) + 1)
    text = lambda parts, a, e: F.array_join(F.slice(parts, a + 1, e - a + 1), " ") if keep_text else F.lit(None).cast("string")
    span = lambda parts, stops, e, i: let(first(stops, i), lambda a: F.struct(a.alias("a"), e.alias("e"), text(parts, a, e).alias("text")))
    spans = let(F.col("parts"), lambda parts: let(F.col("stops"), lambda stops: F.transform(stops, lambda e, i: span(parts, stops, e, i))))
    found = rows.select("job_id", "turn", "base", "seg_base", F.posexplode(spans).alias("pos", "x"))
    at = lambda k: (F.col("base") + F.col(k)) * 40 + F.col("turn") * 150
    return found.select("job_id", (F.col("seg_base") + F.col("pos")).cast("int").alias("seg_idx"), at("x.a").alias("start_cs"), (at("x.e") + 36).alias("end_cs"), "x.text")


def dealt(texts: DataFrame, size: int) -> DataFrame:
    """Rows (job_id, text) dealt by job, so that tasks get about size characters each, however many there are.

    A job's rows grow to many times their size on the way; tasks of Spark's choice, which go by shuffled bytes, grow with the input.
    """
    total = texts.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    return texts.repartition(max(1, ceil(total / size)), "job_id")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("string").alias("job_id"), "turn", "text")
    return dealt(rows, TASK)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("job_id"), F.lit(0).alias("turn"), "text")
    return dealt(rows, 8 * TASK)


def event_grid(spark: SparkSession, sf_dir: str) -> tuple[date | None, int]:
    """The first day of all events, and how many samples of half a day there are from it to the last event."""
    last = F.max(F.struct(F.to_date("ts").alias("day"), F.floor(F.hour("ts") / 12).alias("half")))
    row = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.min(F.to_date("ts")).alias("first"), last.alias("last")).first()
    return (row["first"], (row["last"]["day"] - row["first"]).days * 2 + row["last"]["half"] + 1) if row["first"] else (None, 0)


def event_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with clip_id and sample_idx, the number of half a day from the day of the first event on."""
    first, _ = event_grid(spark, sf_dir)
    day = F.datediff(F.to_date("ts"), F.lit(first).cast("date"))
    bins = (day * 2 + F.floor(F.hour("ts") / 12)).cast("int")
    return spark.read.parquet(f"{sf_dir}/events.parquet").where("ts is not null").select(F.col("user_id").cast("string").alias("clip_id"), "event_type", "value", bins.alias("sample_idx"))


def event_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a track for each event type: centre x is the median value of a sample."""
    boxes = event_bins(spark, sf_dir).groupBy("clip_id", "event_type", "sample_idx").agg(F.median("value").alias("cx"))
    firsts = boxes.groupBy("clip_id", "event_type").agg(F.min("sample_idx").alias("f"))
    ids = firsts.withColumn("track_id", (F.row_number().over(Window.partitionBy("clip_id").orderBy("f", "event_type")) - 1).cast("int"))
    return boxes.join(ids, ["clip_id", "event_type"]).select("clip_id", "track_id", "sample_idx", (F.col("cx") - 4).alias("x"), (F.col("cx") / 2).alias("y"), F.lit(8.0).alias("w"), F.lit(10.0).alias("h"))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, sample_idx, v: median value of a user's half-days."""
    return event_bins(spark, sf_dir).groupBy("clip_id", "sample_idx").agg(F.median("value").alias("v"))


def event_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a detection: nearby values of a user link to tracks."""
    order = Window.partitionBy("clip_id", "sample_idx").orderBy(F.desc("value"), "event_type")
    rows = event_bins(spark, sf_dir).withColumn("det_idx", (F.row_number().over(order) - 1).cast("int"))
    return rows.select("clip_id", "sample_idx", "det_idx", F.col("value").alias("x"), F.lit(20.0).alias("y"), F.lit(8.0).alias("w"), F.lit(10.0).alias("h"), F.lit(1.0).alias("score"))
