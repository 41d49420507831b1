"""Caption lines: words of each clip, in short chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Captions
from ..functions.text import caption_escape, caption_time

DEFAULT = Captions()


def clip_words(words: DataFrame, clips: DataFrame) -> DataFrame:
    """Words (start_cs, end_cs) that overlap a clip (job_id, clip_idx, start_cs, end_cs); touching ones do not.

    A job has a handful of clips: they go with the job's words as one array, so that no word meets another job's clips
    and the join is an equi-join.
    """
    lists = clips.groupBy("job_id").agg(F.collect_list(F.struct("clip_idx", "start_cs", "end_cs")).alias("clips"))
    near = F.filter("clips", lambda c: (F.col("end_cs") > c["start_cs"]) & (F.col("start_cs") < c["end_cs"]))
    rows = words.join(lists, "job_id").select("job_id", "word_idx", "start_cs", "end_cs", "word", F.explode(near).alias("c"))
    return rows.select("job_id", "c.clip_idx", "word_idx", (F.col("start_cs") - F.col("c.start_cs")).alias("from_cs"), (F.col("end_cs") - F.col("c.start_cs")).alias("to_cs"), "word")


def chunks(words: DataFrame, c: Captions = DEFAULT) -> DataFrame:
    """Chunks of a clip's words (clip-relative from_cs, to_cs): up to c.words, none across a long gap or a mark."""
    order = Window.partitionBy("job_id", "clip_idx").orderBy("word_idx")
    cuts = (F.col("from_cs") - F.lag("to_cs").over(order) > round(c.gap * 100)) | F.right(F.lag("word").over(order), F.lit(1)).isin(list(c.breaks))
    rows = words.withColumn("session", F.sum(F.coalesce(cuts, F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    place = Window.partitionBy("job_id", "clip_idx", "session").orderBy("word_idx")
    rows = rows.withColumn("part", F.floor((F.row_number().over(place) - 1) / c.words).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "word"))), lambda x: x["word"]), " ")
    parts = rows.groupBy("job_id", "clip_idx", "session", "part").agg(F.min_by("from_cs", "word_idx").alias("from_cs"), F.max_by("to_cs", "word_idx").alias("to_cs"), text.alias("text"))
    numbered = F.row_number().over(Window.partitionBy("job_id", "clip_idx").orderBy("session", "part")) - 1
    return parts.select("job_id", "clip_idx", numbered.cast("int").alias("chunk_idx"), "from_cs", "to_cs", "text")


def lines(parts: DataFrame) -> DataFrame:
    """Dialogue lines of chunks. A start before the clip is shown as zero; an end after it stays."""
    text = F.concat(F.lit("Dialogue: 0,"), caption_time(F.col("from_cs")), F.lit(","), caption_time(F.col("to_cs")), F.lit(",Default,,0,0,0,,"), caption_escape(F.col("text")))
    return parts.select("job_id", "clip_idx", "chunk_idx", text.alias("line"))
