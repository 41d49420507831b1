"""Jobs: their rows, and what can be asked of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import exact_round
from ..functions.text import is_source_url, status_text

QUEUED = "Waiting for a free slot..."
RUNNING = ("importing", "transcribing", "ranking", "clipping")


def new_jobs(requests: DataFrame) -> DataFrame:
    """Queued jobs for requests (url) that name a known site; ids are random, so they are not for comparisons."""
    clean = F.trim("url")
    return requests.where(is_source_url(F.col("url"))).select(F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12).alias("id"), clean.alias("url"), F.lit("queued").alias("stage"), F.lit(QUEUED).alias("status"), F.lit("").alias("detail"), F.lit(None).cast("string").alias("error"))


def with_status(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("status", F.when(F.col("stage") == "queued", QUEUED).otherwise(status_text(F.col("stage"))))


def public_view(jobs: DataFrame) -> DataFrame:
    """All but the traceback."""
    return jobs.drop("traceback")


def look_up(jobs: DataFrame, job_id: str) -> DataFrame:
    return public_view(jobs.where(F.col("id") == job_id))


def health(jobs: DataFrame, version: str = "1.0.0", model: str = "model") -> DataFrame:
    """One row: how many jobs are known, running and waiting. Counts combine on the map side."""
    return jobs.agg(F.lit("ok").alias("status"), F.lit(version).alias("version"), F.lit(model).alias("model"), F.count_if(F.col("stage").isin(*RUNNING)).alias("running"), F.count_if(F.col("stage") == "queued").alias("queued"), F.count("*").alias("known"))


def clip_records(clips: DataFrame, prefix: str) -> DataFrame:
    """What a finished job tells of its clips (job_id, clip_idx, layout, start_s, end_s, score, text, clip_file, note if any)."""
    note = F.col("note") if "note" in clips.columns else F.lit("")
    return clips.select(
        "job_id", "layout", note.alias("layout_note"), (F.col("clip_idx") + 1).alias("index"), "start_s", "end_s", exact_round(F.col("end_s") - F.col("start_s"), 1).alias("duration"),
        "score", "text", F.concat(F.lit(f"{prefix}/"), "job_id", F.lit("/"), "clip_file").alias("url"), F.col("clip_file").alias("filename"),
    )


def stage_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("stage").agg(F.count("*").alias("n"))
