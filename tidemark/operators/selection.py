"""Greedy choice of windows that do not overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Windows
from ..functions.scratch import Scratch

DEFAULT = Windows()


def select_best(scored: DataFrame, c: Windows = DEFAULT) -> DataFrame:
    """By falling score (ties by id) each candidate that overlaps none chosen before, up to the cap; clip_idx by start.

    Touching windows do not overlap. There is no minimum. A fold over each job's sorted list, for jobs of at most c.most
    candidates as windows.number leaves them; select_spread takes jobs of any size.
    """
    shape = "array<struct<id:int,start_s:double,end_s:double,text:string,score:double>>"
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), "id", "start_s", "end_s", "text", "score")))
    jobs = scored.groupBy("job_id").agg(ordered.alias("all"))
    free = lambda chosen, x: ~F.exists(chosen, lambda o: (x["start_s"] < o["end_s"]) & (o["start_s"] < x["end_s"]))
    item = lambda x: F.array(F.struct(x["id"].alias("id"), x["start_s"].alias("start_s"), x["end_s"].alias("end_s"), x["text"].alias("text"), x["score"].alias("score")))
    step = lambda chosen, x: F.when((F.size(chosen) < c.clips) & free(chosen, x), F.concat(chosen, item(x))).otherwise(chosen)
    chosen = jobs.select("job_id", F.aggregate("all", F.array().cast(shape), step).alias("chosen"))
    by_start = F.array_sort("chosen", lambda a, b: F.when(a["start_s"] < b["start_s"], -1).when(a["start_s"] > b["start_s"], 1).otherwise(0))
    rows = chosen.select("job_id", F.posexplode(by_start).alias("clip_idx", "x"))
    return rows.select("job_id", F.col("clip_idx").cast("int").alias("clip_idx"), "x.*")


def _bins(width: float) -> Column:
    """The time bins that a window reaches into."""
    at = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    return F.sequence(at("start_s"), F.greatest(at("start_s"), at("end_s")))


def independent(scored: DataFrame, width: float = DEFAULT.longest) -> DataFrame:
    """All windows (job_id, id, start_s, end_s, score) that a greedy choice without a cap takes, in rounds.

    Windows that overlap have a time bin of that width in common. In each round every bin names its best open window; one
    that is best in all its bins outranks all open windows that it overlaps, so the greedy choice takes it. Then it and
    what overlaps it are closed. A bin has one winner a round, so a window meets no more winners than it has bins, and no
    pairs of candidates are made; work is dealt by (job, bin). Each round settles the best open window of every job at
    least, and of scores in random order all but a few need about log(n) rounds. Windows must have different ids in
    a job, else an error is raised; a null score ranks first, as in select_best, and windows without a job, start or end are left out.
    """
    scratch = Scratch(scored.sparkSession)
    key = F.struct((-F.col("score")).alias("low"), F.col("id").alias("id"))
    rows = scored.where("job_id is not null and start_s is not null and end_s is not null").select("job_id", "id", "start_s", "end_s", key.alias("key"), _bins(width).alias("bins"))
    left, done = scratch.keep(rows), []
    while True:
        own = left.select("job_id", "key", "start_s", "end_s", F.size("bins").alias("n"), F.explode("bins").alias("bin"))
        best = own.groupBy("job_id", "bin").agg(F.min_by(F.struct("key", "start_s", "end_s", "n"), "key").alias("x"))
        won = best.groupBy("job_id", F.col("x.key").alias("key")).agg(F.count("*").alias("k"), F.first("x").alias("x")).where(F.col("k") == F.col("x.n"))
        taken = scratch.keep(won.select("job_id", "key", F.col("x.start_s").alias("from_s"), F.col("x.end_s").alias("to_s")))
        done.append(taken)
        spread = taken.withColumnsRenamed({"from_s": "start_s", "to_s": "end_s"}).select("job_id", F.explode(_bins(width)).alias("bin"), F.col("key").alias("winner"), F.col("start_s").alias("from_s"), F.col("end_s").alias("to_s"))
        hit = own.join(spread, ["job_id", "bin"]).where((F.col("key") == F.col("winner")) | ((F.col("start_s") < F.col("to_s")) & (F.col("from_s") < F.col("end_s"))))
        rest = scratch.keep(left.join(hit.select("job_id", "key").distinct(), ["job_id", "key"], "left_anti").select(*left.columns))
        scratch.forget(scratch.made - 2)
        left = rest
        if left.isEmpty():
            break
        if taken.isEmpty():
            raise ValueError("two windows of a job have the same id")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found.select("job_id", F.col("key.id").alias("id"), F.col("from_s").alias("start_s"), F.col("to_s").alias("end_s"), (-F.col("key.low")).alias("score"))


def select_spread(scored: DataFrame, c: Windows = DEFAULT, texts: bool = True) -> DataFrame:
    """As select_best, for jobs of any number of candidates: no job is held in one task.

    A choice that stops at the cap takes the best of what one without a cap takes, as choices do not depend on later ones.
    Without texts scored is read once only, and text is null.
    """
    every = independent(scored.select("job_id", "id", "start_s", "end_s", "score"), c.longest)
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc_nulls_first("score"), "id"))
    top = every.withColumn("r", rank).where(F.col("r") <= c.clips)
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("start_s")) - 1
    if not texts:
        return top.select("job_id", place.cast("int").alias("clip_idx"), "id", "start_s", "end_s", F.lit(None).cast("string").alias("text"), "score")
    numbered = top.select("job_id", "id", place.cast("int").alias("clip_idx"))
    return scored.join(numbered, ["job_id", "id"]).select("job_id", "clip_idx", "id", "start_s", "end_s", "text", "score")
