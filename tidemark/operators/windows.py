"""Candidate windows over the segments of a job."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Windows
from ..functions.numeric import exact_round, let

DEFAULT = Windows()


def _ahead(segments: DataFrame, c: Windows, *more: str) -> DataFrame:
    """segments (job_id, i, start_s and others) with near, the segments from each on up to the last of its windows.

    A range frame over starts gathers only the segments that can stand in a window, so there is one shuffle by job and no join.
    """
    order = Window.partitionBy("job_id").orderBy("start_s").rangeBetween(0, ceil(c.longest))
    ahead = F.collect_list(F.struct("seg_idx", "end_s", *more)).over(order)
    rows = segments.select("job_id", F.col("seg_idx").alias("i"), "start_s", *[k for k in segments.columns if k not in ("job_id", "seg_idx", "start_s", "end_s", "text")], ahead.alias("near"))
    own = F.filter(F.array_sort("near"), lambda x: x["seg_idx"] >= F.col("i"))
    reach = lambda near: F.array_position(F.transform(near, lambda x: x["end_s"] - F.col("start_s") >= c.target), True)
    last = lambda near: let(reach(near), lambda r: F.when(r > 0, r).otherwise(F.size(near)).cast("int"))
    # One expression: a column that others use is computed for each use where a filter is pushed down.
    return rows.withColumn("near", let(own, lambda near: F.slice(near, F.lit(1), last(near))))


def enumerate_windows(segments: DataFrame, c: Windows = DEFAULT) -> DataFrame:
    """All windows (job_id, i, j, start_s, end_s, text) of consecutive segments that are neither too short nor too long.

    From each segment on windows grow by one segment until one reaches the target length or the next is too long. Starts must
    not fall with seg_idx, nor a segment end before it starts.
    """
    rows = _ahead(segments, c, "text").withColumn("texts", F.transform("near", lambda x: x["text"]))
    found = rows.select("job_id", "i", "start_s", "texts", F.posexplode("near").alias("pos", "x"))
    found = found.where((F.col("x.end_s") - F.col("start_s")).between(c.shortest, c.longest))
    text = F.array_join(F.slice("texts", F.lit(1), F.col("pos") + 1), " ")
    return found.select("job_id", "i", F.col("x.seg_idx").alias("j"), "start_s", F.col("x.end_s").alias("end_s"), text.alias("text"))


def thin_windows(segments: DataFrame, c: Windows = DEFAULT, texts: bool = True) -> DataFrame:
    """thin(enumerate_windows(segments)), by a first choice among the windows of each segment before any row is made.

    All windows from one segment lie in one bucket, so the best of them is found in place, with times that were rounded
    once a segment; buckets then meet one row a segment. Without texts they are not gathered, and text is null.
    """
    near = segments.withColumns({"from_s": exact_round(F.col("start_s"), 2), "to_s": exact_round(F.col("end_s"), 2)})
    rows = _ahead(near, c, "to_s", *(["text"] if texts else []))
    fits = F.filter("near", lambda x: (x["end_s"] - F.col("start_s")).between(c.shortest, c.longest))
    far = lambda x: F.abs(x["to_s"] - F.col("from_s") - c.target)
    best = F.array_min(F.transform(fits, lambda x: F.struct(far(x).alias("far"), F.col("i").alias("i"), x["seg_idx"].alias("j"), x["to_s"].alias("to_s"))))
    rows = rows.withColumn("best", best)
    text = F.array_join(F.transform(F.filter("near", lambda x: x["seg_idx"] <= F.col("best.j")), lambda x: x["text"]), " ") if texts else F.lit(None).cast("string")
    bucket = F.floor(F.col("from_s") / F.lit(c.bucket)).cast("long")
    rows = rows.select("job_id", bucket.alias("bucket"), "best", F.struct("from_s", text.alias("text")).alias("rest"))
    found = rows.groupBy("job_id", "bucket").agg(F.min("best").alias("x"), F.min_by("rest", "best").alias("y")).where("x is not null")
    return found.select("job_id", "bucket", "x.i", "x.j", F.col("y.from_s").alias("start_s"), F.col("x.to_s").alias("end_s"), "y.text")


def binned_windows(segments: DataFrame, c: Windows = DEFAULT) -> DataFrame:
    """As enumerate_windows (without text), for jobs so long that one task must not hold them: an equi-join on time bins.

    Each segment goes to the bins that its windows can reach, and meets each later segment in that one's only bin.
    """
    width = c.longest
    bin_of = lambda x: F.floor(x / F.lit(width)).cast("long")
    a = segments.select("job_id", F.col("seg_idx").alias("i"), F.col("start_s").alias("s"), F.explode(F.sequence(bin_of(F.col("start_s")), bin_of(F.col("start_s") + c.longest))).alias("bin"))
    b = segments.select("job_id", F.col("seg_idx").alias("j"), F.col("start_s").alias("s2"), F.col("end_s").alias("e"), bin_of(F.col("start_s")).alias("bin"))
    pairs = a.join(b, ["job_id", "bin"]).where((F.col("j") >= F.col("i")) & (F.col("s2") <= F.col("s") + c.longest)).withColumn("d", F.col("e") - F.col("s"))
    before = F.max("d").over(Window.partitionBy("job_id", "i").orderBy("j").rowsBetween(Window.unboundedPreceding, -1))
    kept = pairs.withColumn("before", before).where(F.col("d").between(c.shortest, c.longest) & (F.coalesce("before", F.lit(0.0)) < c.target))
    return kept.select("job_id", "i", "j", F.col("s").alias("start_s"), F.col("e").alias("end_s"))


def thin(windows: DataFrame, c: Windows = DEFAULT) -> DataFrame:
    """Of each bucket of starts the window whose length is nearest the target; the first on ties.

    A minimum over a struct combines on the map side, so buckets need no sort.
    """
    start, end = exact_round(F.col("start_s"), 2), exact_round(F.col("end_s"), 2)
    rows = windows.select("job_id", "i", "j", start.alias("start_s"), end.alias("end_s"), "text")
    bucket = F.floor(F.col("start_s") / F.lit(c.bucket)).cast("long")
    far = F.abs(F.col("end_s") - F.col("start_s") - c.target)
    best = rows.groupBy("job_id", bucket.alias("bucket")).agg(F.min(F.struct(far.alias("far"), "i", "j", "start_s", "end_s", "text")).alias("x"))
    return best.select("job_id", "bucket", "x.i", "x.j", "x.start_s", "x.end_s", "x.text")


def number(windows: DataFrame, c: Windows = DEFAULT) -> DataFrame:
    """Candidates: id by start from 0; of more than the cap an even choice, computed in doubles."""
    order = Window.partitionBy("job_id").orderBy("start_s")
    rows = windows.select("*", (F.row_number().over(order) - 1).alias("p"), F.count("*").over(Window.partitionBy("job_id")).alias("n"))
    step = F.col("n") / F.lit(float(c.most))
    # Place p is chosen for the k with int(k * step) = p: one at most, as step is over 1. Near p / step lie two k.
    guess = F.floor(F.col("p") / step).cast("int")
    chosen = lambda k: (k < c.most) & (F.floor(k.cast("double") * step) == F.col("p"))
    k = F.when(F.col("n") <= c.most, F.col("p")).when(chosen(guess), guess).when(chosen(guess + 1), guess + 1)
    return rows.withColumn("id", k.cast("int")).where("id is not null").select("job_id", "id", "start_s", "end_s", "text")


def candidates(segments: DataFrame, c: Windows = DEFAULT, texts: bool = True) -> DataFrame:
    return number(thin_windows(segments, c, texts), c)
