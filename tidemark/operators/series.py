"""Smoothing of position series. A clip's series is an array (two samples a second of a short clip), so that after one
group by clip all steps are expressions on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Smoothing
from ..functions.numeric import clip, even, exact_round, let

DEFAULT = Smoothing()


def gather(points: DataFrame, value: str = "v", by: tuple[str, ...] = ("clip_id",)) -> DataFrame:
    """For each clip its points (sample_idx, value) as a sorted array of structs s, v."""
    return points.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("sample_idx").alias("s"), F.col(value).alias("v")))).alias("points"))


def fill(points: Column, n: Column | int) -> Column:
    """Values at samples 0 to n - 1: linear between points (structs s, v by rising s), flat beyond the first and last.

    One scan: each point gives the samples from itself up to the next one. Of points at one sample the last counts; points
    outside the samples only shape what lies between. Without points all values are null.
    """
    n = F.lit(n) if isinstance(n, int) else n
    between = lambda a, b, i: a["v"] + (b["v"] - a["v"]) / (b["s"] - a["s"]) * (i - a["s"])

    def piece(a: Column, b: Column) -> Column:
        low, high = F.greatest(a["s"], F.lit(0)), F.least(b["s"], n) - 1
        last = F.array_repeat(a["v"], (n - low).cast("int"))
        return F.when(b.isNull(), last).when(low <= high, F.transform(F.sequence(low, high), lambda i: between(a, b, i))).otherwise(F.array().cast("array<double>"))

    def scan(points: Column) -> Column:
        first = F.element_at(points, F.lit(1))
        lead = F.array_repeat(first["v"], F.greatest(F.least(first["s"], n), F.lit(0)).cast("int"))
        return F.concat(lead, F.flatten(F.zip_with(points, F.slice(points, F.lit(2), F.size(points)), piece)))

    return F.when(F.size(points) > 0, let(points, scan)).otherwise(F.array_repeat(F.lit(None).cast("double"), n.cast("int")))


def moving_average(v: Column, half: int) -> Column:
    """Mean over 2 * half + 1 values; beyond an end its value repeats. Unchanged for half <= 0 or fewer than 2 values."""
    if half <= 0:
        return v
    offsets = F.sequence(F.lit(-half), F.lit(half))

    def averaged(v: Column) -> Column:
        mean = lambda x, i: F.aggregate(offsets, F.lit(0.0), lambda a, o: a + F.element_at(v, F.least(F.greatest(i + o, F.lit(0)), F.size(v) - 1) + 1)) / F.lit(2.0 * half + 1)
        return F.when(F.size(v) < 2, v).otherwise(F.transform(v, mean))

    return let(v, averaged)


def dead_zone(v: Column, dead: Column) -> Column:
    """The value at the last move: it moves only when the series is over dead away from it.

    A scan over blocks of about the root of the series' length: a value is appended to its block only, and a finished block
    to the list of blocks, so that no long array is copied for each value.
    """
    empty = F.array().cast("array<double>")

    def step(state: Column, x: Column) -> Column:
        moved = F.when(F.abs(x - state["anchor"]) > dead, x).otherwise(state["anchor"])
        return let(moved, lambda anchor: F.struct(anchor.alias("anchor"), F.concat(state["out"], F.array(anchor)).alias("out")))

    def scan(v: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))

        def block(state: Column, i: Column) -> Column:
            part = F.aggregate(F.slice(v, i, size), F.struct(state["anchor"].alias("anchor"), empty.alias("out")), step)
            return let(part, lambda p: F.struct(p["anchor"].alias("anchor"), F.concat(state["blocks"], F.array(p["out"])).alias("blocks")))

        start = F.struct(F.element_at(v, F.lit(1)).alias("anchor"), F.array().cast("array<array<double>>").alias("blocks"))
        return F.aggregate(F.sequence(F.lit(1), F.size(v), size), start, block, lambda s: F.flatten(s["blocks"]))

    return F.when(F.size(v) > 0, let(v, scan)).otherwise(v)


def half_windows(fps: float, c: Smoothing = DEFAULT) -> tuple[int, int]:
    return round(c.smooth_seconds * fps), round(c.glide_seconds * fps)


def smooth(series: DataFrame, size: Column, limit: Column, fps: float = 2.0, c: Smoothing = DEFAULT) -> DataFrame:
    """series (with v) with origin: where a crop of that size begins that follows v smoothly within the limit."""
    half, glide = half_windows(fps, c)
    rows = series.withColumn("__a", moving_average(F.col("v"), half))
    rows = rows.withColumn("__b", dead_zone(F.col("__a"), F.lit(c.dead_fraction) * size))
    rows = rows.withColumn("__c", moving_average(F.col("__b"), glide))
    return rows.withColumn("origin", F.transform("__c", lambda x: clip(x - size / 2, F.lit(0.0), F.greatest(limit - size, F.lit(0.0))))).drop("__a", "__b", "__c")


def keyframes(v: Column, fps: float = 2.0) -> Column:
    """Times and values (rounded to a decimal) of the first and last sample and of all that leave a neighbour's value."""
    return let(v, lambda v: let(F.transform(v, lambda x: exact_round(x, 1)), lambda r: _keyframes(v, r, fps)))


def _keyframes(v: Column, rounded: Column, fps: float) -> Column:
    near = lambda x, i: F.coalesce(F.abs(x - F.get(v, i)) < 0.5, F.lit(False))
    keep = lambda x, i: (i == 0) | (i == F.size(v) - 1) | ~(near(x, i - 1) & near(x, i + 1))
    marked = F.transform(rounded, lambda x, i: F.when(keep(x, i), F.struct((i / F.lit(float(fps))).alias("t"), x.alias("v"))))
    return F.filter(marked, lambda k: k.isNotNull())


def value_at(keys: Column, t: Column) -> Column:
    """The value of keyframes (structs t, v by rising t) at a time: linear between them, flat beyond; null without any.

    A binary search: of n keyframes about log2(n) are looked at.
    """
    between = lambda a, b: a["v"] + (b["v"] - a["v"]) * (t - a["t"]) / (b["t"] - a["t"])

    def halve(state: Column, keys: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        return let(middle, lambda m: F.when(state["low"] >= state["high"], state).when(F.element_at(keys, m + 1)["t"] <= t, F.struct((m + 1).alias("low"), state["high"].alias("high"))).otherwise(F.struct(state["low"].alias("low"), m.alias("high"))))

    def search(keys: Column) -> Column:
        n = F.size(keys)
        start = F.struct(F.lit(0).alias("low"), n.alias("high"))
        before = F.aggregate(F.sequence(F.lit(1), F.length(F.bin(n))), start, lambda state, _: halve(state, keys), lambda s: s["low"])
        choose = lambda k: F.when(k == 0, F.element_at(keys, F.lit(1))["v"]).when(k == n, F.element_at(keys, F.lit(-1))["v"]).otherwise(let(F.element_at(keys, k), lambda a: let(F.element_at(keys, k + 1), lambda b: between(a, b))))
        return let(before, choose)

    return F.when(F.size(keys) > 0, let(keys, search))


def single_size(width: Column, height: Column) -> tuple[Column, Column]:
    """Even width and height of the largest 9:16 crop."""
    w = even(height * 9 / 16)
    wide = w > width
    return F.when(wide, even(width)).otherwise(w), F.when(wide, even(width * 16 / 9)).otherwise(height.cast("int"))


def half_size(width: Column, height: Column, face: Column) -> tuple[Column, Column]:
    """Even width and height of a 9:8 crop that suits the height of a face."""
    h = clip(face * 3.2, height * 0.45, height.cast("double"))
    wide = h * 9 / 8 > width
    return even(F.when(wide, width).otherwise(h * 9 / 8)), even(F.when(wide, width * 8 / 9.0).otherwise(h))


def debug_tiles(n: Column, most: int = 12) -> Column:
    """Numbers of evenly spaced samples, the first and last among them, cut down to whole ones."""
    m = F.least(n, F.lit(most))
    step = (n - 1) / F.greatest(m - 1, F.lit(1))
    return F.when(n <= 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))), lambda i: F.when(i == m - 1, F.when(m > 1, n - 1).otherwise(0)).otherwise(F.floor(i * step)).cast("int")))
