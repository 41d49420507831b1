"""Statistics of tracks, and the layout that follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Layout
from ..functions.numeric import clip, exact_round, fixed, let
from . import series

DEFAULT = Layout()
#: Where a face's centre lies in a crop of one person and in a half of two, from the top.
FACE_AT, HALF_FACE_AT = 0.40, 0.42


def track_stats(boxes: DataFrame, n_samples: int, fps: float = 2.0) -> DataFrame:
    """For each track of boxes (clip_id, track_id, sample_idx, x, y, w, h): samples, coverage, span, longest gap in
    seconds, and the median box and centre. first_idx gives the order of tracks."""
    once = F.array_sort(F.collect_set("sample_idx"))
    stats = boxes.groupBy("clip_id", "track_id").agg(
        once.alias("at"), F.min("sample_idx").alias("first_idx"), F.max("sample_idx").alias("last_idx"), *[F.median(c).alias(f"median_{c}") for c in "xywh"]
    )
    n = max(n_samples, 1)
    steps = F.zip_with(F.slice("at", F.lit(2), F.greatest(F.size("at") - 1, F.lit(0))), F.slice("at", F.lit(1), F.greatest(F.size("at") - 1, F.lit(0))), lambda b, a: b - a - 1)
    return stats.select(
        "clip_id",
        "track_id",
        F.size("at").alias("samples"),
        (F.size("at") / F.lit(float(n))).alias("coverage"),
        (F.lit(0.0) if n_samples <= 1 else (F.col("last_idx") - F.col("first_idx") + 1) / F.lit(float(n_samples))).alias("span"),
        (F.coalesce(F.array_max(steps), F.lit(0)) / F.lit(float(fps))).alias("longest_gap"),
        "first_idx",
        *[f"median_{c}" for c in "xywh"],
        (F.col("median_x") + F.col("median_w") / 2).alias("center_x"),
    )


def is_persistent(c: Layout = DEFAULT) -> Column:
    return (F.col("coverage") >= c.persistent) | ((F.col("coverage") >= c.span_coverage) & (F.col("span") >= c.span))


def ranked(stats: DataFrame, c: Layout = DEFAULT) -> DataFrame:
    """stats with rank by falling coverage (ties by first sample, then track) and persistent."""
    order = Window.partitionBy("clip_id").orderBy(F.desc("coverage"), "first_idx", "track_id")
    return stats.withColumn("rank", F.row_number().over(order)).withColumn("persistent", is_persistent(c))


def plan_layout(stats: DataFrame, clips: DataFrame, c: Layout = DEFAULT) -> DataFrame:
    """layout of each clip (clip_id, width), its reason, the tracks that are shown (left first) and what decided.

    Two persistent tracks give two people unless they are too close, or the second is seldom and short. Else the track of
    most coverage is shown, if it has enough. One group by clip finds the first two by sorting a short array.
    """
    info = ["track_id", "coverage", "span", "longest_gap", "center_x", "persistent"]
    rows = stats.withColumn("persistent", is_persistent(c))
    every = F.array_sort(F.collect_list(F.struct((-F.col("coverage")).alias("low"), "first_idx", *info)))
    lists = rows.groupBy("clip_id").agg(every.alias("all"))
    found = clips.select("clip_id", "width").join(lists, "clip_id", "left")
    found = found.withColumn("good", F.filter("all", lambda t: t["persistent"]))
    at = lambda name, k: F.try_element_at(name, F.lit(k))
    found = found.select("clip_id", "width", at("all", 1).alias("best"), at("all", 2).alias("next"), at("good", 1).alias("a"), at("good", 2).alias("b"))
    found = found.withColumn("separation", F.abs(F.col("a.center_x") - F.col("b.center_x")) / F.col("width"))
    two = F.col("b").isNotNull()
    close = F.col("separation") < c.separation
    dominated = (F.col("b.coverage") < F.lit(c.dominance) * F.col("a.coverage")) & (F.col("b.span") < c.span)
    seen = F.col("best.coverage") >= c.single
    layout = F.when(F.col("best").isNull(), "CENTER_CROP").when(two & ~close & ~dominated, "TWO_PERSON").when(two | seen, "SINGLE_PERSON").otherwise("CENTER_CROP")
    reason = F.when(F.col("best").isNull(), "no faces").when(two & close, "too close").when(two & dominated, "second face dominated").when(two, "two persistent faces").when(seen, "one persistent face").otherwise("faces too sporadic")
    left = F.col("a.center_x") <= F.col("b.center_x")
    pair = F.when(left, F.array("a.track_id", "b.track_id")).otherwise(F.array("b.track_id", "a.track_id"))
    single = F.when(two, F.array("a.track_id")).otherwise(F.array("best.track_id"))
    found = found.withColumn("layout", layout).withColumn("reason", reason)
    tracks = F.when(F.col("layout") == "TWO_PERSON", pair).when(F.col("layout") == "SINGLE_PERSON", single).otherwise(F.array().cast("array<int>"))
    ratio = F.when(F.col("a.coverage") > 0, F.col("b.coverage") / F.col("a.coverage"))
    return found.select("clip_id", "layout", "reason", tracks.alias("tracks"), F.col("best.coverage").alias("best_coverage"), "separation", ratio.alias("strength_ratio"), F.col("b.span").alias("second_span"), F.col("b.longest_gap").alias("second_gap"), F.col("a.coverage").alias("first_coverage"), F.col("b.coverage").alias("second_coverage"), F.col("next.coverage").alias("next_coverage"), F.col("next.span").alias("next_span"), (F.abs(F.col("best.center_x") - F.col("next.center_x")) / F.col("width")).alias("next_separation"))


def note(plan: DataFrame, n_samples: int) -> DataFrame:
    """plan with a sentence that tells what decided; percentages are whole, rounded half to even."""
    percent = lambda c: F.concat(fixed(F.col(c) * 100, 0), F.lit("%"))
    ratio, gap = fixed(F.col("strength_ratio"), 2), fixed(F.col("second_gap"), 0)
    samples = F.lit(f", samples {n_samples}")
    pair = F.concat(
        F.lit(" (coverage "), percent("first_coverage"), F.lit(" / "), percent("second_coverage"), F.lit(", ratio "), ratio, F.lit(", span "), percent("second_span"),
        F.lit(", gap "), gap, F.lit("s, separation "), percent("separation"), samples, F.lit(")"),
    )
    other = F.concat(F.lit(", second face coverage "), percent("next_coverage"), F.lit(" span "), percent("next_span"), F.lit(" separation "), percent("next_separation"))
    one = F.concat(F.lit(" (coverage "), percent("best_coverage"), samples, F.coalesce(other, F.lit("")), F.lit(")"))
    rare = F.concat(F.lit(" (best coverage "), percent("best_coverage"), samples, F.lit(")"))
    nothing = F.col("best_coverage").isNull() | F.lit(n_samples == 0)
    told = F.when(F.col("second_coverage").isNotNull(), F.concat("reason", pair)).when(F.col("layout") == "SINGLE_PERSON", F.concat("reason", one)).otherwise(F.concat("reason", rare))
    return plan.withColumn("note", F.when(nothing, "no frames or no faces detected").otherwise(told))


def _median(v: Column) -> Column:
    """Median of an array's values."""
    middle = lambda s: (F.element_at(s, F.floor((F.size(s) + 1) / 2).cast("int")) + F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))) / 2
    return let(F.array_sort(v), middle)


def crop_regions(plan: DataFrame, boxes: DataFrame, clips: DataFrame, n_samples: int, fps: float = 2.0) -> DataFrame:
    """regions of each clip of plan that shows tracks: an array of track_id, w, h, x_keys and y_keys, in the plan's order.

    boxes as for track_stats; clips has clip_id, width and height. One person: the largest 9:16 crop follows the gap-filled
    centre smoothly and stands still at the height that has the median centre at 40 %. Two: each half is a 9:8 crop that
    suits the median height of its face and follows it both ways, with the centre at 42 %. One group by clip and track.
    """
    shown = plan.select("clip_id", "layout", F.posexplode("tracks").alias("place", "track_id"))
    point = lambda o, d: F.array_sort(F.collect_list(F.struct(F.col("sample_idx").alias("s"), (F.col(o) + F.col(d) / 2).alias("v"))))
    points = boxes.groupBy("clip_id", "track_id").agg(point("x", "w").alias("xs"), point("y", "h").alias("ys"), F.median("h").alias("face"))
    rows = shown.join(points, ["clip_id", "track_id"]).join(clips.select("clip_id", "width", "height"), "clip_id")
    rows = rows.withColumn("xs", series.fill(F.col("xs"), n_samples)).withColumn("ys", series.fill(F.col("ys"), n_samples))
    two = F.col("layout") == "TWO_PERSON"
    single, half = series.single_size(F.col("width"), F.col("height")), series.half_size(F.col("width"), F.col("height"), F.col("face"))
    rows = rows.withColumn("w", F.when(two, half[0]).otherwise(single[0]).cast("int")).withColumn("h", F.when(two, half[1]).otherwise(single[1]).cast("int"))
    rows = series.smooth(rows.withColumn("v", F.col("xs")), F.col("w"), F.col("width"), fps).withColumn("x_keys", series.keyframes(F.col("origin"), fps)).drop("origin")
    rows = series.smooth(rows.withColumn("v", F.transform("ys", lambda y: y + F.col("h") * F.lit(0.5 - HALF_FACE_AT))), F.col("h"), F.col("height"), fps)
    still = exact_round(clip(_median(F.col("ys")) - F.col("h") * F.lit(FACE_AT), F.lit(0.0), F.greatest(F.col("height") - F.col("h"), F.lit(0)).cast("double")), 1)
    rows = rows.withColumn("y_keys", F.when(two, series.keyframes(F.col("origin"), fps)).otherwise(F.array(F.struct(F.lit(0.0).alias("t"), still.alias("v")))))
    listed = F.array_sort(F.collect_list(F.struct("place", F.struct("track_id", "w", "h", "x_keys", "y_keys").alias("region"))))
    return rows.groupBy("clip_id", "layout").agg(F.transform(listed, lambda x: x["region"]).alias("regions"))


def metrics(stats: DataFrame, clips: DataFrame, n_samples: int, fragments: DataFrame | None = None, fps: float = 2.0, c: Layout = DEFAULT) -> DataFrame:
    """One record for each clip (clip_id, width) of all that the layout looks at, rounded half-even on exact values.

    Figures of its tracks by rank, the thresholds, and of the first two tracks their separation, the ratio of their coverage
    and the span and longest gap of the second; these are null with fewer than two.
    """
    rows = stats if fragments is None else stats.join(fragments.select("clip_id", "track_id", "fragments").distinct(), ["clip_id", "track_id"], "left")
    pieces = F.lit(1) if fragments is None else F.coalesce("fragments", F.lit(1))
    item = F.struct(
        F.col("track_id").alias("id"), exact_round(F.col("coverage"), 3).alias("coverage"), exact_round(F.col("span"), 3).alias("span"), exact_round(F.col("longest_gap"), 1).alias("longest_gap_s"),
        pieces.alias("fragments"), F.array(*[exact_round(F.col(f"median_{k}"), 1) for k in "xywh"]).alias("median_box"),
    )
    raw = [F.col(k) for k in ("coverage", "span", "longest_gap", "center_x")]
    listed = F.array_sort(F.collect_list(F.struct((-F.col("coverage")).alias("low"), "first_idx", "track_id", item.alias("item"), *[k for k in raw[1:]], raw[0])))
    found = clips.select("clip_id", "width").join(rows.groupBy("clip_id").agg(listed.alias("all")), "clip_id", "left")
    found = found.withColumn("all", F.coalesce("all", F.array().cast(found.schema["all"].dataType)))
    a, b = (F.try_element_at("all", F.lit(k)) for k in (1, 2))
    thresholds = {"persistent_coverage": c.persistent, "span_coverage": c.span_coverage, "span_frac": c.span, "single_min_coverage": c.single, "dominance_ratio": c.dominance, "min_separation_frac": c.separation}
    ratio = F.when(b.isNotNull(), F.when(a["coverage"] > 0, exact_round(b["coverage"] / a["coverage"], 3)).otherwise(0.0))
    return found.select(
        "clip_id", F.lit(n_samples).alias("samples"), F.lit(fps).alias("sample_fps"), F.lit(round(n_samples / fps, 1) if fps else 0.0).alias("clip_seconds"),
        F.transform("all", lambda x: x["item"]).alias("tracks"), F.struct(*[F.lit(v).alias(k) for k, v in thresholds.items()]).alias("thresholds"),
        exact_round(F.abs(a["center_x"] - b["center_x"]) / F.col("width"), 3).alias("separation"), ratio.alias("strength_ratio"),
        exact_round(b["span"], 3).alias("second_span"), exact_round(b["longest_gap"], 1).alias("second_longest_gap_s"),
    )
