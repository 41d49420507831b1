"""What a debug sheet of a clip shows: tiles of evenly spaced samples with crop regions, boxes of tracks and captions.

Drawing is left to whoever has the frames; all coordinates are in pixels of the frames that detection saw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import fixed
from . import series

TILES, COLUMNS = 12, 3


def tiles(clips: DataFrame, n_samples: int, fps: float = 2.0) -> DataFrame:
    """A row for each tile of clips (clip_id): its place, row and column on the sheet, sample_idx, t in seconds and caption."""
    rows = clips.select("clip_id", F.posexplode(series.debug_tiles(F.lit(n_samples), TILES)).alias("tile", "sample_idx"))
    rows = rows.withColumn("t", F.col("sample_idx") / F.lit(fps))
    place = F.col("tile")
    return rows.select("clip_id", "tile", F.floor(place / COLUMNS).cast("int").alias("row"), (place % COLUMNS).alias("column"), "sample_idx", "t", F.concat(F.lit("t="), fixed(F.col("t"), 1), F.lit("s")).alias("caption"))


def _corners(x: Column, y: Column, w: Column, h: Column, scale: float) -> list[Column]:
    """Corners of a box of the source in a frame that is smaller by scale, cut down to whole pixels."""
    at = lambda v: (v * F.lit(1.0 / scale)).cast("int")
    return [at(x).alias("x1"), at(y).alias("y1"), at(x + w).alias("x2"), at(y + h).alias("y2")]


def track_boxes(shown: DataFrame, boxes: DataFrame, stats: DataFrame, scale: float = 1.0) -> DataFrame:
    """Boxes of tracks on tiles (clip_id, tile, sample_idx), with a label of track and coverage and where it stands.

    boxes and stats as for layout.track_stats. One join by clip and sample, one by clip and track.
    """
    found = shown.select("clip_id", "tile", "sample_idx").join(boxes, ["clip_id", "sample_idx"]).join(stats.select("clip_id", "track_id", "coverage"), ["clip_id", "track_id"])
    label = F.concat(F.lit("#"), F.col("track_id").cast("string"), F.lit(" "), fixed(F.col("coverage") * 100, 0), F.lit("%"))
    rows = found.select("clip_id", "tile", "track_id", *_corners(F.col("x"), F.col("y"), F.col("w"), F.col("h"), scale), label.alias("label"))
    return rows.withColumn("label_y", F.greatest(F.col("y1") - 4, F.lit(12)))


def region_boxes(shown: DataFrame, regions: DataFrame, scale: float = 1.0) -> DataFrame:
    """Crop regions on tiles (clip_id, tile, t), at whole pixels of the source; regions as layout.crop_regions gives them."""
    found = shown.select("clip_id", "tile", "t").join(regions.select("clip_id", F.posexplode("regions").alias("place", "r")), "clip_id")
    at = lambda keys: series.value_at(F.col(keys), F.col("t")).cast("int")
    return found.withColumns({"x": at("r.x_keys"), "y": at("r.y_keys")}).select("clip_id", "tile", "place", *_corners(F.col("x"), F.col("y"), F.col("r.w"), F.col("r.h"), scale))


def title(layout: Column, note: Column, detector: Column, n_samples: int) -> Column:
    return F.concat_ws(" | ", layout, note, F.concat(F.lit("detector="), detector), F.lit(f"samples={n_samples}"))


def summary(plan: DataFrame, metrics: DataFrame, regions: DataFrame, detector: str, n_samples: int) -> DataFrame:
    """clip_id and the JSON beside the sheet: layout, note, detector, samples, the layout's record and the regions.

    plan has clip_id, layout and note; metrics is layout.metrics, regions layout.crop_regions. A clip without regions has none.
    """
    record = metrics.select("clip_id", F.struct(*[c for c in metrics.columns if c != "clip_id"]).alias("classification"))
    rows = plan.select("clip_id", "layout", "note").join(record, "clip_id", "left").join(regions.select("clip_id", "regions"), "clip_id", "left")
    kind = regions.schema["regions"].dataType.simpleString()
    shown = F.transform(F.coalesce("regions", F.array().cast(kind)), lambda r: F.struct(r["track_id"].alias("track"), r["w"].alias("w"), r["h"].alias("h"), r["x_keys"].alias("x_keys"), r["y_keys"].alias("y_keys")))
    return rows.select("clip_id", F.to_json(F.struct("layout", "note", F.lit(detector).alias("detector"), F.lit(n_samples).alias("samples"), "classification", shown.alias("regions"))).alias("json"))
