"""Filter text and command arguments for clips; nothing is run here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numeric import fixed, let

OUT_W, OUT_H = 1080, 1920


def expression(keys: Column) -> Column:
    """Nested text that is linear in t between keyframes (array of t, v); one number if they all but agree."""
    return let(keys, _expression)


def _expression(keys: Column) -> Column:
    first = F.element_at(keys, F.lit(1))
    last = F.element_at(keys, F.lit(-1))
    flat = (F.size(keys) == 1) | F.forall(keys, lambda k: F.abs(k["v"] - first["v"]) < 0.5)
    pairs = F.arrays_zip(F.slice(keys, F.lit(1), F.greatest(F.size(keys) - 1, F.lit(0))).alias("a"), F.slice(keys, F.lit(2), F.greatest(F.size(keys) - 1, F.lit(0))).alias("b"))

    def piece(p: Column) -> Column:
        a, b = p["a"], p["b"]
        dt = F.greatest(b["t"] - a["t"], F.lit(0.001))
        return F.concat(
            F.lit("if(lt(t,"), fixed(b["t"], 3), F.lit("),("), fixed(a["v"], 1), F.lit("+("), fixed(b["v"] - a["v"], 1), F.lit(")*(t-"), fixed(a["t"], 3), F.lit(")/"), fixed(dt, 3), F.lit("),")
        )

    nested = F.concat(F.array_join(F.transform(pairs, piece), ""), fixed(last["v"], 1), F.repeat(F.lit(")"), F.size(pairs)))
    return F.when(flat, fixed(first["v"], 1)).otherwise(nested)


def crop(region: Column) -> Column:
    return F.concat(F.lit("crop="), region["w"].cast("string"), F.lit(":"), region["h"].cast("string"), F.lit(":x='"), expression(region["x_keys"]), F.lit("':y='"), expression(region["y_keys"]), F.lit("'"))


def burn(captions: Column) -> Column:
    """The filter that draws a caption file (its escaped path), with a comma before it; nothing for null."""
    return F.coalesce(F.concat(F.lit(",ass='"), captions, F.lit("'")), F.lit(""))


def filter_graph(layout: Column, regions: Column, captions: Column) -> Column:
    """Filter text of a plan; null for the centre crop, which has no regions."""
    scale = lambda h: F.lit(f",scale={OUT_W}:{h},setsar=1")

    def joined(crops: Column) -> Column:
        one, two = F.try_element_at(crops, F.lit(1)), F.try_element_at(crops, F.lit(2))
        single = F.concat(F.lit("[0:v]"), one, scale(OUT_H), burn(captions), F.lit("[v]"))
        split = F.concat(F.lit("[0:v]split=2[a][b];[a]"), one, scale(OUT_H // 2), F.lit("[top];[b]"), two, scale(OUT_H // 2), F.lit("[bot];[top][bot]vstack=inputs=2"), burn(captions), F.lit("[v]"))
        return F.when(layout == "SINGLE_PERSON", single).when(layout == "TWO_PERSON", split)

    return let(F.transform(regions, crop), joined)


def center_filter(captions: Column) -> Column:
    return F.concat(F.lit(f"scale=w={OUT_W}:h={OUT_H}:force_original_aspect_ratio=increase,crop={OUT_W}:{OUT_H},setsar=1"), burn(captions))


#: Fixed value: how clips are encoded.
ENCODING = [
    "-r", "30",
    "-c:v", "libx264",
    "-preset", "veryfast",
    "-crf", "23",
    "-pix_fmt", "yuv420p",
    "-c:a", "aac",
    "-b:a", "128k",
    "-ac", "2",
    "-movflags", "+faststart",
]
#: Fixed value: how the encoder is called.
ENCODER = ["ffmpeg", "-y", "-hide_banner", "-loglevel", "error"]


def command(source: Column, start: Column, end: Column, option: Column, script: Column, captions: Column, out: Column) -> Column:
    """Arguments that cut and render one clip: with a filter script, or if that is null with the centre filter."""
    texts = lambda words: [F.lit(a) for a in words]
    head = F.array(*texts(ENCODER), F.lit("-ss"), fixed(start, 3), F.lit("-t"), fixed(end - start, 3), F.lit("-i"), source)
    video = F.when(script.isNotNull(), F.array(option, script, *texts(["-map", "[v]", "-map", "0:a?"]))).otherwise(F.array(F.lit("-vf"), center_filter(captions)))
    return F.concat(head, video, F.array(*texts(ENCODING), out))
