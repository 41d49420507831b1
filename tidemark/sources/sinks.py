"""Writers: one folder for each job or clip, JSON or text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the head of a caption file, with the place of captions left open.
HEADER = """[Script Info]
ScriptType: v4.00+
PlayResX: 1080
PlayResY: 1920
WrapStyle: 0

[V4+ Styles]
Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding
Style: Default,Arial,72,&H00FFFFFF,&H00FFFFFF,&H00000000,&H80000000,-1,0,0,0,100,100,0,0,1,5,2,{alignment},60,60,420,1

[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
"""


def caption_files(lines: DataFrame, split: bool = False) -> DataFrame:
    """One text for each clip: the header and its lines in order. split puts captions in the middle."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "line"))), lambda x: x["line"])
    text = F.concat(F.lit(HEADER.format(alignment=5 if split else 2)), F.array_join(ordered, "\n"), F.lit("\n"))
    return lines.groupBy("job_id", "clip_idx").agg(text.alias("value"))


def write_text(rows: DataFrame, path: str, by: list[str], value: str = "value") -> None:
    """value of each row as a text file in folders by the other columns."""
    rows.select(*by, F.col(value).alias("value")).write.partitionBy(*by).mode("overwrite").option("lineSep", "\n").text(path)


def write_json(rows: DataFrame, path: str, by: list[str]) -> None:
    rows.write.partitionBy(*by).mode("overwrite").json(path)


def as_json(rows: DataFrame, key: str) -> DataFrame:
    """Each row as one JSON text beside its key."""
    return rows.select(key, F.to_json(F.struct(*[c for c in rows.columns if c != key])).alias("json"))
