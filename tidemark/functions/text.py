"""Text functions for captions, filters and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import LABELS, STATUS
from .numeric import let


def strip(text: Column) -> Column:
    """Without white space of any kind, non-breaking spaces included, at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def count_words(text: Column) -> Column:
    """Words between white space of any kind; none in a blank text."""
    clean = strip(text)
    return F.when(F.length(clean) > 0, F.size(F.split(clean, r"(?U)\s+"))).otherwise(0)


def ends_in(text: Column, marks: str) -> Column:
    """Whether the last character is one of the marks. The empty text counts as if it were."""
    clean = F.regexp_replace(text, r"(?U)\s+$", "")
    return (F.length(clean) == 0) | F.right(clean, F.lit(1)).isin(list(marks))


def caption_escape(text: Column) -> Column:
    return F.translate(F.replace(text, F.lit("\\"), F.lit("\\\\")), "{}", "()")


def filter_path(path: Column) -> Column:
    for old, new in (("\\", "/"), (":", "\\:"), ("'", "\\'")):
        path = F.replace(path, F.lit(old), F.lit(new))
    return path


def html_escape(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def caption_time(cs: Column) -> Column:
    """H:MM:SS.cc of whole centiseconds; below zero is zero. 59.996 s are 6000 cs, so they carry to the next minute."""
    t = F.greatest(cs.cast("long"), F.lit(0))
    two = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    return F.concat(F.floor(t / 360000).cast("string"), F.lit(":"), two(F.floor(t / 6000) % 60), F.lit(":"), two(F.floor(t / 100) % 60), F.lit("."), two(t % 100))


def clock(seconds: Column) -> Column:
    """M:SS of seconds, cut down to whole ones."""
    s = F.floor(seconds)
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def is_source_url(url: Column, hosts: tuple[str, str] = ("youtube.com/", "youtu.be/")) -> Column:
    clean = F.trim(url)
    return F.contains(clean, F.lit(hosts[0])) | F.contains(clean, F.lit(hosts[1]))


def is_public_file(name: Column) -> Column:
    return name.rlike(r"\Aclip_\d+\.mp4\z")


def resolve(path: Column) -> Column:
    """The parts of an absolute path without "." and "..", which takes back the part before it; links are not followed."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    return F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p))))


def under(root: Column, path: Column) -> Column:
    """Whether a path, taken from root unless it begins with a slash, lies below root once both are resolved."""
    whole = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(root, F.lit("/"), path))
    below = lambda r, p: (F.size(p) > F.size(r)) & (F.slice(p, F.lit(1), F.size(r)) == r)
    return let(resolve(root), lambda r: let(resolve(whole), lambda p: below(r, p)))


def is_served(root: Column, folder: Column, name: Column) -> Column:
    """Whether a job's file may be handed out: a rendered clip by its name, in a folder below root."""
    inside = F.when(F.startswith(name, F.lit("/")), name).otherwise(F.concat(folder, F.lit("/"), name))
    return is_public_file(name) & under(root, inside)


def encoder_major(banner: Column) -> Column:
    """The major version that a banner begins with, null if it names none."""
    return F.nullif(F.regexp_extract(banner, r"\Affmpeg version n?(\d+)\.", 1), F.lit("")).try_cast("int")


def filter_option(major: Column) -> Column:
    return F.when(major < 7, "-filter_complex_script").otherwise("-/filter_complex")


def look_up(value: Column, names: dict[str, str], default: str = "") -> Column:
    out = F.lit(default)
    for k, v in names.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def status_text(stage: Column) -> Column:
    return look_up(stage, STATUS)


def layout_label(layout: Column) -> Column:
    return look_up(layout, LABELS)
