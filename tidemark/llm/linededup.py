"""Boilerplate lines by their frequency within a site.

Pages are grouped by host. A line that stands on more than a ratio of the host's pages, and on a few pages at least, is
boilerplate and is dropped from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Boilerplate of the given tables stands on 8 to 13 % of a host's pages, the next most frequent lines on under 5 %.
RATIO = 0.05
MIN_PAGES = 5
#: Lists of boilerplate lines are broadcast up to so many lines in all; beyond that hosts are joined by a shuffle.
MAX_BROADCAST = 100_000


def line_key(line: Column) -> Column:
    """128 bits that stand for a line, as text."""
    return F.concat(F.hex(F.xxhash64(line)), F.lit("-"), F.hex(F.xxhash64(F.lit("line"), line)))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def has_word(line: Column) -> Column:
    return line.rlike("[^ \t-\r]")


def boilerplate(pages: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """site and the keys (lines) of its boilerplate lines, of pages (site, text).

    A site has at most its mean number of lines divided by ratio.
    """
    totals = pages.groupBy("site").agg(F.count("*").alias("pages"))
    # Lines are told apart as strings, which hash; structs would be compared pair by pair.
    lines = F.array_distinct(F.filter(lines_of(F.col("text")), has_word))
    seen = pages.select("site", F.explode(lines).alias("line")).select("site", line_key(F.col("line")).alias("key"))
    seen = seen.groupBy("site", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    often = seen.join(totals, "site").where(F.col("n") > ratio * F.col("pages"))
    return often.groupBy("site").agg(F.collect_list("key").alias("lines"))


def drop_boilerplate(docs: DataFrame, host: str | Column = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with the lines taken out of text that stand on over ratio of their host's pages, and n_dropped lines.

    Lines are what newlines part; equal lines of a page count once for it, and all of them go. Lines without a word are
    never dropped. Every row is a page, repeated rows too, so ties and copies count each. Rows of null host make a host of
    their own. A null text stays null, an empty table stays empty. All rows stay, even if no line of theirs does. A column
    n_dropped of docs gives way to the result; other columns keep their names, whatever they are.

    Lines are counted as keys of 128 bits with a partial sum before the shuffle, so a host with a third of all pages is
    no hot spot; lists of boilerplate are short (see boilerplate), and joined by broadcast after their size is checked.
    The work for a page grows with its number of lines, times that of the different boilerplate lines on it.
    """
    site = (F.col(f"`{host}`") if isinstance(host, str) else host).cast("string")
    site = F.coalesce(F.concat(F.lit("="), site), F.lit(""))
    pages = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), site.alias("site"), F.col(f"`{text}`").alias("text"))
    lists = cut(boilerplate(pages.select("site", "text"), ratio, min_pages))
    size = lists.agg(F.sum(F.size("lines")).alias("n")).first()["n"] or 0
    joined = pages.join(F.broadcast(lists) if size <= MAX_BROADCAST else lists, "site", "left")
    all_lines = lines_of(F.col("text"))
    joined = joined.withColumn("gone", F.array_intersect(F.transform(all_lines, line_key), F.col("lines")))
    joined = joined.withColumn("kept", F.when(F.size("gone") > 0, F.filter(all_lines, lambda x: ~F.array_contains("gone", line_key(x)))))
    new = F.when(F.col("kept").isNotNull(), F.array_join("kept", "\n")).otherwise(F.col("text"))
    dropped = F.when(F.col("kept").isNotNull(), F.size(all_lines) - F.size("kept")).otherwise(0).cast("long")
    columns = [c for c in docs.columns if c != "n_dropped"]
    return joined.select(*[new.alias(c) if c == text else F.col(f"row.`{c}`") for c in columns], dropped.alias("n_dropped"))


ORACLE = f"""
WITH lines AS (
  SELECT DISTINCT doc_id, source, line
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents)
  WHERE regexp_matches(line, '[^ \\t-\\r]')
), totals AS (
  SELECT source, count(*) AS pages FROM documents GROUP BY source
), often AS (
  SELECT l.source, l.line FROM lines l JOIN totals t ON l.source = t.source
  GROUP BY l.source, l.line, t.pages
  HAVING count(*) >= {MIN_PAGES} AND count(*) > {RATIO}::DOUBLE * t.pages
), lists AS (
  SELECT source, list(line) AS gone FROM often GROUP BY source
), marked AS (
  SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS lines,
         list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(coalesce(l.gone, []), x)) AS kept
  FROM documents d LEFT JOIN lists l ON d.source = l.source
)
SELECT doc_id, array_to_string(kept, chr(10)) AS text, (len(lines) - len(kept))::BIGINT AS n_dropped FROM marked
"""
