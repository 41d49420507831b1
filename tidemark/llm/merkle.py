"""Merkle manifest of a dataset: a hash tree over the rows of each group, and a tree over the groups' roots.

Ordered leaves are cut into blocks of fixed size. Higher-order functions collapse a block level by level within its row
(sequence and transform for a level, slice for its runs, aggregate over levels); the roots of blocks are the leaves of the
next round, until one node of each group remains. Proofs go the other way, from the last round's blocks to the leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import let
from .common import cut
from .sqltext import crc32_sql, utf8_codes

#: log2 of the number of leaves in a block: a block's row takes about 1 MB with its proofs.
DEPTH = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_of(values: list[Column]) -> Column:
    """Hash of a row's values: of each its length in bytes, a colon and its text, a dash for null."""
    texts = [v.cast("string") for v in values]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def rank_rows(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """rows with place (from 0, by rising order within by; nulls first) and n (rows of that by).

    Rows are dealt by ranges of (by, order) and sorted within them. Only the number of rows of each by in each range is
    summed up, so that no group, however large, meets in one task.
    """
    spread = cut(rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order))
    at = spread.withColumn("range_no", F.spark_partition_id()).withColumn("row_no", F.monotonically_increasing_id())
    runs = at.groupBy(by, "range_no").agg(F.min("row_no").alias("first_row"), F.count("*").alias("run"))
    own = Window.partitionBy(by)
    before = F.coalesce(F.sum("run").over(own.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col(by).alias("run_by"), F.col("range_no").alias("run_range"), "first_row", before.alias("before"), F.sum("run").over(own).alias("n"))
    found = at.join(runs, (F.col("range_no") == F.col("run_range")) & F.col(by).eqNullSafe(F.col("run_by")))
    return found.select(*rows.columns, (F.col("row_no") - F.col("first_row") + F.col("before")).alias("place"), "n")


def levels_to(n: Column, depth: int) -> Column:
    """Levels that n nodes collapse by within one block: to its root if more blocks follow, else until one node remains."""
    return F.when(n <= 1, 0).otherwise(F.least(F.length(F.bin(n - 1)), F.lit(depth)))


def collapse(level: Column) -> Column:
    """The hashes of every two consecutive nodes; an odd last one alone."""
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(level, i * 2 + 1, F.lit(2)), "")))


def block_levels(hashes: Column, depth: Column) -> Column:
    """All levels of a block from its leaves to its root."""
    steps = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(hashes), lambda levels, _: let(F.element_at(levels, F.lit(-1)), lambda last: F.concat(levels, F.array(collapse(last)))))


def path_of(levels: Column, i: Column, depth: Column) -> Column:
    """Siblings of leaf i of a block, from below: hash (null where a node stands alone) and whether it stands to the left."""
    steps = F.when(depth > 0, F.sequence(F.lit(0), depth - 1)).otherwise(F.array().cast("array<int>"))

    def sibling(level: Column) -> Column:
        at = F.call_function("shiftright", i, level)
        other = F.when(at % 2 == 1, at - 1).otherwise(at + 1)
        return F.struct(F.try_element_at(F.element_at(levels, level + 1), other + 1).alias("hash"), (at % 2 == 1).alias("left"))

    return F.transform(steps, sibling)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, s: digest(F.when(s["hash"].isNull(), node).when(s["left"], F.concat(s["hash"], node)).otherwise(F.concat(node, s["hash"]))))


class Tree:
    """Blocks of ranked nodes (by, place, n, hash and other columns), round over round, each written to the shared folder."""

    def __init__(self, nodes: DataFrame, by: str, depth: int = DEPTH):
        self.by, self.depth = by, depth
        self.extra = [c for c in nodes.columns if c not in (by, "place", "n", "hash")]
        size = 1 << depth
        largest = None
        self.rounds: list[DataFrame] = []
        while True:
            item = F.struct("place", "hash", *(self.extra if not self.rounds else []))
            block = F.floor(F.col("place") / size).cast("long")
            blocks = cut(nodes.groupBy(by, block.alias("block")).agg(F.array_sort(F.collect_list(item)).alias("nodes"), F.first("n").alias("n")))
            self.rounds.append(blocks)
            if largest is None:
                largest = blocks.agg(F.max("n")).first()[0] or 0
            levels = block_levels(F.transform("nodes", lambda x: x["hash"]), levels_to(F.col("n"), depth))
            roots = blocks.select(by, F.col("block").alias("place"), F.ceil(F.col("n") / size).cast("long").alias("n"), F.element_at(F.element_at(levels, F.lit(-1)), F.lit(1)).alias("hash"))
            if largest <= size:
                break
            nodes, largest = roots, -(-largest // size)
        self.roots = roots.select(by, "hash")

    def paths(self, above: DataFrame) -> DataFrame:
        """by, the other columns, hash and path of every leaf; above has by, path and more columns for each root."""
        more = [c for c in above.columns if c not in (self.by, "path")]
        up = above.withColumn("up_block", F.lit(0).cast("long"))
        for k in range(len(self.rounds) - 1, -1, -1):
            extra = self.extra if k == 0 else []
            up = up.withColumnsRenamed({self.by: "up_by", "path": "up_path"})
            rows = self.rounds[k].join(up, (F.col("block") == F.col("up_block")) & F.col(self.by).eqNullSafe(F.col("up_by")))
            depth = levels_to(F.col("n"), self.depth)
            with_path = let(
                block_levels(F.transform("nodes", lambda x: x["hash"]), depth),
                lambda levels: F.transform(
                    "nodes",
                    lambda x, i: F.struct(x["place"].alias("place"), x["hash"].alias("hash"), *[x[c].alias(c) for c in extra], F.concat(path_of(levels, i, depth), F.col("up_path")).alias("path")),
                ),
            )
            found = rows.select(self.by, *more, F.explode(with_path).alias("x"))
            up = found.select(self.by, *more, F.col("x.place").alias("up_block"), F.col("x.path").alias("path"), *([F.col("x.hash").alias("hash"), *[F.col(f"x.{c}").alias(c) for c in extra]] if k == 0 else []))
        return up.drop("up_block")


def manifest(docs: DataFrame, by: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, change: dict[str, Column] | None = None, depth: int = DEPTH) -> DataFrame:
    """Of each row of docs: by, order, leaf (its hash), subroot (of its by), root (of all), and path (siblings from the leaf
    to the root). change gives columns new values: then folded is the root that the changed row and its path give.

    Leaves ascend by order within by, nulls first; rows that tie there ascend by leaf, so that the roots do not depend on
    how rows are read. Equal rows are leaves of their own, in any order. A null value is no empty text. An empty table
    gives no rows. Other columns do not count, whatever their names. Texts are hashed whole where they are read; only hashes
    are shuffled. A group of any size is dealt over all tasks.
    """
    changed = {f: (change or {}).get(f, F.col(f"`{f}`")) for f in fields}
    rows = docs.select(
        F.col(f"`{by}`").alias("by"), F.col(f"`{order}`").alias("row_key"), leaf_of([F.col(f"`{f}`") for f in fields]).alias("hash"), leaf_of(list(changed.values())).alias("other"),
        F.monotonically_increasing_id().alias("salt"),
    ).withColumn("other", F.when(F.col("other") != F.col("hash"), F.col("other")))
    ranked = rank_rows(cut(rows), "by", ["row_key", "hash", "salt"]).drop("salt")
    groups = Tree(ranked, "by", depth)
    tops = groups.roots.select(F.lit(0).alias("all"), F.col("by").alias("group"), "hash")
    whole = Tree(rank_rows(tops, "all", ["group"]), "all", depth)
    root = whole.roots.select("all", F.array().cast("array<struct<hash:string,left:boolean>>").alias("path"), F.col("hash").alias("root"))
    above = whole.paths(root).select(F.col("group").alias("by"), "path", F.col("hash").alias("subroot"), "root")
    found = groups.paths(above)
    out = [F.col("by").alias(by), F.col("row_key").alias(order), F.col("hash").alias("leaf"), "subroot", "root", "path"]
    return found.select(*out, *([fold(F.coalesce("other", "hash"), F.col("path")).alias("folded")] if change else []))


def path_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda s: s["hash"]), ""))


def _leaf_sql(n_chars: str) -> str:
    values = ("CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text")
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


_UP = "list_transform(range(0, (len(hs) + 1) // 2), lambda k: sha256(hs[2 * k + 1] || coalesce(hs[2 * k + 2], '')))"
_STEP = "CASE WHEN s.h IS NULL THEN 'N' WHEN (l.i >> v.level) & 1 = 1 THEN 'L' || s.h ELSE 'R' || s.h END"
ORACLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, leaf, other, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
  FROM (SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, CASE WHEN {crc32_sql(utf8_codes("coalesce(CAST(doc_id AS VARCHAR), '')"))} % 7 = 0 THEN {_leaf_sql("(n_chars::HUGEINT + 1)")} END AS other FROM documents)
), levels AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY i) AS hs FROM leaves GROUP BY lang
  UNION ALL SELECT lang, level + 1, {_UP} FROM levels WHERE len(hs) > 1
), nodes AS (
  SELECT lang, level, unnest(hs) AS h, unnest(range(0, len(hs))) AS k FROM levels
), subroots AS (
  SELECT lang, hs[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM levels WHERE len(hs) = 1
), tops AS (
  SELECT 0 AS level, list(subroot ORDER BY i) AS hs FROM subroots
  UNION ALL SELECT level + 1, {_UP} FROM tops WHERE len(hs) > 1
), top_nodes AS (
  SELECT level, unnest(hs) AS h, unnest(range(0, len(hs))) AS k FROM tops
), low AS (
  SELECT l.doc_id, l.lang, l.leaf, l.other, l.i, list({_STEP} ORDER BY v.level) FILTER (v.level IS NOT NULL) AS steps
  FROM leaves l LEFT JOIN (SELECT lang, level FROM levels WHERE len(hs) > 1) v ON v.lang IS NOT DISTINCT FROM l.lang
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = v.level AND s.k = xor(l.i >> v.level, 1)
  GROUP BY ALL
), high AS (
  SELECT l.lang, l.subroot, list({_STEP} ORDER BY v.level) FILTER (v.level IS NOT NULL) AS steps
  FROM subroots l LEFT JOIN (SELECT level FROM tops WHERE len(hs) > 1) v ON true LEFT JOIN top_nodes s ON s.level = v.level AND s.k = xor(l.i >> v.level, 1)
  GROUP BY l.lang, l.subroot
), joined AS (
  SELECT a.doc_id, a.leaf, a.other, b.subroot, (SELECT hs[1] FROM tops WHERE len(hs) = 1) AS root, list_concat(coalesce(a.steps, []), coalesce(b.steps, [])) AS steps
  FROM low a JOIN high b ON a.lang IS NOT DISTINCT FROM b.lang
), folded AS (
  SELECT *, list_reduce(list_concat([coalesce(other, leaf)], steps), lambda a, s: sha256(CASE s[1] WHEN 'N' THEN a WHEN 'L' THEN s[2:] || a ELSE a || s[2:] END)) AS folded_root FROM joined
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(list_filter(steps, lambda s: s <> 'N'), lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
