"""Scores of candidate windows: a heuristic, and replies of a language model in whatever shape they come."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Windows
from ..functions.numeric import fixed, let
from ..functions.text import count_words, ends_in

DEFAULT = Windows()


def heuristic(candidates: DataFrame, c: Windows = DEFAULT) -> DataFrame:
    """candidates with score: dense speech, near the target length, with a clean ending."""
    length = F.col("end_s") - F.col("start_s")
    density = count_words(F.col("text")) / F.greatest(length, F.lit(1.0))
    closeness = F.lit(1.0) - F.abs(length - c.target) / F.lit(c.target)
    ending = F.when(ends_in(F.col("text"), ".!?"), 1.0).otherwise(0.5)
    return candidates.withColumn("score", density * 2 + closeness * 3 + ending * 2)


def prompt_listing(candidates: DataFrame) -> DataFrame:
    """For each job the candidates' ids, whole seconds and texts, one paragraph each; at most as many as the cap."""
    line = F.concat(F.lit("[id="), F.col("id").cast("string"), F.lit("] ("), fixed(F.col("end_s") - F.col("start_s"), 0), F.lit("s) "), F.col("text"))
    lines = F.array_sort(F.collect_list(F.struct("id", line.alias("line"))))
    return candidates.groupBy("job_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("listing"))


def read_reply(raw: str | None) -> dict[int, float] | None:
    """Scores by id in a reply; null if it makes the whole reply unusable.

    A list of objects with id and score, an object with such a list under its first key that holds a list, or an object
    from ids to scores; with text around it if it is a list. Items that do not fit are skipped; the last of an id counts.
    A score that is not a number counts 0.
    """
    text = raw or ""
    found = None
    for part in (text, next(iter(re.findall(r"(?s)\[.*\]", text)), None)):
        try:
            found = json.loads(part) if part is not None else None
            break
        except ValueError:
            continue
    if isinstance(found, dict):
        lists = [v for v in found.values() if isinstance(v, list)]
        found = lists[0] if lists else [{"id": k, "score": v} for k, v in found.items()]
    out: dict[int, float] = {}
    for item in found if isinstance(found, list) else ():
        if isinstance(item, dict) and "id" in item and "score" in item:
            try:
                key, value = int(item["id"]), float(item["score"])
            except (TypeError, ValueError):
                continue
            except OverflowError:
                return None
            out[key] = value if value == value else 0.0
    return out


#: Texts that are taken as numbers without Python; other texts may be numbers too, and are left to it.
WHOLE, NUMBER = r"\A\s*-?[0-9]{1,18}\s*\z", r"\A\s*-?[0-9]{1,18}(\.[0-9]{1,18})?\s*\z"
#: First characters of a text that cannot be JSON, so that a list inside it is looked for.
PROSE = r"\A\s*[^\s\[{\"0-9\-tfnNI]"
ITEMS = "array<struct<id:bigint,score:double>>"


def _strict(raw: Column) -> Column:
    """A JSON text as a variant, null if anything stands behind its value: only then do both wrappings of it hold one value."""
    both = F.struct(F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))).alias("a"), F.try_parse_json(F.concat(F.lit('{"w":'), raw, F.lit("}"))).alias("o"))
    single = lambda x: x["o"].isNotNull() & (F.size(F.try_variant_get(x["a"], "$", "array<variant>")) == 1)
    return let(both, lambda x: F.when(single(x), F.try_variant_get(x["a"], "$[0]", "variant")))


def _number(v: Column, pattern: str, kind: str, numbers: tuple[str, ...]) -> tuple[Column, Column]:
    """A variant's number (null if it has none), and whether that is sure."""
    shape = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    is_text = shape == "STRING"
    plain = F.lit(False)
    for n in numbers:
        plain = plain | F.startswith(shape, F.lit(n))
    value = F.when(plain, F.try_variant_get(v, "$", kind)).when(is_text & text.rlike(pattern), F.trim(text).try_cast(kind))
    none = v.isNull() | shape.rlike("^(VOID|ARRAY|OBJECT)")
    return value, F.coalesce(none | plain | (is_text & text.rlike(pattern)), F.lit(False))


def _item(key: Column, score: Column) -> Column:
    """An item's id and score, whether it counts, and whether all that is sure."""
    i, i_sure = _number(key, WHOLE, "bigint", ("BIGINT",))
    x, x_sure = _number(score, NUMBER, "double", ("BIGINT", "DECIMAL", "DOUBLE"))
    absent = key.isNull() | score.isNull()
    return F.struct(i.alias("id"), x.alias("score"), (i.isNotNull() & x.isNotNull()).alias("counts"), (absent | (i_sure & x_sure)).alias("sure"))


def _listed(items: Column) -> Column:
    is_object = lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT"))
    objects = F.filter(items, lambda x: F.coalesce(is_object(x), F.lit(False)))
    return F.transform(objects, lambda x: _item(F.try_variant_get(x, "$.id", "variant"), F.try_variant_get(x, "$.score", "variant")))


def _mapped(fields: Column) -> Column:
    """Items of an object: those of its only list, or its own keys and values; null if it has several lists."""
    is_list = lambda v: F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), F.lit(False))
    lists = F.filter(F.map_values(fields), is_list)
    own = F.transform(F.map_entries(fields), lambda e: _item(e["key"].cast("variant"), e["value"]))
    return F.when(F.size(lists) == 1, _listed(F.try_variant_get(F.element_at(lists, F.lit(1)), "$", "array<variant>"))).when(F.size(lists) == 0, own)


def read_native(raw: Column) -> Column:
    """Scores by id of a reply as an array of structs id and score, the last of an id; null if read_reply must decide.

    Expressions on variants take lists of objects, alone or in prose, objects with one list, and objects from ids to scores.
    Left are replies that are not strict JSON, objects with several lists (their order counts), repeated keys and numbers
    written in unusual ways.
    """
    listed = F.when(raw.rlike(PROSE), let(F.regexp_extract(raw, r"(?s)\[.*\]", 0), lambda part: F.when(part == "", F.parse_json(F.lit("[]"))).otherwise(_strict(part))))
    found = F.coalesce(_strict(raw), listed)

    def items(v: Column) -> Column:
        shape = F.schema_of_variant(v)
        many = F.when(F.startswith(shape, F.lit("ARRAY")), _listed(F.try_variant_get(v, "$", "array<variant>"))).when(F.startswith(shape, F.lit("OBJECT")), _mapped(F.try_variant_get(v, "$", "map<string,variant>")))
        return F.when(shape.rlike("^(ARRAY|OBJECT)"), many).otherwise(F.array().cast("array<struct<id:bigint,score:double,counts:boolean,sure:boolean>>"))

    def last(all_items: Column) -> Column:
        counted = F.transform(F.filter(all_items, lambda x: x["counts"]), lambda x, i: F.struct(x["id"].alias("id"), (-i).alias("back"), x["score"].alias("score")))
        ordered = F.array_sort(counted)
        first = lambda o: F.filter(o, lambda x, i: (i == 0) | (F.get(o, i - 1)["id"] != x["id"]))
        return F.transform(let(ordered, first), lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score")))

    return let(found, lambda v: F.when(v.isNotNull(), let(items(v), lambda x: F.when(F.forall(x, lambda i: i["sure"]), last(x)))))


def parse_replies(replies: DataFrame) -> DataFrame:
    """job_id, id and score of (job_id, raw) rows: by expressions where these are sure, by an Arrow function for what is left."""

    @F.pandas_udf(ITEMS)
    def parsed(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: [{"id": k, "score": v} for k, v in (read_reply(x) or {}).items() if abs(k) < 2**63])

    rows = replies.select("job_id", "raw", read_native(F.coalesce("raw", F.lit(""))).alias("native"))
    left = rows.where("native is null").select("job_id", parsed("raw").alias("native"))
    both = rows.where("native is not null").select("job_id", "native").unionByName(left)
    return both.select("job_id", F.explode("native").alias("x")).select("job_id", F.col("x.id").cast("long").alias("id"), F.col("x.score").alias("score"))


def last_scores(rows: DataFrame) -> DataFrame:
    """Of (job_id, id, pos, score) rows the score at the last position of each id."""
    return rows.groupBy("job_id", "id").agg(F.max_by("score", "pos").alias("score"))


def join_scores(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """candidates with score, 0 where there is none; scores of other ids are ignored."""
    return candidates.join(scores.select("job_id", F.col("id").cast("int").alias("id"), "score"), ["job_id", "id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def ranking_note(ranked: Column, model: Column, failure: Column, service: str = "Ollama") -> Column:
    """Which ranker a job's scores are from: the model, or the heuristic and the kind of failure that led to it."""
    return F.when(ranked, F.concat(F.lit("ranked by "), model)).otherwise(F.concat(F.lit(f"{service} unavailable ("), failure, F.lit("); used heuristic ranking")))


def rank(candidates: DataFrame, scores: DataFrame, model: str = "model", c: Windows = DEFAULT, failures: DataFrame | None = None) -> DataFrame:
    """candidates with score and note: replies' scores for jobs that have any, else the heuristic for all of the job.

    failures (job_id, error) are of jobs whose scorer failed: the kind of error goes into the note. A reply without scores
    is a ValueError.
    """
    has = scores.select("job_id").distinct().withColumn("has", F.lit(True))
    both = heuristic(candidates, c).withColumnRenamed("score", "own").join(scores.select("job_id", F.col("id").cast("int").alias("id"), "score"), ["job_id", "id"], "left").join(has, "job_id", "left")
    kind = F.lit("ValueError")
    if failures is not None:
        both = both.join(failures.groupBy("job_id").agg(F.min("error").alias("failed")), "job_id", "left")
        kind = F.coalesce(F.substring_index("failed", ":", 1), kind)
    used = F.coalesce("has", F.lit(False))
    note = ranking_note(used, F.lit(model), kind)
    return both.withColumn("note", note).withColumn("score", F.when(used, F.coalesce("score", F.lit(0.0))).otherwise(F.col("own"))).drop("own", "has", "failed")
