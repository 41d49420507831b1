"""Queries opN_<name> of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, licenses, linededup, lm, merges, merkle, quality, simhash, spelling, substrings, toxicity, winnow
from .common import crc_mod, table


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("removed_spans")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"], with_ids=False)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod("doc_id", 3) == 1
    model = langid.train(docs.where(~held_out).select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label")))
    found = langid.identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "text", "n_dropped")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *[F.round(c, 6).alias(c) for c in ("class_distance", "word_distance")])


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), crc_mod("doc_id", 10) != 0)
    return found.select("doc_id", (crc_mod("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").where(crc_mod("id", 5) != 0)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic").where(crc_mod("id", 5) != 0)
    chain = toxicity.train(docs, labels)
    found = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), chain, keep=["doc_id"])
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted", F.size("toxic_spans").cast("long").alias("n_spans"))


def op9_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", "license", F.round("dice", 6).alias("dice"), "n_matches")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    more = F.when(crc_mod("doc_id", 7) == 0, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    found = merkle.manifest(docs, change={"n_chars": more})
    proof = merkle.path_digest(F.col("path")).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op13_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merges.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substrings, op2_bpe, op3_langid, op4_simhash, op5_lines, op6_quality, op7_lm, op8_toxicity, op9_winnow, op10_licenses, op11_spelling, op12_manifest, op13_tokens)}


def oracle_sql() -> dict[str, str]:
    return {"op5_lines": linededup.ORACLE, "op6_quality": quality.ORACLE, "op11_spelling": spelling.ORACLE, "op12_manifest": merkle.ORACLE}
