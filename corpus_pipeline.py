"""Cleaning of a training corpus in five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, linededup, neardup, toxicity, winnow
from tidemark.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of the labelled ones rejects go."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic")
    chain = toxicity.train(docs.select(F.col("doc_id").alias("id"), "text"), labels)
    return toxicity.drop_toxic(docs, chain)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go; all documents stay, and n_chars counts what is left."""
    clean = linededup.drop_boilerplate(docs)
    changed = F.col("n_dropped") > 0
    return clean.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document of the smallest doc_id stays."""
    return neardup.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return winnow.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with the hashes of ids and decoded text."""
    return bpe.encode_texts(docs, keep=["doc_id", "lang", "source"])


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_copies), ("decontamination", drop_leaks), ("bpe", encode)]

#: The first stage's model, fingerprints and token ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage leaves is written to the shared folder and read again; then what the stage
    before it left is deleted, so that only the result stays.

    Nulls in any column, texts without words, rows and ids that repeat, an empty table and columns of any names are taken
    as each operator's docstring says. A null text passes the filters as an empty one; of all such one document stays.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        before = out
    return docs
