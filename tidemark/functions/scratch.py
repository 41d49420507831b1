"""Tables that a plan writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a session of one process may do without: it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder or tempfile.mkdtemp(prefix="tidemark-")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark can write. The one place that goes through the JVM."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Steps of one computation: each is written as Parquet, which cuts its lineage and survives lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/steps-{uuid.uuid4().hex}"
        self.made = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.folder}/{self.made}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, last: int) -> None:
        """Delete the step of this number, which no plan reads any more."""
        remove(self.spark, f"{self.folder}/{last}")
