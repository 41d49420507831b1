"""Intake of jobs and of their progress as streams, so that a batch that runs again changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scratch import remove
from ..functions.text import is_source_url
from ..sources.jobs import with_status

JOBS = "id string, request_id string, url string, stage string, status string, detail string, error string, accepted boolean"


class Ledger:
    """Tables below a folder that are written batch by batch, and which batches are done.

    A batch's rows of a table are a folder of their own, which running it again replaces as a whole; the batch is entered in
    the ledger after its last table. A batch that the ledger has is not run again, and readers see entered batches only.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def done(self) -> DataFrame:
        return self._read("ledger", "batch_id long, n long")

    def has(self, batch_id: int) -> bool:
        return not self.done().where(F.col("batch_id") == batch_id).isEmpty()

    def write(self, table: str, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{table}/batch={batch_id}")

    def enter(self, batch_id: int, n: int) -> None:
        self.spark.createDataFrame([(batch_id, n)], "batch_id long, n long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/ledger/batch={batch_id}")

    def read(self, table: str, schema: str) -> DataFrame:
        """Rows of the batches that are done, with batch."""
        rows = self._read(table, f"{schema}, batch long")
        return rows.join(self.done().select(F.col("batch_id").alias("batch")), "batch", "left_semi")

    def _read(self, table: str, schema: str) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{table}").parquet(f"{self.folder}/{table}/batch=*")
        except AnalysisException:  # nothing is written yet
            return self.spark.createDataFrame([], schema)

    def forget(self, batch_id: int) -> None:
        """Take a batch back, so that it can be run again."""
        remove(self.spark, f"{self.folder}/ledger/batch={batch_id}")


def accept_jobs(requests: DataFrame) -> DataFrame:
    """A job for each request (request_id, url); its id is made of the request's, so that it is the same in each run.

    Requests that name no known site are kept as rejected, with the reason in error. A request that comes twice is one job.
    """
    once = requests.dropDuplicates(["request_id"])
    ok = F.coalesce(is_source_url(F.col("url")), F.lit(False))
    rows = once.select(
        F.substring(F.sha2(F.col("request_id").cast("binary"), 256), 1, 12).alias("id"), "request_id", F.trim("url").alias("url"),
        F.when(ok, "queued").otherwise("error").alias("stage"), F.lit("").alias("detail"), F.when(~ok, "Please give a video address.").alias("error"), ok.alias("accepted"),
    )
    return with_status(rows).select("id", "request_id", "url", "stage", "status", "detail", "error", "accepted")


def take_batch(ledger: Ledger, requests: DataFrame, batch_id: int) -> int:
    """Enter a batch of requests; the number of new jobs, 0 if the batch is in the ledger. Requests that an earlier batch has
    brought make no second job."""
    if ledger.has(batch_id):
        return 0
    known = ledger.read("jobs", JOBS).where(F.col("batch") != batch_id).select("request_id")
    fresh = accept_jobs(requests).join(known, "request_id", "left_anti").select(*[c.split()[0] for c in JOBS.split(", ")])
    ledger.write("jobs", fresh, batch_id)
    n = ledger.spark.read.schema(JOBS).parquet(f"{ledger.folder}/jobs/batch={batch_id}").count()
    ledger.enter(batch_id, n)
    return n


def start_intake(requests: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run a stream of requests into the jobs below a folder."""
    ledger = Ledger(requests.sparkSession, folder)
    writer = requests.writeStream.foreachBatch(lambda rows, batch_id: take_batch(ledger, rows, batch_id) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_states(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """jobs with the stage, status, detail and error of each one's last event (id, seq, stage, detail, error).

    Events may repeat and come in any order: the largest seq counts, of equal ones the largest stage. Aggregation combines on
    the map side. An event of an unknown job changes nothing.
    """
    last = events.groupBy("id").agg(F.max(F.struct("seq", "stage", "detail", "error")).alias("x")).select("id", F.col("x.stage").alias("s"), F.col("x.detail").alias("d"), F.col("x.error").alias("e"))
    rows = jobs.join(last, "id", "left")
    moved = rows.withColumns({"stage": F.coalesce("s", "stage"), "detail": F.coalesce("d", "detail"), "error": F.coalesce("e", "error")}).drop("s", "d", "e")
    return with_status(moved).select(*jobs.columns)


def admit(jobs: DataFrame, slots: int = 1) -> DataFrame:
    """Of queued jobs (id, stage, arrived) those that a number of slots has room for beside the running ones, by arrival."""
    running = jobs.agg(F.count_if(~F.col("stage").isin("queued", "done", "error"))).first()[0]
    free = max(0, slots - running)
    return jobs.where(F.col("stage") == "queued").orderBy("arrived", "id").limit(free)
