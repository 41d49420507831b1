"""A sink of one file for each row: captions, filter text and JSON beside the clips that they belong to."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "clip_files"


@dataclass
class Staged(WriterCommitMessage):
    """Files of one task: where they wait, and where they go."""

    files: list[tuple[str, str]]


class ClipFiles(DataSource):
    """Writes the rows (folder, name, value) as text files folder/name below a path that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "folder string, name string, value string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if not {"folder", "name", "value"} <= set(schema.names):
            raise ValueError("columns folder, name and value are needed")
        return ClipFileWriter(self.options["path"], overwrite)


class ClipFileWriter(DataSourceWriter):
    """Tasks write to a folder of the run's own; only a commit of all of them moves files to their places.

    The folder is made before any task runs and renamed before it is deleted, so that a task which is still at work when the run
    is given up finds no place to write to. A null value writes no file. overwrite replaces files of the same name and leaves others alone; without it a name
    that is taken fails the run before any file is moved. A run that fails leaves nothing.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.staged = os.path.join(path, f".staged-{uuid.uuid4().hex}")
        os.makedirs(self.staged)

    def write(self, iterator: Iterator[Row]) -> Staged:
        task = TaskContext.get()
        own = os.path.join(self.staged, f"{task.partitionId()}-{task.taskAttemptId()}")
        files = []
        try:
            for row in iterator:
                if row["value"] is None:
                    continue
                target = os.path.normpath(os.path.join(self.path, row["folder"], row["name"]))
                if not target.startswith(os.path.normpath(self.path) + os.sep):
                    raise ValueError(f"{row['folder']}/{row['name']} lies outside of the path")
                if not files:
                    os.mkdir(own)
                place = os.path.join(own, str(len(files)))
                with open(place, "w", encoding="utf-8", newline="") as f:
                    f.write(row["value"])
                files.append((place, target))
        except BaseException:
            shutil.rmtree(own, ignore_errors=True)
            raise
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        files = [f for m in messages if m for f in m.files]
        try:
            targets = [t for _, t in files]
            if len(set(targets)) < len(targets):
                raise ValueError("two rows name the same file")
            if not self.overwrite and (taken := [t for t in targets if os.path.exists(t)]):
                raise FileExistsError(taken[0])
            for place, target in files:
                os.makedirs(os.path.dirname(target), exist_ok=True)
                os.replace(place, target)
        finally:
            self._close()

    def abort(self, messages: list[Staged | None]) -> None:
        self._close()

    def _close(self) -> None:
        if os.path.isdir(self.staged):
            gone = f"{self.staged}-gone"
            os.rename(self.staged, gone)
            shutil.rmtree(gone, ignore_errors=True)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ClipFiles)


def write_files(rows: DataFrame, path: str, overwrite: bool = True) -> None:
    """Write rows (folder, name, value) by the sink."""
    register(rows.sparkSession)
    rows.select("folder", "name", "value").write.format(NAME).mode("overwrite" if overwrite else "append").save(path)


def clip_names(clips: DataFrame) -> DataFrame:
    """clips (job_id, clip_idx from 0) with folder and the names of what belongs to each: clip_1.mp4 and so on."""
    stem = F.concat(F.lit("clip_"), (F.col("clip_idx") + 1).cast("string"))
    return clips.withColumns({"folder": F.col("job_id"), "clip_file": F.concat(stem, F.lit(".mp4")), "caption_file": F.concat(stem, F.lit(".ass")), "filter_file": F.concat(stem, F.lit(".filter"))})


def side_files(clips: DataFrame) -> DataFrame:
    """What is written beside clips (job_id, clip_idx, captions, graph): a caption file each, and a filter file where there is a graph."""
    named = clip_names(clips)
    both = F.array(F.struct(F.col("caption_file").alias("name"), F.col("captions").alias("value")), F.struct(F.col("filter_file").alias("name"), F.col("graph").alias("value")))
    return named.select("folder", F.explode(both).alias("f")).select("folder", "f.name", "f.value").where("value is not null")
