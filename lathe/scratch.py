"""Tables that one piece of work keeps, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share.  Where it is unset, one is made in local mode alone; a cluster has to name one."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(f"{tempfile.gettempdir()}/checkpoints/{uuid.uuid4().hex}")
    return context._jsc.sc().getCheckpointDir().get()


def _located(spark: SparkSession, folder: str):
    """File system and path of a folder, in any store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


class Scratch:
    """Parquet tables of one piece of work, in the shared folder.

    A call writes a frame and gives it back as read from there, so that later jobs neither
    recompute its plan nor lose it with an executor.  ``clear`` removes the tables once
    nothing reads them; what is never cleared goes when the session ends.  ``files`` is the
    most files of a table, for pieces of work that know their size.
    """

    def __init__(self, spark: SparkSession, files: int | None = None):
        self.spark, self.folder, self.n, self.files = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0, files
        system, path = _located(spark, self.folder)
        system.mkdirs(path)
        system.deleteOnExit(path)

    def __call__(self, df: DataFrame) -> DataFrame:
        path, self.n = f"{self.folder}/{self.n}", self.n + 1
        (df.coalesce(self.files) if self.files else df).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        system, path = _located(self.spark, self.folder)
        system.delete(path, True)


def spool(df: DataFrame, files: int | None = None) -> DataFrame:
    """A frame as a Parquet table in the shared folder, which goes when the session ends: for results and for what is read to the end."""
    return Scratch(df.sparkSession, files)(df)
