"""Intermediate tables in the folder that all executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The application's own folder in spark.checkpoint.dir.

    Where that is unset, a temporary folder is taken if the session runs on this machine alone, and
    on a cluster, whose machines would not see it, it is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        folder = context.getCheckpointDir()
    return f"{folder.rstrip('/')}/{context.applicationId}"


def _place(spark: SparkSession, path: str):
    """A path and its file system, whichever that is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    where, files = _place(spark, path)
    files.delete(where, True)


def is_there(spark: SparkSession, path: str) -> bool:
    where, files = _place(spark, path)
    return files.exists(where)


class Tables:
    """The tables of one run; those that its result does not read are deleted before it is given out."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def table(self, df: DataFrame) -> DataFrame:
        """The rows as Parquet, made once."""
        path = f"{shared_folder(self.spark)}/stage-{uuid.uuid4().hex}"
        df.write.parquet(path)
        made = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(made)] = (path, made)
        return made

    def drop(self, *tables: DataFrame) -> None:
        for made in tables:
            delete(self.spark, self.paths.pop(id(made))[0])

    def keep_only(self, *tables: DataFrame) -> None:
        self.drop(*(made for _, made in list(self.paths.values()) if not any(made is x for x in tables)))


def table(df: DataFrame) -> DataFrame:
    """The rows as Parquet in the shared folder, to be read as long as the application runs."""
    return Tables(df.sparkSession).table(df)
