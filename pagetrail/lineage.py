"""Intermediate tables in the shared folder of the cluster.

Iterative jobs write each step as a table and go on from there, so that the plan
stays short and a lost executor only costs the tasks it was running.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: tempfile.TemporaryDirectory | None = None


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a scratch folder in local mode."""
    global _own_folder
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_folder is None:
        _own_folder = tempfile.TemporaryDirectory(prefix="pagetrail-")
    return _own_folder.name


def new_folder(spark: SparkSession, label: str) -> str:
    """Path of a folder nobody has used yet."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/{app}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str = "step") -> DataFrame:
    """Write the rows once and return a DataFrame that reads them back."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Steps:
    """Written steps of one job under one folder, which ``close`` deletes when their rows are no longer needed."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.folder = spark, new_folder(spark, label)

    def cut(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{self.folder}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        remove(self.spark, self.folder)
