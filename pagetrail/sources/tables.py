"""Readers of the stored inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import PAGES, ROBOTS

#: Parts that a table is dealt out to for each core; several, as some pages take longer than others.
PARTS_PER_CORE = 4


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, url, html``; jobs that need no html do not read that column."""
    return spark.read.schema(PAGES).parquet(path)


def dealt_out(scan: DataFrame) -> DataFrame:
    """The rows of a table as it is read, dealt out to several parts for each task at once.

    Spark reads a row group of a file in one task, and texts that compress well make few of them; where a row costs much
    more than its reading, such as a page that is parsed, those tasks would take all the time.
    """
    parts = max(PARTS_PER_CORE * scan.sparkSession.sparkContext.defaultParallelism, scan.rdd.getNumPartitions())
    return scan.repartition(parts)


def read_robots(spark: SparkSession, path: str) -> DataFrame:
    """``origin, status, body, fetched_at``, one row per fetched robots file."""
    return spark.read.schema(ROBOTS).parquet(path)


def stream_pages(
    spark: SparkSession, folder: str, files_per_batch: int | None = None, names: str = "*.parquet"
) -> DataFrame:
    """Pages as they arrive in a folder of Parquet files of the given names."""
    reader = spark.readStream.schema(PAGES).option("pathGlobFilter", names)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)
