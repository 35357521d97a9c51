"""Page records as JSON or CSV files, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import PAGE_DATA, PAGE_FIELDS

# The header of a CSV file.
CSV_HEADER = ("URL", "Title", "Description", "Content", "Links", "CrawledAt", "Depth")

_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"


def _rfc3339(at: Column) -> Column:
    """Time with zone; the fraction without closing zeros, if there is one."""
    fraction = F.rtrim(F.date_format(at, "SSSSSS"), F.lit("0"))
    shown = F.when(fraction == "", F.lit("")).otherwise(F.concat(F.lit("."), fraction))
    return F.concat(F.date_format(at, _SECONDS), shown, F.date_format(at, "XXX"))


def json_lines(page_data: DataFrame) -> DataFrame:
    """Adds ``value``, the JSON object of each record; empty parts are left out."""
    record = F.struct(
        "url",
        "title",
        "description",
        F.when(F.col("content") != "", F.col("content")).alias("content"),
        F.when(F.size("links") > 0, F.col("links")).alias("links"),
        _rfc3339(F.col("crawled_at")).alias("crawled_at"),
        "depth",
    )
    return page_data.withColumn("value", F.to_json(record))


def write_json(page_data: DataFrame, path: str, as_array: bool = False) -> None:
    """One object per line.  With ``as_array`` the part files, read one after
    the other, are a single JSON array, in the order of the crawl.

    The array is written by all tasks together: brackets are lines of their
    own, and every object but the very first follows a comma.
    """
    lines = json_lines(page_data)
    if as_array:
        order = [c for c in ("request_id", "depth", "path", "url") if c in page_data.columns]
        is_first = F.monotonically_increasing_id() == 0
        rows = lines.orderBy(*order).select(
            F.when(is_first, F.col("value"))
            .otherwise(F.concat(F.lit(","), F.col("value")))
            .alias("value")
        )
        edge = page_data.sparkSession.range(0, 1, 1, 1)
        lines = (
            edge.select(F.lit("[").alias("value"))
            .union(rows)
            .union(edge.select(F.lit("]").alias("value")))
        )
    lines.select("value").write.mode("overwrite").text(path)


def csv_rows(page_data: DataFrame) -> DataFrame:
    """The columns of the CSV file; links are joined by commas, unescaped."""
    values = (
        F.col("url"),
        F.col("title"),
        F.col("description"),
        F.col("content"),
        F.array_join("links", ","),
        F.date_format("crawled_at", f"{_SECONDS}XXX"),
        F.col("depth").cast("string"),
    )
    return page_data.select(*(v.alias(n) for v, n in zip(values, CSV_HEADER)))


def write_csv(page_data: DataFrame, path: str) -> None:
    csv_rows(page_data).write.mode("overwrite").options(
        header=True,
        escape='"',
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(path)


def write_results(page_data: DataFrame, path: str, fmt: str = "json") -> None:
    """``csv`` or ``json``; any other name means JSON, too."""
    if fmt == "csv":
        write_csv(page_data, path)
    else:
        write_json(page_data, path)


def read_results(spark: SparkSession, path: str, one_document: bool = False) -> DataFrame:
    """Page records of a JSON result.

    Results of ``write_json`` have one object per line and are read in
    parallel.  ``one_document`` is for files of other writers that hold one
    array each, which one task per file has to read.
    """
    raw = T.StructType(
        [
            T.StructField(f.name, T.StringType() if f.name == "crawled_at" else f.dataType)
            for f in PAGE_DATA
        ]
    )
    if one_document:
        rows = spark.read.schema(raw).option("multiLine", True).json(path)
    else:
        line = F.regexp_replace("value", r"^[\[,]", "")
        rows = (
            spark.read.text(path)
            .select(line.alias("value"))
            .filter(F.col("value").startswith("{"))
            .select(F.from_json("value", raw).alias("r"))
            .select("r.*")
        )
    return rows.withColumns(
        {
            "content": F.coalesce("content", F.lit("")),
            "links": F.coalesce("links", F.array().cast("array<string>")),
            "crawled_at": F.col("crawled_at").cast("timestamp"),
        }
    ).select(*PAGE_FIELDS)
