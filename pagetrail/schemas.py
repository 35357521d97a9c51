"""Column layouts of the tables read and written."""

from __future__ import annotations

from pyspark.sql import types as T

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

ROBOTS = T.StructType(
    [
        T.StructField("origin", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("body", T.StringType()),
        T.StructField("fetched_at", T.TimestampType()),
    ]
)

PAGE_DATA = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("links", T.ArrayType(T.StringType())),
        T.StructField("crawled_at", T.TimestampType()),
        T.StructField("depth", T.IntegerType()),
    ]
)

PAGE_FIELDS = PAGE_DATA.fieldNames()
