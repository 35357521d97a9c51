"""Statistics over the visited rows of crawls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frontier import CRAWLED


def crawl_stats(visited: DataFrame, requests: DataFrame) -> DataFrame:
    """Pages, links (before any filter, duplicates included) and times; zeros for a request without a page."""
    found = (
        visited.filter(F.col("outcome") == CRAWLED)
        .groupBy("request_id")
        .agg(
            F.count(F.lit(1)).alias("pages"),
            F.sum("links_found").alias("links"),
            F.min("crawled_at").alias("start_time"),
            F.max("crawled_at").alias("end_time"),
        )
    )
    return requests.select("request_id").join(found, "request_id", "left").select(
        "request_id",
        F.coalesce("pages", F.lit(0)).alias("pages_crawled"),
        F.coalesce("links", F.lit(0)).alias("links_discovered"),
        "start_time",
        "end_time",
    )


def skip_reasons(visited: DataFrame, totals: bool = False) -> DataFrame:
    """Rows per request and outcome; ``totals`` adds the rolled-up counts."""
    keys = ("request_id", "outcome")
    grouped = visited.rollup(*keys) if totals else visited.groupBy(*keys)
    return grouped.agg(F.count(F.lit(1)).alias("urls"))
