"""What came of a fetch, and which stored page answers an address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls

FETCH_ERROR = "fetch_error"
BAD_STATUS = "bad_status"
NON_HTML = "non_html"
OK = "ok"


def fetch_outcome(status: Column, content_type: Column, error: Column) -> Column:
    """Only a complete answer with status 200 and an html type is used."""
    is_html = content_type.contains("text/html") | content_type.contains("application/xhtml+xml")
    return (
        F.when(error.isNotNull() | status.isNull(), F.lit(FETCH_ERROR))
        .when(status != 200, F.lit(BAD_STATUS))
        .when(~F.coalesce(is_html, F.lit(False)), F.lit(NON_HTML))
        .otherwise(F.lit(OK))
    )


def classify_fetch(fetch_log: DataFrame) -> DataFrame:
    """Adds ``outcome`` to a log with status, content_type and error."""
    return fetch_log.withColumn(
        "outcome", fetch_outcome(F.col("status"), F.col("content_type"), F.col("error"))
    )


def _answers(pages: DataFrame) -> DataFrame:
    """key, address (the stored one without its fragment) and what came of each page."""
    if {"status", "content_type", "error"} <= set(pages.columns):
        pages = classify_fetch(pages)
    else:
        pages = pages.withColumn("outcome", F.lit(OK))
    for name, kind in (("crawled_at", "timestamp"), ("links_found", "bigint")):
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(None).cast(kind))
    return pages.select(
        urls.canonical_key("url").alias("key"), address_of("url").alias("address"), F.struct(*ANSWER).alias("answer")
    ).filter(F.col("key").isNotNull())


ANSWER = ("page_id", "outcome", "crawled_at", "links_found")


def address_of(url: str) -> Column:
    """What is fetched for an address: all of it but the fragment."""
    return F.substring_index(F.col(url), "#", 1)


def page_index(pages: DataFrame) -> DataFrame:
    """One row per canonical key: the stored page that answers it.

    Several pages may share a key (their query strings differ); the smallest id
    stands for all.  ``pages`` may be a fetch log; without its columns every
    page counts as fetched.  ``crawled_at`` and ``links_found`` are kept where they exist.
    """
    best = _answers(pages).groupBy("key").agg(F.min("answer").alias("best"))
    return best.select("key", "best.*")


def address_index(pages: DataFrame) -> DataFrame:
    """One row per stored address whose key other addresses share, too."""
    known = _answers(pages)
    shared = known.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    best = known.join(shared, "key", "left_semi").groupBy("address").agg(F.min("answer").alias("best"))
    return best.select("address", "best.*")


def answers_for(rows: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Indexes for ``answer`` of just the pages that can answer ``rows`` (url, key).

    Pages meet the distinct keys of ``rows`` before anything of them is shuffled, so what is grouped depends on the rows,
    not on the table.  An address has one key, so one grouping by both serves both indexes.
    """
    wanted = rows.select("key").filter(F.col("key").isNotNull()).distinct()
    best = _answers(pages).join(wanted, "key", "left_semi").groupBy("key", "address").agg(F.min("answer").alias("best"))
    by_key = best.groupBy("key").agg(F.min("best").alias("best"))
    return by_key.select("key", "best.*"), best.select("address", "best.*")


def answer(rows: DataFrame, index: DataFrame, exact: DataFrame) -> DataFrame:
    """Adds the columns of ANSWER to rows with url and key: the page stored under just this address,
    else the one that stands for the key, else nulls."""
    by_key = index.select("key", F.struct(*ANSWER).alias("_by_key"))
    by_address = exact.select(F.col("address").alias("_address"), F.struct(*ANSWER).alias("_by_address"))
    found = (
        rows.withColumn("_address", address_of("url"))
        .join(by_key.hint("merge"), "key", "left")
        .join(by_address.hint("merge"), "_address", "left")
        .withColumn("_found", F.coalesce("_by_address", "_by_key"))
    )
    return found.select(*rows.columns, "_found.*")
