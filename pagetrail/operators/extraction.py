"""Jobs over the page table: page records and link edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, urls

_DOC = "_doc"


def prepared(pages: DataFrame) -> DataFrame:
    """Adds the prepared page text, so that several fields share the work."""
    return pages.withColumn(_DOC, html.parse("html"))


def parse_pages(
    pages: DataFrame, news: bool = False, extract_links: bool = False
) -> DataFrame:
    """All fields of a page record; one scan, no shuffle.

    ``depth`` and ``crawled_at`` are passed through where the input has them.
    """
    no_links = F.array().cast("array<string>")
    given = set(pages.columns)
    crawled_at = F.col("crawled_at") if "crawled_at" in given else F.lit(None).cast("timestamp")
    depth = F.col("depth") if "depth" in given else F.lit(0)
    return prepared(pages).select(
        *(["page_id"] if "page_id" in given else []),
        "url",
        html.title_of(_DOC).alias("title"),
        html.description_of(_DOC).alias("description"),
        (html.news_of(_DOC) if news else html.paragraphs_of(_DOC)).alias("content"),
        (html.links_of(_DOC, "url") if extract_links else no_links).alias("links"),
        crawled_at.alias("crawled_at"),
        depth.alias("depth"),
    )


def page_texts(
    pages: DataFrame, want_news: Column, want_plain: Column, want_links: Column
) -> DataFrame:
    """Title, description and, row by row, only the other parts asked for."""
    return prepared(pages).select(
        "page_id",
        html.title_of(_DOC).alias("title"),
        html.description_of(_DOC).alias("description"),
        F.when(want_news, html.news_of(_DOC)).alias("news_text"),
        F.when(want_plain, html.paragraphs_of(_DOC)).alias("plain_text"),
        F.when(want_links, html.links_of(_DOC, "url")).alias("links"),
    )


def page_links(pages: DataFrame) -> DataFrame:
    """``page_id, url, links`` of every page."""
    return prepared(pages).select(
        "page_id", "url", html.links_of(_DOC, "url").alias("links")
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """One row per link and position.  Write it once, read it per crawl.

    The outer generator keeps Spark from adding a filter on the size of the
    list below it, which would extract all links a second time.
    """
    exploded = page_links(pages).select(
        "page_id", "url", F.posexplode_outer("links").alias("link_pos", "link")
    )
    return edge_table(
        exploded.filter(F.col("link").isNotNull()).select(
            F.col("page_id").alias("src_id"), F.col("url").alias("src_url"), "link_pos", "link"
        )
    )


def edge_table(links: DataFrame) -> DataFrame:
    """Edges from ``src_id, src_url, link_pos, link``, with keys and hosts."""
    known = links.withColumns(
        {"_src": urls.url_identity("src_url"), "_link": urls.url_identity("link")}
    )
    return known.select(
        "src_id",
        F.col("_src.key").alias("src_key"),
        "src_url",
        F.col("_src.host").alias("src_host"),
        F.col("link_pos").cast("int").alias("link_pos"),
        F.col("link").alias("url"),
        F.col("_link.key").alias("key"),
        F.col("_link.host").alias("host"),
    )
