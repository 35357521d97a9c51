"""Inputs that are derived from the given tables.

The page table holds no fetch log, robots files or crawl requests, and none of
its links leads to another stored page.  These tables supply them: a link tree
per host, fetch results, robots files and one request per page, all made from
the rows of ``pages`` and ``events``.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail.functions import html
from pagetrail.lineage import cut_lineage
from pagetrail.operators import extraction, ordered
from pagetrail.operators import requests as rq
from pagetrail.plans.crawl import Crawl, Site, crawl, prepare
from pagetrail.sources import tables

AGENT = "TestBot/1.0"
START = 1_704_067_200  # 2024-01-01 00:00:00 UTC


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_pages(spark, f"{sf_dir}/pages.parquet")


def dealt_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages for queries that parse them: in many parts, however few row groups the table has."""
    return tables.dealt_out(pages(spark, sf_dir))


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, host, page_key and rank of each page within its host."""
    known = pages(spark, sf_dir).select(
        "page_id",
        "url",
        F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"),
        F.regexp_extract("url", "^([^?#]+)", 1).alias("page_key"),
    )
    ranked = ordered.row_number(known, ["host"], ["page_id"], "rn")
    return ranked.withColumn("rn", F.col("rn") - 1)


def site_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_id, src_url, link_pos, link: a binary tree per host, with links back,
    across hosts, with fragments and queries, and to pages that are missing."""
    site = site_pages(spark, sf_dir)
    n = pages(spark, sf_dir).count()
    slots = F.array(*(F.struct(F.lit(p).alias("pos"), F.lit(k).alias("k")) for p, k in
                      ((0, 1), (1, 2), (2, 0), (4, 1), (5, 2))))
    wanted = site.select("page_id", "url", "host", "rn", F.inline(slots)).withColumn(
        "to_rn", F.when(F.col("k") == 0, F.lit(0)).otherwise(2 * F.col("rn") + F.col("k"))
    )
    target = site.select(
        "host", F.col("rn").alias("to_rn"), F.col("url").alias("to_url"), "page_key"
    )
    tree = wanted.join(target, ["host", "to_rn"]).select(
        F.col("page_id").alias("src_id"),
        F.col("url").alias("src_url"),
        F.col("pos").alias("link_pos"),
        F.when(F.col("pos") == 4, F.concat("page_key", F.lit("#again")))
        .when(F.col("pos") == 5, F.concat("page_key", F.lit("?ref=1")))
        .otherwise(F.col("to_url"))
        .alias("link"),
    )
    following = site.select(
        ((F.col("page_id") + n - 1) % n).alias("src_id"), F.col("url").alias("link")
    )
    across = site.select(F.col("page_id").alias("src_id"), F.col("url").alias("src_url")).join(
        following, "src_id"
    ).select("src_id", "src_url", F.lit(3).alias("link_pos"), "link")
    missing = site.select(
        F.col("page_id").alias("src_id"),
        F.col("url").alias("src_url"),
        F.lit(6).alias("link_pos"),
        F.concat(F.lit("https://"), "host", F.lit("/missing/"), F.col("rn").cast("string")).alias("link"),
    )
    return tree.unionByName(across).unionByName(missing)


#: Added to the id of a page for a second page that is stored under the same path with a query.
SECOND = 1_000_000_000


def stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, and for every third a second one whose address differs only in its query."""
    first = pages(spark, sf_dir).select("page_id", "url", "html")
    second = first.filter(F.col("page_id") % 3 == 0).select(
        (F.col("page_id") + SECOND).alias("page_id"),
        F.concat(F.regexp_extract("url", "^([^?#]+)", 1), F.lit("?ref=1")).alias("url"),
        F.replace("html", F.lit("<title>"), F.lit("<title>v2 ")).alias("html"),
    )
    return first.unionByName(second)


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fetch result per stored page."""
    i = F.col("page_id")
    return stored_pages(spark, sf_dir).select(
        "page_id",
        "url",
        F.when(i % 13 == 5, 404).when(i % 17 == 3, 500).otherwise(200).alias("status"),
        F.when(i % 11 == 7, "application/pdf")
        .when(i % 7 == 2, "application/xhtml+xml")
        .when(i % 19 == 4, "Text/HTML")
        .otherwise("text/html; charset=utf-8")
        .alias("content_type"),
        F.when(i % 23 == 9, "timeout").alias("error"),
        F.timestamp_seconds(i % SECOND + START).alias("crawled_at"),
        "html",
    )


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One robots file per origin."""
    kind = F.length("origin") % 4
    body = (
        F.when(kind == 0, "User-agent: *\nDisallow: /en/1\nAllow: /en/\nCrawl-delay: 2")
        .when(
            kind == 1,
            "# note\nUser-agent: TestBot/1.0\nAllow: /de/1\nDisallow: /de\n"
            "User-agent: *\nDisallow: /\nCrawl-delay: 0.5",
        )
        .when(kind == 2, "gone")
        .otherwise(
            "User-agent: TestBot/1.0\nUser-agent: Other\nDisallow: /fr\nCrawl-delay: abc"
        )
    )
    return (
        pages(spark, sf_dir)
        .select(F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1).alias("origin"))
        .distinct()
        .select(
            "origin",
            F.when(kind == 2, 404).otherwise(200).alias("status"),
            body.alias("body"),
            F.timestamp_seconds(F.lit(START)).alias("fetched_at"),
        )
    )


def crawl_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per page, some of them out of bounds or incomplete."""
    i = F.col("page_id")
    null = F.lit(None).cast("bigint")
    return pages(spark, sf_dir).select(
        i.alias("request_id"),
        F.when(i % 10 == 9, F.concat(F.lit("ftp://"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1))).otherwise(F.col("url")).alias("url"),
        F.when(i % 4 == 3, null).otherwise(i % 4).alias("depth"),
        F.when(i % 5 == 0, null).when(i % 5 == 4, 101).otherwise(i % 5 + 4).alias("max_pages"),
        null.alias("workers"),
        (i % 12).alias("delay"),
        null.alias("timeout"),
        (i % 3 != 0).alias("stay_domain"),
        F.when(i % 6 == 1, "/e").alias("filter"),
        (i % 8 == 7).alias("seed_only"),
        (i % 9 != 8).alias("extract_links"),
        (i % 2 == 0).alias("news"),
        F.when(i % 5 == 2, "Other").alias("agent"),
    )


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """visit_id, url, at: every event visits a page."""
    n = pages(spark, sf_dir).count()
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("visit_id"),
        F.col("ts").cast("timestamp").alias("at"),
        (F.col("event_id") % n).alias("page_id"),
    )
    return events.join(pages(spark, sf_dir).select("page_id", "url"), "page_id").drop("page_id")


#: Links of every kind that each page gets besides its own.
MORE_HREFS = (
    "", "#top", "mailto:a@b.example", "javascript:void(0)", "../up/x", "sub/page", "?q=1", "//cdn.example.org/x",
    "https://other.example.org/a.PDF", "/files/a.zip", "/wp-admin/x", "ftp://f.example.org/x", "/a?x=1#frag",
    "https://other.example.org/login", "/photo.jpeg", "http://third.example.org/en/",
)


def varied_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with descriptions of each kind, links of each kind, and articles marked in each way."""
    i = F.col("page_id")
    n = i.cast("string")
    about = F.concat(F.lit('<meta name="description" content="about '), n, F.lit('">'))
    last = F.concat(F.lit('<meta name="description" content=""><META content="last '), n, F.lit('" name=description>'))
    graph = F.concat(F.lit('<meta property="og:description" content="graph '), n, F.lit('"/>'))
    nothing = F.lit("")
    head = F.concat(
        F.when(i % 4 > 1, about).otherwise(nothing), F.when(i % 2 == 1, graph).otherwise(nothing), F.when(i % 4 == 3, last).otherwise(nothing)
    )
    nav = "".join(f'<a href="{h}">x</a>' for h in MORE_HREFS)
    opening = F.element_at(F.array(*(F.lit(x[0]) for x in MARKS)), (i % len(MARKS) + 1).cast("int"))
    closing = F.element_at(F.array(*(F.lit(x[1]) for x in MARKS)), (i % len(MARKS) + 1).cast("int"))
    text = F.replace("html", F.lit("</head>"), F.concat(head, F.lit("</head>")))
    text = F.replace(text, F.lit("</nav>"), F.lit(nav + "</nav>"))
    text = F.replace(F.replace(text, F.lit("<article>"), opening), F.lit("</article>"), closing)
    return dealt_pages(spark, sf_dir).select("page_id", "url", text.alias("html"))


#: How an article begins and ends, one way for each page: its own, the attribute, the eight selectors, none.
MARKS = (
    ("<article>", "</article>"),
    ('<div itemprop="articleBody">', "</div>"),
    ('<div class="article-content">', "</div>"),
    ('<section class="x post-content">', "</section>"),
    ('<div class="entry-content y">', "</div>"),
    ('<div id="article-body">', "</div>"),
    ('<div id="story-body">', "</div>"),
    ('<div class="story-body">', "</div>"),
    ("<main>", "</main>"),
    ('<div class="content">', "</div>"),
    ('<div class="other">', "</div>"),
)


#: Markup that is nested wrongly, one kind for each page.
TANGLES = (
    "<table>first<tr><td>cell</td></tr>second</table>",
    "</p>x</div></em>",
    "<b><p>bold</b>not</p>",
    "<table><tr><td><p>in<p>cell<td>two</table>",
    "<ul><li><p>one<li>two</ul>",
    "<select><option>a<p>b</select>",
    "<table><p>moved<tr><td>kept</table>",
    "<p>open<table><tr><td>closes it</table>",
    "<p><a href=/t1>one<p>two<a href=/t2>three</a>",
    "<h2>head<h3>line</h2>",
)


def tangled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with wrongly nested markup behind their navigation."""
    tangle = F.element_at(F.array(*map(F.lit, TANGLES)), (F.col("page_id") % len(TANGLES) + 1).cast("int"))
    return dealt_pages(spark, sf_dir).select(
        "page_id", "url", F.replace("html", F.lit("</nav>"), F.concat(F.lit("</nav>"), tangle)).alias("html")
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, link_pos, href of every anchor, as written."""
    return (
        extraction.prepared(varied_pages(spark, sf_dir))
        .withColumn("hrefs", html.hrefs_of("_doc"))
        .select("page_id", "url", F.posexplode_outer("hrefs").alias("link_pos", "href"))
        .filter(F.col("href").isNotNull())
    )


def site_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.edge_table(site_links(spark, sf_dir))


@lru_cache(maxsize=None)
def _stored(application: str, sf_dir: str, what: str) -> dict:
    return {}


def forget(spark: SparkSession, sf_dir: str) -> None:
    """The next report runs its crawl anew."""
    for what in ("site", "crawl", "page_data"):
        _stored(spark.sparkContext.applicationId, sf_dir, what).clear()


def stored_site(spark: SparkSession, sf_dir: str) -> Site:
    """The stored pages and links, made ready once per session and folder."""
    kept = _stored(spark.sparkContext.applicationId, sf_dir, "site")
    if "site" not in kept:
        kept["site"] = prepare(fetch_log(spark, sf_dir), cut_lineage(site_edges(spark, sf_dir), "edges"))
    return kept["site"]


def stored_crawl(spark: SparkSession, sf_dir: str) -> Crawl:
    """The crawl of all valid requests with robots files.

    It is run once per session and folder; the reports over it read the tables
    it left behind, as they would after a real crawl.
    """
    kept = _stored(spark.sparkContext.applicationId, sf_dir, "crawl")
    if "crawl" not in kept:
        kept["crawl"] = crawl(
            rq.valid_requests(crawl_requests(spark, sf_dir)), stored_site(spark, sf_dir), robots(spark, sf_dir), AGENT
        )
    return kept["crawl"]


def stored_page_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page records of that crawl, written once."""
    kept = _stored(spark.sparkContext.applicationId, sf_dir, "page_data")
    if "rows" not in kept:
        kept["rows"] = cut_lineage(stored_crawl(spark, sf_dir).page_data, "page_data")
    return kept["rows"]
