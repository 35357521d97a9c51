"""Replay of crawls over stored pages, many requests in one job.

Joins whose sides grow with the requests or pages are merge joins by hint: such tables compress so well that Spark, going by
the size of files, would send hundreds of MB through the driver to broadcast them.

The queue of each request is worked off level by level.  A level is one table
of admitted addresses with what came of each of them; the next level comes from
joining its crawled rows with the link edges.  Page text is never touched while
the crawl runs: it is joined at the end, for the pages that were crawled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.robots import ANY_AGENT
from ..lineage import Steps
from ..operators import extraction, fetching, frontier, ordered
from ..operators import requests as rq
from ..operators import robots as rb
from ..schemas import PAGE_FIELDS

TOO_DEEP = "too_deep"
DENIED = "robots_denied"


@dataclass
class Site:
    """Stored pages made ready to be crawled, once for all crawls."""

    pages: DataFrame
    edges: DataFrame
    index: DataFrame
    exact: DataFrame
    steps: Steps

    def close(self) -> None:
        self.steps.close()


def prepare(pages: DataFrame, edges: DataFrame) -> Site:
    """Writes which page answers which address, with its number of links.

    ``pages``: page table or fetch log.  ``edges``: see ``link_edges``; they are used as they are and never copied.
    """
    steps = Steps(pages.sparkSession, "site")
    degrees = edges.groupBy(F.col("src_id").alias("page_id")).agg(F.count(F.lit(1)).alias("links_found"))
    known = pages.drop("html").join(degrees.hint("merge"), "page_id", "left").na.fill(0, ["links_found"])
    return Site(
        pages,
        edges,
        steps.cut(fetching.page_index(known), "index"),
        steps.cut(fetching.address_index(known), "exact"),
        steps,
    )


@dataclass
class Crawl:
    """Outcome of ``crawl``; all DataFrames are lazy reads of written tables, until ``close`` deletes them."""

    requests: DataFrame
    site: Site
    #: request_id, key, url, depth, path, outcome, page_id, crawled_at,
    #: links_found, follow, taken, settings: every address that entered a queue
    admitted: DataFrame
    steps: Steps

    @property
    def visited(self) -> DataFrame:
        """Addresses that were processed, whatever came of them."""
        return self.admitted.filter(F.col("taken") & (F.col("outcome") != TOO_DEEP))

    @property
    def page_data(self) -> DataFrame:
        """Record of each crawled page, with request_id and place in the queue."""
        return page_data(self)

    def close(self) -> None:
        self.steps.close()


def _look_up(level: DataFrame, settings: DataFrame, site: Site, rules: DataFrame | None) -> DataFrame:
    """Adds what comes of visiting each row."""
    found = fetching.answer(level, site.index, site.exact).join(settings.hint("merge"), "request_id")
    if rules is None:
        found = found.withColumn("allowed", F.lit(True))
    else:
        found = rb.robots_verdict(found, rules, F.col("settings.agent"))
    fetched = F.coalesce(F.col("outcome"), F.lit(fetching.FETCH_ERROR))
    outcome = (
        F.when(F.col("depth") > F.col("settings.max_depth"), F.lit(TOO_DEEP))
        .when(F.col("settings.robots") & ~F.col("allowed"), F.lit(DENIED))
        .when(fetched == fetching.OK, F.lit(frontier.CRAWLED))
        .otherwise(fetched)
    )
    crawled = F.col("outcome") == frontier.CRAWLED
    # links are only looked for where they are asked for
    counted = crawled & F.col("settings.extract_links")
    return (
        found.withColumn("outcome", outcome)
        .withColumns(
            {
                "page_id": F.when(crawled, F.col("page_id")),
                "crawled_at": F.when(crawled, F.col("crawled_at")),
                "links_found": F.when(counted, F.col("links_found")).otherwise(F.lit(0)).cast("bigint"),
                "follow": F.col("settings.follow"),
            }
        )
        .drop("allowed", "settings")
    )


def _progress(level: DataFrame, state: DataFrame) -> DataFrame:
    """State of each request before this level, with the successes in it."""
    counts = level.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("outcome") == frontier.CRAWLED).alias("crawled"),
        F.count_if(
            (F.col("outcome") == frontier.CRAWLED) & F.col("follow")
        ).alias("following"),
    )
    open_ = F.col("cut_path").isNull()
    return (
        state.join(counts.hint("merge"), "request_id", "left")
        .na.fill(0, ["rows", "crawled", "following"])
        .withColumn(
            "reached",
            open_
            & (F.col("max_pages") > 0)
            & (F.col("done") + F.col("crawled") >= F.col("max_pages")),
        )
        .withColumn("following", F.when(open_, F.col("following")).otherwise(F.lit(0)))
    )


def _cuts(level: DataFrame, progress: DataFrame, hot_rows: int) -> DataFrame:
    """Place of the last page of each request whose limit falls in this level."""
    wanted = progress.filter("reached").select(
        "request_id", (F.col("max_pages") - F.col("done") - 1).alias("_still")
    )
    successes = (
        level.filter(F.col("outcome") == frontier.CRAWLED)
        .select("request_id", "depth", "path")
        .join(wanted.hint("merge"), "request_id")
    )
    counted = ordered.running_sum(
        successes, ["request_id"], frontier.ORDER, F.lit(1), "_before", hot_rows
    )
    return counted.filter(F.col("_before") == F.col("_still")).select(
        "request_id", F.col("depth").alias("new_depth"), F.col("path").alias("new_path")
    )


def _taken(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Adds whether a row left the queue before its request had all its pages."""
    cuts = state.select("request_id", "cut_depth", "cut_path")
    before = (
        F.col("cut_path").isNull()
        | (F.col("depth") < F.col("cut_depth"))
        | ((F.col("depth") == F.col("cut_depth")) & (F.col("path") <= F.col("cut_path")))
    )
    return rows.join(cuts.hint("merge"), "request_id").withColumn("taken", before).drop("cut_depth", "cut_path")


#: A request with more successes in a level is split to find the place of its last page.
HOT_ROWS = 1_000_000


def crawl(
    requests: DataFrame,
    site: Site,
    robots: DataFrame | None = None,
    agent: str = ANY_AGENT,
    hot_rows: int = HOT_ROWS,
) -> Crawl:
    """Crawl every request over the stored pages.

    ``requests``: request_id, url and settings (missing ones take defaults; ``agent`` stands in where a request names
    none).  ``site``: see ``prepare``.  ``robots``: origin, status, body, fetched_at; without it all is
    allowed.  An address is answered by the page stored under it, else by the page of its key.
    """
    steps = Steps(requests.sparkSession, "crawl")
    asked = rq.with_defaults(requests)
    named = F.col("agent") if "agent" in asked.columns else F.lit(None).cast("string")
    asked = asked.withColumns(
        {"extract_links": F.col("extract_links").cast("boolean"), "agent": F.coalesce(named, F.lit(agent))}
    )
    settings = steps.cut(frontier.settings_of(asked), "settings")
    rules = None if robots is None else steps.cut(rb.with_index(rb.latest_robots(robots)), "robots")

    state = asked.select(
        "request_id",
        F.col("max_pages").cast("bigint").alias("max_pages"),
        F.lit(0).cast("bigint").alias("done"),
        F.lit(None).cast("int").alias("cut_depth"),
        F.lit(None).cast("array<int>").alias("cut_path"),
    )
    candidates = frontier.seeds(asked)
    levels: list[DataFrame] = []
    while True:
        known = reduce(DataFrame.unionByName, [x.select("request_id", "key") for x in levels]) if levels else None
        level = steps.cut(_look_up(frontier.admit(candidates, known), settings, site, rules), "level")
        levels.append(level)

        progress = _progress(level, state)
        seen = progress.agg(
            F.sum("following").alias("following"), F.count_if("reached").alias("reached")
        ).first()
        if seen["reached"]:
            progress = progress.join(_cuts(level, progress, hot_rows).hint("merge"), "request_id", "left")
        else:
            progress = progress.withColumn("new_depth", F.lit(None).cast("int")).withColumn(
                "new_path", F.lit(None).cast("array<int>")
            )
        state = steps.cut(
            progress.select(
                "request_id",
                "max_pages",
                (F.col("done") + F.col("crawled")).alias("done"),
                F.coalesce("cut_depth", "new_depth").alias("cut_depth"),
                F.coalesce("cut_path", "new_path").alias("cut_path"),
            ),
            "state",
        )
        if not seen["following"]:
            break
        going_on = _taken(level.filter((F.col("outcome") == frontier.CRAWLED) & F.col("follow")), state)
        candidates = frontier.expand(
            going_on.filter("taken").drop("taken").join(settings.hint("merge"), "request_id"), site.edges
        )

    admitted = _taken(reduce(DataFrame.unionByName, levels), state).join(settings.hint("merge"), "request_id")
    return Crawl(asked, site, admitted, steps)


def page_data(done: Crawl) -> DataFrame:
    """Page records of a crawl.

    Each page is extracted once, however many requests crawled it, and only in
    the kinds of content that are asked for.
    """
    wanted = done.requests.select("request_id", "news", "extract_links")
    crawled = done.visited.filter(F.col("outcome") == frontier.CRAWLED).join(
        wanted.hint("merge"), "request_id"
    )
    kinds = crawled.groupBy("page_id").agg(
        F.max("news").alias("_news"),
        F.min("news").alias("_only_news"),
        F.max("extract_links").alias("_links"),
    )
    texts = extraction.page_texts(
        done.site.pages.select("page_id", "url", "html").join(kinds.drop("_links").hint("merge"), "page_id"),
        F.col("_news"),
        ~F.col("_only_news"),
        F.lit(False),
    ).drop("links")
    # one page's links are one row's worth of text, so these lists stay small
    lists = (
        done.site.edges.join(
            kinds.filter("_links").select(F.col("page_id").alias("src_id")).hint("merge"), "src_id", "left_semi"
        )
        .groupBy("src_id")
        .agg(F.array_sort(F.collect_list(F.struct("link_pos", "url"))).alias("_found"))
        .select(F.col("src_id").alias("page_id"), F.col("_found.url").alias("_found"))
    )
    no_links = F.array().cast("array<string>")
    return (
        crawled.join(texts.join(lists.hint("merge"), "page_id", "left").hint("merge"), "page_id")
        .withColumn(
            "content",
            F.when(F.col("news"), F.col("news_text")).otherwise(F.col("plain_text")),
        )
        .withColumn(
            "links",
            F.coalesce(F.when(F.col("extract_links"), F.col("_found")), no_links),
        )
        .select("request_id", "path", *PAGE_FIELDS)
    )
