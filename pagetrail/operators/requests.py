"""Crawl requests: defaults, bounds, and the shapes of the answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.robots import ANY_AGENT
from ..schemas import PAGE_FIELDS
from . import extraction, fetching
from . import robots as rb

# What a missing setting means.
DEFAULTS = {
    "depth": 1, "max_pages": 20, "workers": 2, "delay": 1, "timeout": 10,
    "stay_domain": True, "filter": "", "seed_only": False, "extract_links": False,
    "news": False, "robots": True,
}
# Lowest and highest accepted setting.
BOUNDS = {
    "depth": (0, 5), "max_pages": (1, 100), "workers": (1, 10), "delay": (0, 10),
    "timeout": (5, 60),
}
EXTRA_SECONDS = 30
SINGLE_PAGE_SECONDS = 30


def with_defaults(requests: DataFrame) -> DataFrame:
    """Fills missing settings, whole columns included."""
    given = set(requests.columns)
    filled = {
        name: F.coalesce(F.col(name), F.lit(value)) if name in given else F.lit(value)
        for name, value in DEFAULTS.items()
    }
    return requests.withColumns(filled)


def validate_requests(requests: DataFrame, url_mode: str = "prefix") -> DataFrame:
    """Adds ``errors``, the names of the settings out of bounds; empty is valid."""
    checks = [F.when(~urls.valid_url("url", url_mode), F.lit("url"))]
    checks += [
        F.when(~F.col(name).between(low, high), F.lit(name))
        for name, (low, high) in BOUNDS.items()
    ]
    return requests.withColumn("errors", F.array_compact(F.array(*checks)))


def valid_requests(requests: DataFrame, url_mode: str = "prefix") -> DataFrame:
    """Requests with their defaults that pass all bounds."""
    checked = validate_requests(with_defaults(requests), url_mode)
    return checked.filter(F.size("errors") == 0).drop("errors")


def time_budget(timeout: Column, max_pages: Column) -> Column:
    """Seconds a crawl may take; single pages have SINGLE_PAGE_SECONDS."""
    return timeout * max_pages + EXTRA_SECONDS


def crawl_response(page_data: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per request: errors, number of pages, the pages in order, seconds taken.

    A list can only be as long as the bounds allow (100 pages).  A request beyond the bounds is refused: ``errors`` names
    the settings, ``pages`` is null, and its pages, if any, are counted and can be read from ``page_data`` itself.
    """
    asked = validate_requests(with_defaults(requests)).select("request_id", "errors")
    totals = page_data.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("crawled_at").alias("first"), F.max("crawled_at").alias("last")
    )
    record = F.struct("depth", "path", F.struct(*PAGE_FIELDS).alias("page"))
    lists = (
        page_data.join(asked.filter(F.size("errors") == 0), "request_id", "left_semi")
        .groupBy("request_id")
        .agg(F.array_sort(F.collect_list(record)).alias("found"))
    )
    return asked.join(totals, "request_id", "left").join(lists, "request_id", "left").select(
        "request_id",
        "errors",
        F.coalesce("n", F.lit(0)).alias("pages_crawled"),
        F.when(
            F.size("errors") == 0, F.coalesce(F.transform("found", lambda r: r["page"]), F.array())
        ).alias("pages"),
        F.coalesce((F.unix_micros("last") - F.unix_micros("first")) / 1e6, F.lit(0.0)).alias("execution_time_seconds"),
    )


#: Indexes of stored pages by key and by address, as a prepared site holds them (``index``, ``exact``).
Indexes = tuple[DataFrame, DataFrame]


def _asked_pages(
    requests: DataFrame, pages: DataFrame, robots: DataFrame | None, agent: str, indexes: Indexes | None
) -> DataFrame:
    """The requests that a fetched page answers, with its id and time; denied addresses have none."""
    if robots is not None:
        names = F.coalesce("agent", F.lit(agent)) if "agent" in requests.columns else agent
        requests = rb.drop_denied(requests, rb.latest_robots(robots), names)
    keyed = requests.withColumn("key", urls.canonical_key("url"))
    found = fetching.answer(keyed, *(indexes or fetching.answers_for(keyed, pages)))
    return found.filter(F.col("outcome") == fetching.OK).drop("key", "outcome", "links_found")


def scrape(
    requests: DataFrame,
    pages: DataFrame,
    robots: DataFrame | None = None,
    agent: str = ANY_AGENT,
    indexes: Indexes | None = None,
) -> DataFrame:
    """The page of each requested address; nothing is followed.

    ``requests``: request_id, url, extract_links, maybe agent.  ``robots``: robots files, which are respected.  Each page is extracted once,
    however many requests ask for it.  Addresses without page, and denied ones, yield no row.  ``indexes``: those of a prepared
    site (its ``index`` and ``exact``); without them the pages are searched for the keys that are asked for.
    """
    asked = _asked_pages(requests, pages, robots, agent, indexes)
    wanted = asked.groupBy("page_id").agg(F.max("extract_links").alias("_links"))
    found = extraction.page_texts(
        pages.select("page_id", "url", "html").join(wanted, "page_id"),
        F.lit(False),
        F.lit(True),
        F.col("_links"),
    ).withColumnRenamed("plain_text", "content")
    no_links = F.array().cast("array<string>")
    return asked.join(found.drop("news_text"), "page_id").select(
        "request_id",
        "url",
        "title",
        "description",
        "content",
        F.when(F.col("extract_links"), F.col("links")).otherwise(no_links).alias("links"),
        "crawled_at",
        F.lit(0).alias("depth"),
    )


def page_links(
    requests: DataFrame,
    pages: DataFrame,
    robots: DataFrame | None = None,
    agent: str = ANY_AGENT,
    indexes: Indexes | None = None,
) -> DataFrame:
    """``request_id, url, links_found, links`` of the page of each request; see ``scrape``."""
    asked = _asked_pages(requests, pages, robots, agent, indexes)
    found = extraction.page_links(
        pages.select("page_id", "url", "html").join(asked.select("page_id").distinct(), "page_id")
    )
    return asked.select("request_id", "url", "page_id").join(
        found.select("page_id", "links"), "page_id"
    ).select("request_id", "url", F.size("links").alias("links_found"), "links")


def not_found(requests: DataFrame, page_data: DataFrame) -> DataFrame:
    """Requests for which no page came back."""
    return requests.join(page_data.select("request_id"), "request_id", "left_anti")
