"""The frontier of a crawl as tables.

A frontier row is ``request_id, key, url, depth, path``; the settings of its
request are joined where they are needed.  ``path`` lists the link positions from the seed; within one depth
all paths have equal length, so ``(depth, path)`` is exactly the order in which
a queue would hand the rows out, and no global numbering is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls

ORDER = ["depth", "path"]
CRAWLED = "crawled"


def settings_of(requests: DataFrame) -> DataFrame:
    """request_id and what a frontier row is crawled with (defaults already filled in)."""
    settings = F.struct(
        F.col("depth").cast("int").alias("max_depth"),
        F.col("max_pages").cast("bigint").alias("max_pages"),
        F.col("stay_domain").alias("stay_domain"),
        F.col("filter").alias("filter"),
        F.col("extract_links").alias("extract_links"),
        (F.col("extract_links") & ~F.col("seed_only")).alias("follow"),
        F.col("robots").alias("robots"),
        (F.col("agent") if "agent" in requests.columns else F.lit(None).cast("string")).alias("agent"),
    )
    return requests.select("request_id", settings.alias("settings"))


def seeds(requests: DataFrame) -> DataFrame:
    """First frontier row of each request."""
    return requests.select(
        "request_id",
        urls.canonical_key("url").alias("key"),
        "url",
        F.lit(0).alias("depth"),
        F.array(F.lit(0)).alias("path"),
    )


def admit(candidates: DataFrame, admitted: DataFrame | None = None) -> DataFrame:
    """Candidates with a new canonical key; the first discovery of a key wins.

    Unparsable addresses (null key) are refused.  ``admitted`` holds
    request_id and key of everything admitted before.  The minimum is taken
    before the shuffle, so a page that all others link to costs little.
    """
    payload = [c for c in candidates.columns if c not in ("request_id", "key", *ORDER)]
    first = (
        candidates.filter(F.col("key").isNotNull())
        .groupBy("request_id", "key")
        .agg(F.min(F.struct(*ORDER, *payload)).alias("first"))
        .select("request_id", "key", "first.*")
    )
    if admitted is not None:
        first = first.join(
            admitted.select("request_id", "key").hint("merge"), ["request_id", "key"], "left_anti"
        )
    return first.select(*candidates.columns)


def stay_on_domain(edges: DataFrame) -> DataFrame:
    """Links to the host of the page they are on."""
    return edges.filter(F.col("host") == F.col("src_host"))


def expand(level: DataFrame, edges: DataFrame) -> DataFrame:
    """Links of crawled rows that may be followed, one level deeper.

    ``level``: frontier rows with the page_id that answered and settings.  ``edges``: src_id, src_host, link_pos,
    url, key, host.  A page that very many requests crawl is one key with many rows on the side of
    ``level``, which adaptive skew handling splits.
    """
    settings = F.col("settings")
    parents = level.filter(settings["follow"]).select(
        "request_id",
        F.col("page_id").alias("src_id"),
        (F.col("depth") + 1).alias("depth"),
        "path",
        "settings",
    )
    kept = (~settings["stay_domain"] | (F.col("host") == F.col("src_host"))) & (
        urls.url_contains(F.col("url"), settings["filter"])
    )
    return (
        parents.join(edges.select("src_id", "src_host", "link_pos", "url", "key", "host").hint("merge"), "src_id")
        .filter(F.coalesce(kept, F.lit(False)))
        .select("request_id", "key", "url", "depth", F.concat("path", F.array("link_pos")).alias("path"))
    )


def depth_limit(rows: DataFrame) -> DataFrame:
    """Rows that are not too deep for their request."""
    return rows.filter(F.col("depth") <= F.col("settings.max_depth"))


def limit_pages(visited: DataFrame, most: int = 100) -> DataFrame:
    """Rows handed out before a request has its ``max_pages`` crawled pages.

    Only rows with outcome ``crawled`` count; a limit of zero or less is none.  ``most`` is the greatest limit there can
    be (requests allow 100); a greater one raises an error.  With it, tasks pass on at most so many successes of a request, so
    a hot request does not gather; the place of the last allowed success then cuts all its rows.
    """
    limit = F.col("settings.max_pages")
    known = limit.isNotNull() & F.when(
        limit > most, F.raise_error(F.concat(F.lit(f"max_pages beyond {most}: "), limit.cast("string"))).cast("boolean")
    ).otherwise(True)
    rows = visited.filter(known)
    successes = rows.filter((F.col("outcome") == CRAWLED) & (limit > 0)).select("request_id", limit.alias("_limit"), *ORDER)
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(*ORDER))
    ranked = successes.withColumn("_place", place).filter(F.col("_place") <= most)
    cuts = ranked.filter(F.col("_place") == F.col("_limit")).select(
        F.col("request_id").alias("_request"), F.struct(*ORDER).alias("_last")
    )
    cut = rows.join(cuts, F.col("request_id").eqNullSafe(F.col("_request")), "left")
    return cut.filter(F.col("_last").isNull() | (F.struct(*ORDER) <= F.col("_last"))).drop("_request", "_last")


def pending(admitted: DataFrame) -> DataFrame:
    """Rows still in the queue when the crawl ended, per request and depth."""
    return (
        admitted.filter(~F.col("taken"))
        .groupBy("request_id", "depth")
        .agg(F.count(F.lit(1)).alias("queue_size"))
    )


def visited_count(admitted: DataFrame) -> DataFrame:
    """Number of addresses ever admitted per request."""
    return admitted.groupBy("request_id").agg(F.count(F.lit(1)).alias("visited_count"))


def visited_lookup(addresses: DataFrame, admitted: DataFrame) -> DataFrame:
    """Marks raw addresses (request_id, url) that were admitted as written."""
    known = admitted.select("request_id", "url").distinct().withColumn("_known", F.lit(True))
    return addresses.join(known.hint("merge"), ["request_id", "url"], "left").select(
        *addresses.columns, F.coalesce("_known", F.lit(False)).alias("visited")
    )


def uncrawled(edges: DataFrame, index: DataFrame) -> DataFrame:
    """Discovered links that no stored page answers, once per key.

    The first link of the page with the smallest id gives the address.
    """
    first = (
        edges.filter(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.min(F.struct("src_id", "link_pos", "url")).alias("first"))
    )
    return first.join(index.select("key"), "key", "left_anti").select(
        "key", F.col("first.url").alias("url")
    )
