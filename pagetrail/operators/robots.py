"""Robots rules and politeness over tables of origins, addresses and visits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import robots as text
from ..functions import search, urls
from . import ordered

RULES = "array<struct<line_no:int,agent:string,path:string,allow:boolean>>"


def parse_robots(robots: DataFrame) -> DataFrame:
    """``origin, fetched_at, usable, rules, crawl_delay_s``, one row per file.

    A file with a status other than 200 has no rules and the default delay.
    The text of a file is worked on inside its row, so nothing is shuffled.
    """
    body = F.when(F.col("status") == 200, F.coalesce(F.col("body"), F.lit("")))
    return (
        robots.withColumn("_body", body)
        .select(
            "origin",
            "fetched_at",
            F.col("_body").isNotNull().alias("usable"),
            F.coalesce(text.rules_of("_body"), F.array().cast(RULES)).alias("rules"),
            F.coalesce(text.delay_of("_body"), F.lit(text.DEFAULT_DELAY)).alias(
                "crawl_delay_s"
            ),
        )
    )


def latest_robots(robots: DataFrame) -> DataFrame:
    """The newest file per origin, parsed."""
    newest = (
        robots.groupBy("origin")
        .agg(F.max(F.struct("fetched_at", "status", "body")).alias("r"))
        .select("origin", "r.*")
    )
    return parse_robots(newest)


def with_index(parsed: DataFrame) -> DataFrame:
    """Adds the rules sorted for look-ups, so that ``robots_verdict`` need not sort them; for tables that are written."""
    return parsed.withColumn("rule_index", text.rule_index("rules"))


def robots_rules(robots: DataFrame) -> DataFrame:
    """``origin, agent, line_no, path, allow``, one row per rule."""
    rules = parse_robots(robots).select("origin", F.explode_outer("rules").alias("r"))
    return rules.filter(F.col("r").isNotNull()).select(
        "origin", "r.agent", "r.line_no", "r.path", "r.allow"
    )


def crawl_delay(robots: DataFrame) -> DataFrame:
    """``origin, crawl_delay_s``."""
    return parse_robots(robots).select("origin", "crawl_delay_s")


def usable_robots(origins: DataFrame, robots: DataFrame) -> DataFrame:
    """Every origin with its rules and delay; open with 1 s where there are none."""
    parsed = latest_robots(robots).select("origin", "usable", "rules", "crawl_delay_s")
    return origins.select("origin").distinct().join(parsed, "origin", "left").select(
        "origin",
        F.coalesce("usable", F.lit(False)).alias("usable"),
        F.coalesce("rules", F.array().cast(RULES)).alias("rules"),
        F.coalesce("crawl_delay_s", F.lit(text.DEFAULT_DELAY)).alias("crawl_delay_s"),
    )


def robots_verdict(
    urls_df: DataFrame, parsed: DataFrame, agent: str | Column, with_delay: bool = False
) -> DataFrame:
    """Adds ``allowed`` to rows with a ``url``, and ``crawl_delay_s`` if asked for; ``parsed`` has one row per origin.

    The rules of an origin stay one row, so a URL meets them in its own row
    instead of being multiplied by them, and looks up its own prefixes (``with_index`` spares repeated calls the sorting).  Addresses without an origin match nothing and are dealt out
    by their text.
    """
    applying = F.col("rules")
    if isinstance(agent, str):
        # only rules that can apply travel to the addresses
        names = {agent, text.ANY_AGENT}
        applying = F.filter(applying, lambda r: r["agent"].isin(*sorted(names)))
        agent = F.lit(agent)
    index = F.col("rule_index") if "rule_index" in parsed.columns else text.rule_index(applying)
    rules = parsed.select(F.col("origin").alias("_origin"), index.alias("_rules"), F.col("crawl_delay_s").alias("_delay"))
    if not with_delay:
        rules = rules.drop("_delay")
    known = urls_df.withColumn("_id", urls.url_identity("url")).withColumns(
        {
            "_origin": F.coalesce("_id.origin", F.hex(F.xxhash64("url"))),
            "_path": F.col("_id.path"),
            "_agent": agent,
        }
    )
    judged = known.join(rules, "_origin", "left").withColumn("allowed", text.verdict("_rules", "_path", "_agent"))
    if with_delay:
        judged = judged.withColumn("crawl_delay_s", F.coalesce("_delay", F.lit(text.DEFAULT_DELAY))).drop("_delay")
    return judged.drop("_id", "_origin", "_path", "_agent", "_rules")


def drop_denied(
    urls_df: DataFrame, parsed: DataFrame, agent: str | Column, respect: bool = True
) -> DataFrame:
    """Removes denied addresses, unless robots files are to be ignored."""
    if not respect:
        return urls_df
    return robots_verdict(urls_df, parsed, agent).filter("allowed").drop("allowed")


def robots_index(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fetch times for ``robots_asof``: by origin and month (origin, month, times, ascending), and per origin the months that
    have any (origin, months, lasts: the newest time of each).  Write both to use them for many batches of visits.

    Times of an origin are combined before the shuffle; a row holds what a month or the months of an origin have.
    """
    known = snapshots.filter(F.col("origin").isNotNull() & F.col("fetched_at").isNotNull())
    by_month = (
        known.select("origin", _month("fetched_at").alias("month"), "fetched_at")
        .groupBy("origin", "month")
        .agg(F.sort_array(F.collect_set("fetched_at")).alias("times"))
    )
    newest = known.groupBy("origin", _month("fetched_at").alias("month")).agg(F.max("fetched_at").alias("last"))
    by_origin = newest.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("month", "last"))).alias("m"))
    return by_month, by_origin.select("origin", F.col("m.month").alias("months"), F.col("m.last").alias("lasts"))


def _month(at: str) -> Column:
    return (F.year(at) * 12 + F.month(at)).cast("int")


def robots_asof(
    visits: DataFrame,
    snapshots: DataFrame | tuple[DataFrame, DataFrame],
    ttl_hours: float = 24,
) -> DataFrame:
    """Adds the newest robots file at the time of each visit, and its age.

    ``visits``: url, at and an id column ``visit_id``.  ``snapshots``: origin, fetched_at, or what ``robots_index`` made of
    them.  A file is good for exactly ``ttl_hours``; without one, or with an older one, ``needs_refetch`` is true, as it is for
    an address without an origin and for a visit without a time.

    A visit meets the fetch times of its month, and the months of its origin, and finds its place in both by binary
    search.  Visits are neither sorted nor gathered, and each key of the other side is one row, so that the visits of
    a hot origin can be in any number of tasks.
    """
    by_month, by_origin = snapshots if isinstance(snapshots, tuple) else robots_index(snapshots)
    known = visits.select(
        "visit_id",
        "url",
        urls.url_origin("url").alias("origin"),
        "at",
        _month("at").alias("_month"),
    )
    # addresses without an origin meet nothing and are dealt out by their text
    known = known.withColumn("_key", F.coalesce("origin", F.hex(F.xxhash64("url"))))
    of_month = by_month.select(F.col("origin").alias("_key"), F.col("month").alias("_month"), "times")
    of_origin = by_origin.select(F.col("origin").alias("_key"), "months", "lasts")
    met = known.join(of_month, ["_key", "_month"], "left").join(of_origin, "_key", "left")
    earlier = F.get("lasts", search.count_up_to(F.col("months"), F.col("_month") - 1) - 1)
    found = met.withColumn("robots_at", F.coalesce(search.last_up_to(F.col("times"), F.col("at")), earlier))
    age = F.unix_micros("at") - F.unix_micros("robots_at")
    fresh = age <= F.lit(int(ttl_hours * 3600 * 1_000_000))
    return found.select(
        "visit_id",
        "url",
        "origin",
        "at",
        "robots_at",
        (~F.coalesce(fresh, F.lit(False))).alias("needs_refetch"),
    )


def host_spacing(delay: Column, crawl_delay_s: Column) -> Column:
    """Seconds between two requests to a host."""
    return F.greatest(
        delay.cast("double"), F.coalesce(crawl_delay_s, F.lit(0.0)).cast("double")
    )


def fetch_schedule(
    visited: DataFrame,
    parsed: DataFrame | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Earliest fetch offset: the k-th address of a host waits k spacings.

    ``visited``: request_id, url, depth, path, delay.
    """
    rows = (
        visited.withColumn("_id", urls.url_identity("url"))
        .withColumns({"host": F.col("_id.host"), "_origin": F.col("_id.origin")})
        .drop("_id")
    )
    if parsed is None:
        rows = rows.withColumn("_delay", F.lit(None).cast("double"))
    else:
        delays = parsed.select(
            F.col("origin").alias("_origin"), F.col("crawl_delay_s").alias("_delay")
        )
        rows = rows.join(delays, "_origin", "left").withColumn(
            "_delay", F.coalesce("_delay", F.lit(text.DEFAULT_DELAY))
        )
    ranked = ordered.row_number(
        rows.withColumn("spacing_s", host_spacing(F.col("delay"), F.col("_delay"))),
        ["request_id", "host"],
        ["depth", "path"],
        "host_rank",
        hot_rows,
    )
    return ranked.drop("_origin", "_delay").withColumn(
        "fetch_offset_s", F.col("host_rank") * F.col("spacing_s")
    )
