"""The registered queries: ``(spark, sf_dir) -> DataFrame``.

Lists are shown as text and times as seconds, so that both engines print the
same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail.functions import html, urls
from pagetrail.lineage import cut_lineage, new_folder
from pagetrail.operators import extraction, fetching, frontier, ordered, stats
from pagetrail.operators import requests as rq
from pagetrail.operators import robots as rb
from pagetrail.plans.crawl import crawl
from pagetrail.sources import results, tables
from pagetrail.streaming import jobs

from . import inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def text_list(c: str | Column) -> Column:
    return F.array_join(c, " ")


def seconds(c: str) -> Column:
    return F.unix_seconds(c).alias(c)


def flat(page_data: DataFrame, *first: str) -> DataFrame:
    """Page records with plain columns."""
    return page_data.select(
        *first,
        "url",
        "title",
        "description",
        "content",
        text_list("links").alias("links"),
        seconds("crawled_at"),
        F.col("depth").cast("bigint").alias("depth"),
    )


# -- sources ---------------------------------------------------------------


@query
def read_pages(spark, sf):
    return inputs.pages(spark, sf).select("page_id", "url", F.length("html").cast("bigint").alias("chars"))


@query
def fetch_outcome(spark, sf):
    return fetching.classify_fetch(inputs.fetch_log(spark, sf)).select("page_id", "outcome")


@query
def read_robots(spark, sf):
    path = new_folder(spark, "robots")
    inputs.robots(spark, sf).write.parquet(path)
    return tables.read_robots(spark, path).select(
        "origin", F.when(F.col("status") == 200, F.col("body")).otherwise("").alias("body")
    )


@query
def write_json(spark, sf):
    path = new_folder(spark, "json")
    results.write_json(inputs.stored_page_data(spark, sf), path, as_array=True)
    return flat(results.read_results(spark, path))


@query
def write_csv(spark, sf):
    path = new_folder(spark, "csv")
    results.write_csv(inputs.stored_page_data(spark, sf), path)
    names = results.CSV_HEADER
    back = spark.read.csv(
        path, header=True, escape='"', multiLine=True, schema=", ".join(f"{n} string" for n in names)
    )
    return back.select(*(F.coalesce(n, F.lit("")).alias(n) for n in names))


@query
def read_results(spark, sf):
    path = new_folder(spark, "json")
    results.write_json(inputs.stored_page_data(spark, sf), path)
    return flat(results.read_results(spark, path))


@query
def write_results(spark, sf):
    path = new_folder(spark, "results")
    results.write_results(inputs.stored_page_data(spark, sf), path, "yaml")
    return flat(results.read_results(spark, path))


# -- requests --------------------------------------------------------------


@query
def valid_request_url(spark, sf):
    return inputs.crawl_requests(spark, sf).select(
        "request_id",
        urls.valid_url("url").alias("strict"),
        urls.valid_url("url", mode="prefix").alias("prefix"),
    )


@query
def validate_requests(spark, sf):
    checked = rq.validate_requests(rq.with_defaults(inputs.crawl_requests(spark, sf)))
    return checked.select(
        "request_id", text_list("errors").alias("errors"), (F.size("errors") == 0).alias("valid")
    )


SETTINGS = (
    "depth", "max_pages", "workers", "delay", "timeout", "stay_domain", "filter", "seed_only",
    "extract_links", "news",
)


@query
def request_defaults(spark, sf):
    filled = rq.with_defaults(inputs.crawl_requests(spark, sf))
    return filled.select("request_id", "url", *SETTINGS)


@query
def time_budget(spark, sf):
    filled = rq.with_defaults(inputs.crawl_requests(spark, sf))
    return filled.select(
        "request_id", rq.time_budget(F.col("timeout"), F.col("max_pages")).alias("budget_s")
    )


@query
def crawl_response(spark, sf):
    answers = rq.crawl_response(inputs.stored_page_data(spark, sf), inputs.crawl_requests(spark, sf))
    return answers.select(
        "request_id",
        text_list("errors").alias("errors"),
        F.col("pages_crawled").cast("bigint").alias("pages_crawled"),
        text_list(F.transform("pages", lambda p: p["url"])).alias("urls"),
        F.array_join(F.transform("pages", lambda p: p["title"]), "|").alias("titles"),
        "execution_time_seconds",
    )


@query
def scrape(spark, sf):
    asked = inputs.crawl_requests(spark, sf).select("request_id", "url", "extract_links", "agent")
    found = rq.scrape(asked, inputs.fetch_log(spark, sf), inputs.robots(spark, sf), inputs.AGENT)
    return flat(found, "request_id")


@query
def page_links(spark, sf):
    asked = inputs.crawl_requests(spark, sf).select("request_id", "url", "agent")
    found = rq.page_links(asked, inputs.fetch_log(spark, sf), inputs.robots(spark, sf), inputs.AGENT)
    return found.select(
        "request_id",
        "url",
        F.col("links_found").cast("bigint").alias("links_found"),
        text_list("links").alias("links"),
    )


@query
def not_found(spark, sf):
    asked = inputs.crawl_requests(spark, sf).select("request_id", "url")
    return rq.not_found(asked, inputs.stored_page_data(spark, sf))


# -- addresses -------------------------------------------------------------


def _site_link_urls(spark, sf):
    return inputs.site_links(spark, sf).select("src_id", F.col("link_pos").cast("bigint").alias("link_pos"), "link")


@query
def url_parts(spark, sf):
    return _site_link_urls(spark, sf).withColumn("p", urls.url_parts("link")).select(
        "src_id", "link_pos", "p.*"
    )


@query
def resolve_links(spark, sf):
    return inputs.links(spark, sf).select(
        "page_id",
        F.col("link_pos").cast("bigint").alias("link_pos"),
        "href",
        urls.resolve_url("url", "href").alias("resolved"),
    )


@query
def http_links(spark, sf):
    resolved = inputs.links(spark, sf).select(
        "page_id", F.col("link_pos").cast("bigint").alias("link_pos"), urls.resolve_url("url", "href").alias("link")
    )
    return resolved.filter(urls.is_http("link"))


@query
def skip_links(spark, sf):
    asked = inputs.links(spark, sf).select(
        "page_id", F.col("link_pos").cast("bigint").alias("link_pos"), "href"
    )
    return asked.withColumn("skipped", urls.should_skip("href"))


@query
def canonical_key(spark, sf):
    return _site_link_urls(spark, sf).select(
        "src_id", "link_pos", urls.canonical_key("link").alias("key")
    )


@query
def url_host(spark, sf):
    return inputs.pages(spark, sf).select("page_id", urls.url_host("url").alias("host"))


@query
def live_hrefs(spark, sf):
    return inputs.links(spark, sf).filter(urls.is_live_href("href")).select(
        "page_id", F.col("link_pos").cast("bigint").alias("link_pos"), "href"
    )


@query
def url_contains(spark, sf):
    return inputs.pages(spark, sf).filter(urls.url_contains("url", F.lit("/en/"))).select(
        "page_id", "url"
    )


# -- extraction ------------------------------------------------------------


@query
def page_title(spark, sf):
    return inputs.pages(spark, sf).select("page_id", html.title("html").alias("title"))


@query
def page_description(spark, sf):
    return inputs.varied_pages(spark, sf).select("page_id", html.description("html").alias("description"))


@query
def page_content(spark, sf):
    return inputs.dealt_pages(spark, sf).select("page_id", html.paragraphs("html").alias("content"))


@query
def news_content(spark, sf):
    return inputs.varied_pages(spark, sf).select("page_id", html.news("html").alias("content"))


@query
def extract_links(spark, sf):
    found = extraction.page_links(inputs.dealt_pages(spark, sf))
    return found.select(
        "page_id", F.size("links").cast("bigint").alias("n_links"), text_list("links").alias("links")
    )


@query
def link_edges(spark, sf):
    return extraction.link_edges(inputs.dealt_pages(spark, sf)).withColumn(
        "link_pos", F.col("link_pos").cast("bigint")
    )


@query
def strip_tags(spark, sf):
    return inputs.dealt_pages(spark, sf).select("page_id", html.strip_tags("html").alias("text"))


@query
def element_text(spark, sf):
    return inputs.dealt_pages(spark, sf).select(
        "page_id", html.element_text("html", ".ad").alias("ad"), html.element_text("html", "h1").alias("h1")
    )


@query
def tangled_content(spark, sf):
    """Paragraphs, text and links of pages whose elements are nested wrongly."""
    doc = inputs.tangled_pages(spark, sf).withColumn("doc", html.parse("html"))
    return doc.select(
        "page_id",
        html.paragraphs_of("doc").alias("content"),
        html.strip_tags("html").alias("text"),
        F.size(F.filter(html.hrefs_of("doc"), lambda h: h.isin("/t1", "/t2"))).cast("bigint").alias("n_tangled"),
    )


@query
def parse_pages(spark, sf):
    given = inputs.fetch_log(spark, sf).select("page_id", "url", "html", "crawled_at")
    return flat(extraction.parse_pages(tables.dealt_out(given), extract_links=True), "page_id")


# -- frontier and crawl ----------------------------------------------------


@query
def frontier_dedup(spark, sf):
    edges = inputs.site_edges(spark, sf)
    candidates = edges.select(
        F.col("src_host").alias("request_id"),
        "key",
        "url",
        F.lit(1).alias("depth"),
        F.array(F.col("src_id").cast("int"), F.col("link_pos")).alias("path"),
    )
    # what was fetched well counts as admitted
    fetched = fetching.classify_fetch(inputs.fetch_log(spark, sf)).filter(F.col("outcome") == fetching.OK)
    admitted = fetched.select(
        urls.url_host("url").alias("request_id"), urls.canonical_key("url").alias("key")
    )
    return frontier.admit(candidates, admitted).select("request_id", "key", "url")


def _crawled_seeds(asked: DataFrame) -> DataFrame:
    """The seeds as if the page of that name had answered each."""
    level = frontier.seeds(asked).withColumn("page_id", F.col("request_id"))
    return level.join(frontier.settings_of(asked), "request_id")


@query
def expand_frontier(spark, sf):
    asked = rq.valid_requests(inputs.crawl_requests(spark, sf))
    found = frontier.expand(_crawled_seeds(asked), inputs.site_edges(spark, sf))
    return found.select(
        "request_id",
        "key",
        "url",
        F.col("depth").cast("bigint").alias("depth"),
        F.element_at("path", -1).cast("bigint").alias("link_pos"),
    )


@query
def depth_limit(spark, sf):
    rows = frontier.depth_limit(inputs.stored_crawl(spark, sf).admitted)
    return rows.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("urls"), F.max("depth").cast("bigint").alias("deepest")
    )


@query
def stay_on_domain(spark, sf):
    return frontier.stay_on_domain(inputs.site_edges(spark, sf)).select(
        "src_id", F.col("link_pos").cast("bigint").alias("link_pos"), "url"
    )


@query
def filter_links(spark, sf):
    asked = rq.valid_requests(inputs.crawl_requests(spark, sf)).withColumn("filter", F.lit("/en/"))
    found = frontier.expand(_crawled_seeds(asked), inputs.site_edges(spark, sf))
    return found.select("request_id", "url", F.element_at("path", -1).cast("bigint").alias("link_pos"))


@query
def seed_only(spark, sf):
    asked = rq.valid_requests(inputs.crawl_requests(spark, sf)).withColumn("seed_only", F.lit(True))
    done = crawl(asked, inputs.stored_site(spark, sf))
    return done.visited.select("request_id", "url", "outcome", "links_found")


@query
def crawl_deep(spark, sf):
    """Every request followed to depth 3, with what was taken and what was left."""
    asked = rq.valid_requests(inputs.crawl_requests(spark, sf)).withColumns(
        {
            "depth": F.lit(3),
            "filter": F.lit(""),
            "extract_links": F.lit(True),
            "seed_only": F.lit(False),
        }
    )
    done = crawl(asked, inputs.stored_site(spark, sf))
    return done.admitted.select(
        "request_id", "key", "url", F.col("depth").cast("bigint").alias("depth"), "outcome", "taken"
    )


@query
def crawl_order(spark, sf):
    rows = inputs.stored_crawl(spark, sf).visited.select("request_id", "depth", "path", "url")
    numbered = ordered.row_number(rows, ["request_id"], frontier.ORDER, "position")
    return numbered.select("request_id", "position", "url")


@query
def max_pages(spark, sf):
    log = fetching.classify_fetch(inputs.fetch_log(spark, sf)).select("page_id", "outcome")
    visited = inputs.site_pages(spark, sf).join(log, "page_id").select(
        F.col("host").alias("request_id"),
        "page_id",
        F.lit(0).alias("depth"),
        F.array(F.col("rn").cast("int")).alias("path"),
        F.when(F.col("outcome") == fetching.OK, frontier.CRAWLED).otherwise(F.col("outcome")).alias("outcome"),
        F.struct(F.lit(5).alias("max_pages")).alias("settings"),
    )
    return frontier.limit_pages(visited).select("page_id", "outcome")


@query
def crawl_pages(spark, sf):
    return flat(inputs.stored_page_data(spark, sf), "request_id")


@query
def pending_frontier(spark, sf):
    return frontier.pending(inputs.stored_crawl(spark, sf).admitted).withColumn(
        "depth", F.col("depth").cast("bigint")
    )


@query
def visited_count(spark, sf):
    return frontier.visited_count(inputs.stored_crawl(spark, sf).admitted)


@query
def visited_lookup(spark, sf):
    done = inputs.stored_crawl(spark, sf)
    # of every request: the links on the page it began with
    asked = inputs.site_links(spark, sf).select(F.col("src_id").alias("request_id"), F.col("link").alias("url"))
    addresses = asked.join(done.requests.select("request_id").hint("merge"), "request_id").distinct()
    return frontier.visited_lookup(addresses, done.admitted)


@query
def uncrawled_links(spark, sf):
    pages = inputs.pages(spark, sf)
    return frontier.uncrawled(extraction.link_edges(tables.dealt_out(pages)), fetching.page_index(pages))


QUERIES["crawl"] = QUERIES.pop("crawl_pages")


# -- robots and politeness -------------------------------------------------


@query
def robots_rules(spark, sf):
    return rb.robots_rules(inputs.robots(spark, sf)).withColumn(
        "line_no", F.col("line_no").cast("bigint")
    )


@query
def crawl_delay(spark, sf):
    return rb.crawl_delay(inputs.robots(spark, sf))


@query
def robots_allowed(spark, sf):
    parsed = rb.latest_robots(inputs.robots(spark, sf))
    asked = inputs.pages(spark, sf).select("page_id", "url")
    return rb.robots_verdict(asked, parsed, inputs.AGENT, with_delay=True)


@query
def robots_filter(spark, sf):
    parsed = rb.latest_robots(inputs.robots(spark, sf))
    asked = inputs.site_links(spark, sf).select(
        "src_id", F.col("link_pos").cast("bigint").alias("link_pos"), F.col("link").alias("url")
    )
    return rb.drop_denied(asked, parsed, "Other")


@query
def robots_default(spark, sf):
    origins = inputs.site_links(spark, sf).select(urls.url_origin("link").alias("origin"))
    return rb.usable_robots(origins, inputs.robots(spark, sf)).select(
        "origin", "usable", F.size("rules").cast("bigint").alias("n_rules"), "crawl_delay_s"
    )


@query
def robots_asof(spark, sf):
    visits = inputs.visits(spark, sf)
    # the first visit of each week to an origin fetched its robots file
    week = F.date_trunc("week", "at")
    snapshots = (
        visits.select(urls.url_origin("url").alias("origin"), "at")
        .groupBy("origin", week.alias("week"))
        .agg(F.min("at").alias("fetched_at"))
    )
    return rb.robots_asof(visits, snapshots).select(
        "visit_id", "origin", seconds("at"), seconds("robots_at"), "needs_refetch"
    )


@query
def host_spacing(spark, sf):
    asked = rq.with_defaults(inputs.crawl_requests(spark, sf)).withColumn(
        "origin", urls.url_origin("url")
    )
    delays = rb.usable_robots(asked, inputs.robots(spark, sf))
    return asked.join(delays, "origin").select(
        "request_id", rb.host_spacing(F.col("delay"), F.col("crawl_delay_s")).alias("spacing_s")
    )


@query
def fetch_schedule(spark, sf):
    done = inputs.stored_crawl(spark, sf)
    visited = done.visited.join(done.requests.select("request_id", "delay").hint("merge"), "request_id")
    planned = rb.fetch_schedule(visited, rb.latest_robots(inputs.robots(spark, sf)))
    return planned.select("request_id", "url", "host", "host_rank", "fetch_offset_s")


# -- statistics ------------------------------------------------------------


@query
def crawl_stats(spark, sf):
    done = inputs.stored_crawl(spark, sf)
    found = stats.crawl_stats(done.visited, done.requests)
    return found.select(
        "request_id", "pages_crawled", "links_discovered", seconds("start_time"), seconds("end_time")
    )


@query
def skip_reasons(spark, sf):
    return stats.skip_reasons(inputs.stored_crawl(spark, sf).visited, totals=True)


# -- streaming -------------------------------------------------------------


def _arriving(spark, rows, part, parts, run) -> None:
    """Folder by folder, each written by many tasks, ``run`` goes on with what arrived; a folder is a batch."""
    path = new_folder(spark, "arriving")
    # a part is a range of ids and lies in few of the files that are read; dealt out, all tasks get some of every part
    dealt = rows.withColumn("_part", part).repartition(spark.sparkContext.defaultParallelism)
    kept = cut_lineage(dealt, "arriving")
    for number in range(parts):
        kept.filter(F.col("_part") == number).drop("_part").write.parquet(f"{path}/{number}")
        run(f"{path}/*").awaitTermination()


def _arriving_pages(spark, sf, run) -> None:
    """The pages in four parts that arrive one after the other, in order of their ids; rows without one come first."""
    pages = inputs.pages(spark, sf)
    n = max(pages.count(), 1)
    quarter = F.greatest(F.least(F.floor(F.col("page_id") * 4 / n), F.lit(3)), F.lit(0))
    _arriving(spark, pages, F.coalesce(quarter, F.lit(0)), 4, lambda path: run(tables.stream_pages(spark, path)))


@query
def stream_pages(spark, sf):
    path = new_folder(spark, "stream-pages")

    def run(pages):
        parsed = jobs.parsed_stream(pages, extract_links=True)
        stamped = parsed.withColumn("crawled_at", F.timestamp_seconds(F.col("page_id") + inputs.START))
        return jobs.start_page_stream(stamped, path, path + "-checkpoint")

    _arriving_pages(spark, sf, run)
    return flat(results.read_results(spark, path))


@query
def stream_dedup(spark, sf):
    path = new_folder(spark, "stream-dedup")
    _arriving_pages(
        spark, sf, lambda pages: jobs.start_dedup_stream(extraction.link_edges(pages), path, path + "-checkpoint")
    )
    return spark.read.schema(jobs.FIRST).parquet(path).select("key", "url")


@query
def stream_dedup_bounded(spark, sf):
    """Keys that were appended, and late links by key; pages whose id ends in 0 arrive with the last part."""
    path = new_folder(spark, "stream-bounded")
    pages = inputs.pages(spark, sf)
    n = max(pages.count(), 1)
    quarter = F.greatest(F.least(F.floor(F.col("page_id") * 4 / n), F.lit(3)), F.lit(0))
    part = F.when(F.col("page_id") % 10 == 0, F.lit(3)).otherwise(F.coalesce(quarter, F.lit(0)))

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}-links/{number}")

    def run(folder):
        # the stream below reads its links twice, so they are extracted and written once
        edges = extraction.link_edges(tables.stream_pages(spark, folder)).select("src_id", "key")
        written = edges.writeStream.foreachBatch(store).option("checkpointLocation", path + "-links-checkpoint").trigger(availableNow=True)
        written.start().awaitTermination()
        links = spark.readStream.schema(edges.schema).parquet(f"{path}-links/*")
        dated = links.select("key", F.timestamp_seconds(F.col("src_id") + inputs.START).alias("at"))
        return jobs.start_bounded_dedup_stream(dated, path, path + "-checkpoint", max(n // 2, 1))

    _arriving(spark, pages, part, 4, run)
    seen = spark.read.schema(jobs.SEEN).parquet(path).select("key", F.lit(1).alias("seen"), F.lit(0).alias("n"))
    late = spark.read.schema(jobs.LATE).parquet(path + "-late").select("key", F.lit(0).alias("seen"), "n")
    return seen.union(late).groupBy("key").agg(
        (F.max("seen") == 1).alias("seen"), F.sum("n").cast("bigint").alias("n_late")
    )


@query
def stream_robots(spark, sf):
    path = new_folder(spark, "visits")
    # three parts that arrive one after the other, in order of time; visits without a time come first
    third = F.coalesce(F.least(F.floor((F.dayofmonth("at") - 1) / 10), F.lit(2)), F.lit(0))

    def run(folder):
        arriving = spark.readStream.schema("visit_id bigint, at timestamp, url string").parquet(folder)
        return jobs.start_robots_stream(arriving, path + "-due", path + "-checkpoint")

    _arriving(spark, inputs.visits(spark, sf), third, 3, run)
    due = spark.read.schema(jobs.REFETCH).parquet(path + "-due")
    return due.select("origin", seconds("fetched_at"))


@query
def stream_stats(spark, sf):
    path = new_folder(spark, "stream-stats")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    def run(pages):
        counted = jobs.stream_stats(extraction.page_links(pages).withColumn("host", urls.url_host("url")), "host")
        return (
            counted.writeStream.foreachBatch(store)
            .option("checkpointLocation", path + "-checkpoint")
            .outputMode("update")
            .trigger(availableNow=True)
            .start()
        )

    _arriving_pages(spark, sf, run)
    rows = spark.read.schema(
        "host string, pages_crawled bigint, links_discovered bigint, batch int"
    ).parquet(path)
    newest = F.max(F.struct("batch", "pages_crawled", "links_discovered")).alias("r")
    return rows.groupBy("host").agg(newest).select("host", "r.pages_crawled", "r.links_discovered")
