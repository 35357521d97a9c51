import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagetrail.lineage import cut_lineage
from pagetrail.operators import extraction, fetching, frontier, requests as rq, stats
from pagetrail.operators import robots as rb
from pagetrail.plans.crawl import crawl as crawl_site
from pagetrail.plans.crawl import prepare

def crawl(requests, pages, edges, *args, **settings):
    return crawl_site(requests, prepare(pages, edges), *args, **settings)


def written_edges(pages):
    """The link table a crawl goes by, written once."""
    return cut_lineage(extraction.link_edges(pages), "edges")


H = "http://h.example/"
SITE = {"s": "ab", "a": "cb", "b": "d", "c": "s"}
DAY = dt.datetime(2024, 1, 1)


def site(spark, tree=SITE):
    rows = [
        (i, H + name, f"<title>{name}</title><p>{name}" + "".join(f"<a href='/{t}?x={name}'>" for t in to))
        for i, (name, to) in enumerate(tree.items())
    ]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn(
        "crawled_at", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id"))
    )


def one(spark, **settings):
    row = {"request_id": 1, "url": H + "s", "extract_links": True, **settings}
    df = spark.range(1).select(F.lit(row["request_id"]).cast("bigint").alias("request_id"))
    for name, value in row.items():
        if name != "request_id":
            df = df.withColumn(name, F.lit(value))
    return df


def order(done):
    rows = done.visited.filter("outcome = 'crawled'").orderBy("depth", "path").collect()
    return "".join(r.key[len(H):] for r in rows)


CASES = [
    (dict(extract_links=False, depth=3), "s"),
    (dict(depth=0), "s"),
    (dict(), "sab"),
    (dict(depth=2), "sabc"),
    (dict(depth=2, max_pages=3), "sab"),
    (dict(depth=2, filter="/c"), "s"),
    (dict(depth=2, seed_only=True), "s"),
    (dict(depth=2, max_pages=0), "sabc"),
]


@pytest.fixture(scope="module")
def all_cases(spark):
    pages = site(spark)
    requests = None
    for i, (settings, _) in enumerate(CASES):
        row = one(spark, **{"request_id": i, "depth": 1, "max_pages": 20, "filter": "", "seed_only": False, **settings})
        row = row.select("request_id", "url", "extract_links", "depth", "max_pages", "filter", "seed_only")
        requests = row if requests is None else requests.unionByName(row)
    return crawl(requests, pages, written_edges(pages))


def test_golden_crawls(all_cases):
    rows = all_cases.visited.filter("outcome = 'crawled'").orderBy("request_id", "depth", "path").collect()
    got = {}
    for r in rows:
        got[r.request_id] = got.get(r.request_id, "") + r.key[len(H):]
    assert got == {i: expected for i, (_, expected) in enumerate(CASES)}


def test_counts(all_cases):
    pending = {(r.request_id, r.depth): r.queue_size for r in frontier.pending(all_cases.admitted).collect()}
    assert pending == {(4, 2): 2}
    counts = {r.request_id: r.visited_count for r in frontier.visited_count(all_cases.admitted).collect()}
    assert counts == {0: 1, 1: 3, 2: 5, 3: 5, 4: 5, 5: 1, 6: 1, 7: 5}
    outcomes = {(r.request_id, r.outcome): r.urls for r in stats.skip_reasons(all_cases.visited).collect()}
    assert outcomes[(3, "crawled")] == 4 and outcomes[(3, "fetch_error")] == 1
    found = {r.request_id: r for r in stats.crawl_stats(all_cases.visited, all_cases.requests).collect()}
    assert (found[3].pages_crawled, found[3].links_discovered) == (4, 6)
    assert (found[6].pages_crawled, found[6].links_discovered) == (1, 2)
    assert found[0].links_discovered == 0  # it did not ask for links


def test_page_data(all_cases):
    rows = {(r.request_id, r.url): r for r in all_cases.page_data.collect()}
    assert len(rows) == sum(len(e) for _, e in CASES)
    a = rows[(3, H + "a?x=s")]
    assert (a.title, a.content, a.depth) == ("a", "a\n", 1)
    assert a.links == [H + "c?x=a", H + "b?x=a"]
    assert rows[(0, H + "s")].links == []


def test_lookup(spark, all_cases):
    asked = spark.createDataFrame([(3, H + "a?x=s"), (3, H + "a"), (0, H + "a?x=s")], "request_id bigint, url string")
    got = {(r.request_id, r.url): r.visited for r in frontier.visited_lookup(asked, all_cases.admitted).collect()}
    assert got == {(3, H + "a?x=s"): True, (3, H + "a"): False, (0, H + "a?x=s"): False}


def test_response(spark, all_cases):
    rows = {r.request_id: r for r in rq.crawl_response(all_cases.page_data, all_cases.requests).collect()}
    assert set(rows) == set(range(8))
    # without a page limit a request is refused, which is said; its pages are counted
    assert (rows[7].errors, rows[7].pages_crawled, rows[7].pages) == (["max_pages"], 4, None)
    assert rows[3].errors == []
    assert rows[3].pages_crawled == 4 and rows[3].execution_time_seconds == 3.0
    assert [p.title for p in rows[3].pages] == list("sabc")


def test_robots(spark):
    pages = site(spark)
    robots = spark.createDataFrame(
        [(H[:-1], 200, "User-agent: *\nDisallow: /b", DAY)],
        "origin string, status int, body string, fetched_at timestamp",
    )
    edges = written_edges(pages)
    done = crawl(one(spark, depth=2), pages, edges, robots)
    assert order(done) == "sac"
    assert done.admitted.filter(F.col("key") == H + "d").count() == 0
    assert order(crawl(one(spark, depth=2, robots=False), pages, edges, robots)) == "sabc"


def simulate(tree, seed, max_depth, max_pages):
    """A literal queue."""
    queue, seen, crawled = [(seed, 0)], {seed}, []
    while queue and not (max_pages > 0 and len(crawled) >= max_pages):
        name, depth = queue.pop(0)
        if depth > max_depth or name not in tree:
            continue
        crawled.append(name)
        for link in tree[name]:
            if link not in seen:
                seen.add(link)
                queue.append((link, depth + 1))
    return crawled, seen, [n for n, _ in queue]


@pytest.mark.parametrize("bound", [1_000_000, 5])
def test_against_a_queue(spark, bound):
    names = [f"n{i}" for i in range(60)]
    tree = {
        n: [names[(i * 7 + j * j * 3 + 1) % 60] for j in range(1 + i % 6)] + (["gone"] if i % 9 == 0 else [])
        for i, n in enumerate(names)
        if i % 11 != 5
    }
    rows = [
        (i, H + n, "".join(f"<a href='/{t}'>" for t in to)) for i, (n, to) in enumerate(tree.items())
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    asked = [(i, H + names[i * 3 % 60], i % 5, [0, 1, 7, 25, 100][i % 4]) for i in range(12)]
    requests = spark.createDataFrame(
        asked, "request_id bigint, url string, depth int, max_pages int"
    ).withColumn("extract_links", F.lit(True))
    done = crawl(requests, pages, written_edges(pages), hot_rows=bound)
    admitted = done.admitted.collect()
    for request, url, depth, limit in asked:
        mine = sorted(
            (r for r in admitted if r.request_id == request), key=lambda r: (r.depth, r.path)
        )
        crawled, seen, queue = simulate(tree, url[len(H):], depth, limit)
        assert [r.key[len(H):] for r in mine if r.taken and r.outcome == "crawled"] == crawled
        assert {r.key[len(H):] for r in mine} == seen
        assert [r.key[len(H):] for r in mine if not r.taken] == queue
    limited = frontier.limit_pages(
        done.admitted.filter("request_id = 3").drop("settings").withColumn(
            "settings", F.struct(F.lit(4).alias("max_pages"))
        )
    )
    assert limited.filter("outcome = 'crawled'").count() == 4


def test_domain_and_refusals(spark):
    rows = [
        (0, "http://a/", "<a href='http://b/'><a href='http://a/x'><a href='//a/%zz'>"),
        (1, "http://b/", "<a href='/y'>"),
        (2, "http://a/x?q=1", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    edges = written_edges(pages)
    home = crawl(one(spark, url="http://a/", depth=3), pages, edges)
    assert [r.key for r in home.admitted.orderBy("depth", "path").collect()] == ["http://a/", "http://a/x"]
    away = crawl(one(spark, url="http://a/", depth=3, stay_domain=False), pages, edges)
    assert [r.key for r in away.admitted.orderBy("depth", "path").collect()] == [
        "http://a/", "http://b/", "http://a/x", "http://b/y",
    ]
    assert crawl(one(spark, url="http://a/%zz"), pages, edges).admitted.count() == 0
    missing = frontier.uncrawled(edges, fetching.page_index(pages)).collect()
    assert [(r.key, r.url) for r in missing] == [("http://b/y", "http://b/y")]


def test_the_exact_address_answers_before_its_key(spark):
    rows = [
        (5, "http://a/p?x=1", "<title>one</title><a href='/one'>"),
        (3, "http://a/p?x=2", "<title>two</title><a href='/two'>"),
        (4, "http://a/p?x=1#again", "<title>late</title>"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    edges = written_edges(pages)
    asked = [(1, "http://a/p?x=1"), (2, "http://a/p?x=2#f"), (3, "http://a/p"), (4, "http://a/p?x=9")]
    requests = spark.createDataFrame(asked, "request_id bigint, url string").withColumn("extract_links", F.lit(True))
    got = {r.request_id: r.title for r in crawl(requests, pages, edges).page_data.filter("depth = 0").collect()}
    # of two pages under one address the smaller id, without that address the smallest id of the key
    assert got == {1: "late", 2: "two", 3: "two", 4: "two"}
    assert {r.request_id: r.title for r in rq.scrape(requests, pages).collect()} == got
    followed = crawl(requests.filter("request_id = 2"), pages, edges)
    assert [r.key for r in followed.admitted.filter("depth = 1").collect()] == ["http://a/two"]


def test_agent_of_each_request(spark):
    pages = site(spark)
    robots = spark.createDataFrame(
        [(H[:-1], 200, "User-agent: A\nDisallow: /b\nUser-agent: B\nDisallow: /", DAY)],
        "origin string, status int, body string, fetched_at timestamp",
    )
    asked = [(1, "A"), (2, "B"), (3, None)]
    requests = spark.createDataFrame(asked, "request_id bigint, agent string").withColumns(
        {"url": F.lit(H + "s"), "extract_links": F.lit(True), "depth": F.lit(2)}
    )
    done = crawl(requests, pages, written_edges(pages), robots)
    got = {}
    for r in done.visited.filter("outcome = 'crawled'").orderBy("depth", "path").collect():
        got[r.request_id] = got.get(r.request_id, "") + r.key[len(H):]
    assert got == {1: "sac", 3: "sabc"}
    assert {r.request_id for r in rq.scrape(requests, pages, robots, "B").collect()} == {1}
    assert {r.request_id for r in rq.page_links(requests, pages, robots).collect()} == {1, 3}
    found = {r.request_id: (r.pages_crawled, r.links_discovered) for r in stats.crawl_stats(done.visited, done.requests).collect()}
    assert found[2] == (0, 0)


def test_steps_are_deleted(spark):
    import os

    pages = site(spark)
    ready = prepare(pages, written_edges(pages))
    done = crawl_site(one(spark), ready)
    folders = [x.steps.folder for x in (done, ready)]
    assert all(map(os.path.isdir, folders))
    done.close()
    ready.close()
    assert not any(map(os.path.isdir, folders))


def test_limit_pages_against_a_count(spark):
    rows = [
        (r, d, [0, i][: d + 1], ["crawled", "skipped", "crawled", "failed"][(i * 7 + r) % 4], (None, 0, 1, 3, 100)[r])
        for r in range(5) for d in range(2) for i in range(40)
    ]
    df = spark.createDataFrame(rows, "request_id long, depth int, path array<int>, outcome string, m long").dropDuplicates(["request_id", "depth", "path"])
    given = df.collect()
    visited = df.select("request_id", "depth", "path", "outcome", F.struct(F.col("m").alias("max_pages")).alias("settings"))
    limited = frontier.limit_pages(visited)
    expected = set()
    for r in range(5):
        n = 0
        for x in sorted((x for x in given if x.request_id == r), key=lambda x: (x.depth, x.path)):
            if x.m is not None and (x.m <= 0 or n < x.m):
                expected.add((r, x.depth, tuple(x.path)))
            n += x.outcome == "crawled"
    assert {(x.request_id, x.depth, tuple(x.path)) for x in limited.collect()} == expected
    plan = limited._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # tasks pass on no more than the limit of a request
    beyond = visited.withColumn("settings", F.struct(F.lit(101).alias("max_pages")))
    with pytest.raises(Exception, match="max_pages beyond 100"):
        frontier.limit_pages(beyond).collect()
