from pyspark.sql import functions as F

from pagetrail.operators import fetching
from pagetrail.operators import requests as rq


def test_defaults_and_bounds(spark):
    given = spark.createDataFrame(
        [
            (1, "http://a", None, None, 3),
            (2, "ftp://a", 6, 0, 11),
            (3, "https://a", 5, 100, 10),
            (4, "http://", -1, 101, 0),
        ],
        "request_id int, url string, depth int, max_pages int, delay int",
    )
    filled = {r.request_id: r for r in rq.with_defaults(given).collect()}
    one = filled[1]
    assert (one.depth, one.max_pages, one.workers, one.delay, one.timeout) == (1, 20, 2, 3, 10)
    assert one.stay_domain and one.robots and one.filter == ""
    assert not (one.seed_only or one.extract_links or one.news)
    errors = {r.request_id: r.errors for r in rq.validate_requests(rq.with_defaults(given)).collect()}
    assert errors == {
        1: [], 2: ["url", "depth", "max_pages", "delay"], 3: [], 4: ["depth", "max_pages"],
    }
    assert [r.request_id for r in rq.valid_requests(given).orderBy("request_id").collect()] == [1, 3]
    assert rq.validate_requests(rq.with_defaults(given), "strict").filter(
        (F.col("request_id") == 4) & F.array_contains("errors", "url")
    ).count() == 1
    budget = rq.with_defaults(given).select(rq.time_budget(F.col("timeout"), F.col("max_pages")).alias("b"))
    assert sorted(r.b for r in budget.collect()) == [30, 230, 1030, 1040]


def test_fetch_outcome(spark):
    log = [
        (0, 200, "text/html; charset=utf-8", None, "ok"),
        (1, 200, "application/xhtml+xml", None, "ok"),
        (2, 200, "Text/HTML", None, "non_html"),
        (3, 200, None, None, "non_html"),
        (4, 204, "text/html", None, "bad_status"),
        (5, 404, "text/plain", None, "bad_status"),
        (6, 200, "text/html", "timeout", "fetch_error"),
        (7, None, None, None, "fetch_error"),
    ]
    df = spark.createDataFrame(log, "page_id int, status int, content_type string, error string, want string")
    assert all(r.outcome == r.want for r in fetching.classify_fetch(df).collect())


def test_single_pages(spark):
    pages = spark.createDataFrame(
        [
            (5, "http://h/p?x=1", "<title>five</title>"),
            (3, "http://h/p?x=2", "<title>three</title><p>t<a href=/a><a href=/a>"),
            (4, "http://h/q", "<p>q"),
        ],
        "page_id bigint, url string, html string",
    )
    asked = spark.createDataFrame(
        [(1, "http://h/p", True), (2, "http://h/p#x", False), (3, "http://h/q", True), (4, "http://h/none", True)],
        "request_id int, url string, extract_links boolean",
    )
    got = {r.request_id: r for r in rq.scrape(asked, pages).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1].url, got[1].title, got[1].content) == ("http://h/p", "three", "t\n")
    assert got[1].links == ["http://h/a"] * 2 and got[2].links == [] and got[3].links == []
    found = {r.request_id: (r.links_found, r.links) for r in rq.page_links(asked, pages).collect()}
    assert found == {1: (2, ["http://h/a"] * 2), 2: (2, ["http://h/a"] * 2), 3: (0, [])}
    # with the indexes of a prepared site, and with an address that its own page answers
    indexes = (fetching.page_index(pages), fetching.address_index(pages))
    more = asked.union(spark.createDataFrame([(5, "http://h/p?x=1", False), (6, None, False), (7, "http://h/%zz", True)], asked.schema))
    for given in (None, indexes):
        records = {r.request_id: r.title for r in rq.scrape(more, pages, indexes=given).collect()}
        assert records == {1: "three", 2: "three", 3: "", 5: "five"}
    missing = rq.not_found(asked, rq.scrape(asked, pages)).collect()
    assert [r.request_id for r in missing] == [4]


def test_pages_meet_the_keys_before_the_shuffle(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "<p>x") for i in range(50)], "page_id bigint, url string, html string")
    asked = spark.createDataFrame([("http://h/3", "http://h/3")], "url string, key string")
    by_key, by_address = fetching.answers_for(asked, pages)
    assert [r.page_id for r in by_address.collect()] == [3]
    plan = by_key._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [key") < plan.index("LeftSemi")
