import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pagetrail.functions import robots as text
from pagetrail.functions import search
from pagetrail.lineage import cut_lineage
from pagetrail.operators import robots as rb

AGENT = "Bot/1"
VERDICTS = [
    ("User-agent: *\nDisallow: /private\nAllow: /private/pub", "/private/pub/a", False),
    ("User-agent: Bot/1\nAllow: /x\nDisallow: /x/y", "/x/y", True),
    ("User-agent: Bot/1\nAllow: /x\nUser-agent: *\nDisallow: /", "/z", False),
    ("User-agent: Bot\nDisallow: /", "/", True),
    ("User-agent: bot/1\nDisallow: /", "/", True),
    ("User-agent: Bot/1\nUser-agent: B\nDisallow: /", "/", True),
    ("User-agent: *\nDisallow:", "/", True),
    ("User-agent: *\nDisallow: /p # c", "/p", True),
    ("Disallow: /\nUser-agent: Bot/1", "/", True),
    ("  USER-AGENT :\tBot/1\r\n#Allow: /\r\nDisallow : /q\r\nno colon", "/q/x", False),
    ("User-agent: *\nDisallow: /a\nUser-agent: Bot/1\nAllow: /a", "/a", True),
    ("User-agent: *\nDisallow: /", "", False),
    ("", "/", True),
]
DELAYS = {
    "": 1.0, "abc": 1.0, "0": 1.0, "-3": 1.0, "5s": 1.0, "0.5": 0.5, "10": 10.0, "+2": 2.0,
    "1m30": 90.0, "1m": 0.001, ".5": 0.5, ".": 1.0, "1.": 1.0, "1h1m1": 3661.0, "1 ": 1.0,
    "2e3": 1.0, "99999999999999": 1.0,
}


def test_verdicts(spark):
    robots = spark.createDataFrame(
        [(f"http://h{i}", 200, body, None) for i, (body, _, _) in enumerate(VERDICTS)],
        "origin string, status int, body string, fetched_at timestamp",
    )
    urls = spark.createDataFrame(
        [(i, f"http://h{i}{path}?q=/") for i, (_, path, _) in enumerate(VERDICTS)],
        "case int, url string",
    )
    got = rb.robots_verdict(urls, rb.parse_robots(robots), AGENT).collect()
    assert {r.case: r.allowed for r in got} == {i: v for i, (_, _, v) in enumerate(VERDICTS)}


def test_many_rules_against_a_scan(spark):
    draw = random.Random(5)

    def path(most):
        return "/" + "".join(draw.choice("ab/é") for _ in range(draw.randrange(most)))

    files, wanted = {}, {}
    for h in range(6):
        lines, rules, agent = [], [], None
        for number in range([0, 1, 8, 60, 400, 3000][h]):
            if number % 40 == 0:
                agent = draw.choice(["*", AGENT, "other", "Bot"])
                lines.append(f"User-agent: {agent}")
            else:
                prefix, allow = path(7), draw.random() < 0.5
                lines.append(f"{'Allow' if allow else 'Disallow'}: {prefix}")
                rules.append((agent, prefix, allow))
        files[h] = "\n".join(lines)
        for _ in range(150):
            p = path(9)
            own = [a for n, x, a in rules if n == AGENT and p.startswith(x)]
            every = [a for n, x, a in rules if n == "*" and p.startswith(x)]
            wanted[f"http://h{h}{p}"] = (own + every + [True])[0]
    robots = spark.createDataFrame(
        [(f"http://h{h}", 200, body, None) for h, body in files.items()],
        "origin string, status int, body string, fetched_at timestamp",
    )
    urls = spark.createDataFrame([(u,) for u in wanted], "url string")
    parsed = rb.parse_robots(robots)
    for table, agent in ((parsed, AGENT), (rb.with_index(parsed), F.lit(AGENT))):
        got = {r.url: r.allowed for r in rb.robots_verdict(urls, table, agent).collect()}
        assert got == wanted
    assert {r.allowed for r in rb.robots_verdict(urls, parsed, F.lit(None).cast("string")).collect()} == {True, False}


def test_rules_keep_order_and_line_numbers(spark):
    body = "#\nUser-agent: A\nDisallow: /1\n\nAllow: /2\nUser-agent: B\nCrawl-delay: 3\nAllow: /3"
    robots = spark.createDataFrame(
        [("http://h", 200, body, None), ("http://g", 404, body, None)],
        "origin string, status int, body string, fetched_at timestamp",
    )
    rows = rb.robots_rules(robots).orderBy("line_no").collect()
    assert [(r.origin, r.agent, r.line_no, r.path, r.allow) for r in rows] == [
        ("http://h", "A", 2, "/1", False),
        ("http://h", "A", 4, "/2", True),
        ("http://h", "B", 7, "/3", True),
    ]
    assert {r.origin: r.crawl_delay_s for r in rb.crawl_delay(robots).collect()} == {
        "http://h": 3.0,
        "http://g": 1.0,
    }


def test_delays(spark):
    df = spark.createDataFrame([(d,) for d in DELAYS], "d string")
    body = F.concat(F.lit("User-agent: *\nCrawl-delay: "), F.col("d"))
    got = {r.d: r.s for r in df.select("d", text.delay_of(body).alias("s")).collect()}
    assert got == DELAYS
    last = F.lit("Crawl-delay: 2\nUser-agent: O\nCrawl-delay: 7\nCrawl-delay: x")
    assert df.select(text.delay_of(last).alias("s")).first().s == 7.0


def test_missing_robots_are_open(spark):
    robots = spark.createDataFrame(
        [("http://a", 200, "User-agent: *\nCrawl-delay: 4\nDisallow: /", None), ("http://b", 500, "x", None)],
        "origin string, status int, body string, fetched_at timestamp",
    )
    origins = spark.createDataFrame([(o,) for o in ("http://a", "http://b", "http://c")], "origin string")
    got = {r.origin: r for r in rb.usable_robots(origins, robots).collect()}
    assert got["http://a"].usable and got["http://a"].crawl_delay_s == 4.0
    for o in ("http://b", "http://c"):
        assert not got[o].usable and got[o].rules == [] and got[o].crawl_delay_s == 1.0
    urls = spark.createDataFrame([("http://a/x",), ("http://b/x",), ("http://c/",), ("http://a/%zz",)], "url string")
    kept = rb.drop_denied(urls, rb.latest_robots(robots), AGENT).collect()
    assert sorted(r.url for r in kept) == ["http://b/x", "http://c/"]
    assert rb.drop_denied(urls, rb.latest_robots(robots), AGENT, respect=False).count() == 4


def test_asof(spark):
    day = dt.datetime(2024, 1, 1)
    hours = dt.timedelta(hours=1)
    snapshots = spark.createDataFrame(
        [("http://h", day), ("http://h", day + 30 * hours), ("http://g", day)],
        "origin string, fetched_at timestamp",
    )
    offsets = [-1, 0, 24, 24.5, 30, 40, 55] + [31 + i / 10 for i in range(20)]
    visits = spark.createDataFrame(
        [(i, "http://h/x", day + o * hours) for i, o in enumerate(offsets)]
        + [(100, "http://n/x", day), (101, "http://h/%zz", day), (102, None, day)],
        "visit_id bigint, url string, at timestamp",
    )
    got = {r.visit_id: r for r in rb.robots_asof(visits, snapshots).collect()}
    assert len(got) == len(offsets) + 3
    for i, o in enumerate(offsets):
        held = [h for h in (0, 30) if h <= o]
        expected = day + held[-1] * hours if held else None
        assert got[i].robots_at == expected
        assert got[i].needs_refetch == (not held or o - held[-1] > 24)
    for i in (100, 101, 102):
        assert got[i].needs_refetch and got[i].robots_at is None
    assert got[101].origin is None


def test_asof_over_months(spark):
    """Months without files, times at the border of months, repeated and null rows, against a plain search."""
    rnd = random.Random(2)
    day = dt.datetime(2023, 11, 20)
    files = [(f"http://h{rnd.randint(0, 3)}", day + dt.timedelta(hours=rnd.choice([0, 264, 1000, 3000]) + rnd.randint(0, 90))) for _ in range(80)]
    files += [("http://h0", dt.datetime(2024, 1, 1)), ("http://h0", dt.datetime(2023, 12, 31, 23, 59, 59, 999999))]
    snapshots = spark.createDataFrame(files * 2 + [(None, day), ("http://h1", None)], "origin string, fetched_at timestamp")
    rows = [(i, f"http://h{rnd.randint(0, 4)}/{i}", day + dt.timedelta(hours=rnd.randint(-20, 4000))) for i in range(400)]
    rows += [(900, "http://h0/", dt.datetime(2024, 1, 1)), (901, "http://h0/", None), (902, "no origin", day)]
    visits = spark.createDataFrame(rows, "visit_id bigint, url string, at timestamp")
    got = {r.visit_id: r for r in rb.robots_asof(visits, rb.robots_index(snapshots)).collect()}
    assert len(got) == len(rows)
    for i, url, at in rows:
        held = [f for o, f in files if at is not None and url.startswith(o + "/") and f <= at]
        assert got[i].robots_at == max(held, default=None)
        assert got[i].needs_refetch == (not held or at - max(held) > dt.timedelta(days=1))


SPLIT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
}


@pytest.mark.parametrize("settings", [{}, SPLIT])
def test_asof_spreads_a_hot_origin(spark, settings):
    """Nine tenths of the visits are of one origin: no window or sort by time gathers them, joins leave or split them."""
    day = dt.datetime(2024, 1, 1)
    snapshots = spark.createDataFrame([(f"http://h{i}", day) for i in range(20)], "origin string, fetched_at timestamp")
    index = tuple(cut_lineage(x, "index") for x in rb.robots_index(snapshots))
    visits = spark.range(0, 20000, 1, 8).selectExpr(
        "id AS visit_id", "concat('http://h', if(id % 10 = 0, id % 200 div 10, 7), '/', id) AS url", "timestamp_seconds(1704067200 + id) AS at"
    )
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = rb.robots_asof(visits, index)
        assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
        parts = (
            found.filter("origin = 'http://h7'").select(F.spark_partition_id().alias("p"), "robots_at")
            .groupBy("p").agg(F.count("robots_at").alias("n")).collect()
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(r.n for r in parts) == 18100 and len(parts) >= 4 and max(r.n for r in parts) < 8000


def test_binary_search(spark):
    values = list(range(0, 2000, 3))
    rows = [(v, x) for v in ([], [5], [1, 1, 2], values) for x in (-1, 0, 1, 2, 5, 6, 1000, 1998, 5000)] + [(None, 1), ([1], None)]
    df = spark.createDataFrame(rows, "v array<int>, x int").select("v", "x", search.count_up_to("v", "x").alias("n"), search.last_up_to("v", "x").alias("l"))
    for r in df.collect():
        below = [y for y in r.v or [] if r.x is not None and y <= r.x]
        assert (r.n, r.l) == (len(below), below[-1] if below else None)


@pytest.mark.parametrize("bound", [1_000_000, 4])
def test_schedule(spark, bound):
    rows = [(1, f"http://h/{i}", 0, [0, i], 1) for i in range(25)] + [(1, "http://g/", 1, [0, 0], 1)]
    visited = spark.createDataFrame(
        rows, "request_id bigint, url string, depth int, path array<int>, delay int"
    )
    parsed = rb.parse_robots(
        spark.createDataFrame(
            [("http://h", 200, "Crawl-delay: 2.5", None)],
            "origin string, status int, body string, fetched_at timestamp",
        )
    )
    got = {r.url: r.fetch_offset_s for r in rb.fetch_schedule(visited, parsed, bound).collect()}
    assert got == {**{f"http://h/{i}": 2.5 * (i + 1) for i in range(25)}, "http://g/": 1.0}
