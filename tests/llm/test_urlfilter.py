from helpers import rows

from pagetrail.llm import urlfilter
from pagetrail.llm.queries import RULES

PAGES = "page_id long, url string, html string, host string, r_host string, short string"


def naive(url, rules, default="allow"):
    url = url or ""
    if "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


def test_against_naive(spark):
    urls = [
        None, "", "no scheme/x", "http://", "http://org", "http://org/", "HTTP://A.ORG/x", "http://example.org/es/a", "http://example.org/es",
        "http://sub.Example.org/en/12?q=/es/", "http://notexample.org/es/", "http://example.org:80/es/", "http://x.com/fr/#a", "http://x.com/de/",
        "http://x.com/fr", "http://com/de/", "a://b://c.org/x", "http://u@x.org/\n/x", "http://x.org?/es/", "http://" + "a." * 3000 + "org/" + "y" * 5000, "http://.org/", "http://org./",
    ]
    data = [(i, u, None, "clash", "clash", "clash") for i, u in enumerate([*urls, *urls[5:8]])] + [(None, "http://x.org/", None, None, None, None)]
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = rows(urlfilter.judge(spark.createDataFrame(data, PAGES), rules))
    # host and path come first in the naive answer
    assert got == sorted(((i, *naive(u, RULES)) for i, u, *_ in data), key=repr)


def test_rules_with_gaps(spark):
    rules = [("a.b", None, "block"), ("a.b", "", "allow"), (None, "/", "block"), ("b", "/x", None), ("c", "/x/", "allow"), ("C", "/x", "block")]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "h://z.a.b/q"), (2, "h://b/x"), (3, "h://c/x/y"), (4, "h://c/xy")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge(pages, table).collect()}
    assert got == {1: ("a.b", "block"), 2: (None, "allow"), 3: ("c/x/", "allow"), 4: ("c/x", "block")}
    assert urlfilter.judge(pages.limit(0), table).count() == 0
    assert {r["verdict"] for r in urlfilter.judge(pages, table.limit(0), default="block").collect()} == {"block"}
