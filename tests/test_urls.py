import pytest
from pyspark.sql import functions as F

from pagetrail.functions import urls

BASE = "http://h.example/dir/page?x=1"

RESOLVED = {
    "/The": "http://h.example/The",
    "b.html": "http://h.example/dir/b.html",
    "../c": "http://h.example/c",
    "/x/./y/../z": "http://h.example/x/z",
    "..": "http://h.example/",
    ".": "http://h.example/dir/",
    "/a//../b": "http://h.example/a/b",
    "?q=2": "http://h.example/dir/page?q=2",
    "//o.example/z": "http://o.example/z",
    "HTTP://H.example/x": "http://H.example/x",
    "/erüver": "http://h.example/er%C3%BCver",
    "/a(b)": "http://h.example/a(b)",
    "/a%2Fb/ü": "http://h.example/a/b/%C3%BC",
    "/it's é(": "http://h.example/it%27s%20%C3%A9%28",
    "/x#frag": "http://h.example/x#frag",
    "/x#": "http://h.example/x",
    "/x?": "http://h.example/x?",
    "/x#é": "http://h.example/x#%C3%A9",
    "/é?q=ü": "http://h.example/%C3%A9?q=ü",
    " /x": "http://h.example/dir/%20/x",
    "///x": "http://h.example///x",
    "//": BASE,
    "http:/x": "http:/x",
    "http://exämple.com/a": "http://ex%C3%A4mple.com/a",
    "http://[::1]:80/x": "http://[::1]:80/x",
    "/a%2": None,
    "/a\nb": None,
    "a:b/c": "a:b/c",
    "1a:b": None,
    " http://x/": None,
    ":x": None,
    "/x#%zz": None,
    "http://a b/": None,
    "http://a.b:x/": None,
    "http://a.b/%zz": None,
    "mailto:x@y": "mailto:x@y",
}

KEYS = {
    "http://a.b/p?x=1#f": "http://a.b/p",
    "http://a.b/p": "http://a.b/p",
    "http://a.b": "http://a.b",
    "http://a.b?x=1": "http://a.b",
    "http://a.b/": "http://a.b/",
    "http://A.b/p": "http://A.b/p",
    "HTTPS://a.b/p": "https://a.b/p",
    "http://a.b/x%20y": "http://a.b/x y",
    "http://a.b/x+y": "http://a.b/x+y",
    "http://u:p@a.b:8080/p": "http://a.b:8080/p",
    "http://[::1]:80/x": "http://[::1]:80/x",
    "http://a.b/caf%E9": "http://a.b/caf\ufffd\ufffd2F636166E9",
    "http://a.b/x#%zz": None,
    "http://a.b/%zz": None,
    "http://a b/": None,
}

SKIPPED = {
    "http://h/doc.PDF": True,
    "http://h/doc.pdf?d=1": False,
    "http://node.js": True,
    "http://h/Loginx": True,
    "http://h/blog/register-now": True,
    "http://h/search?q=a": True,
    "http://h/feed/": True,
    "http://h/search": False,
    "http://h/feed": False,
    "http://h/searchx": False,
}


def evaluate(spark, values, expression):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return {r.v: r.out for r in df.select("v", expression(F.col("v")).alias("out")).collect()}


def test_resolve(spark):
    got = evaluate(spark, RESOLVED, lambda c: urls.resolve_url(F.lit(BASE), c))
    assert got == RESOLVED


@pytest.mark.parametrize(
    "base, expected",
    [("http://a.b", "http://a.b/c"), ("http://a.b/%zz", None), ("http://u:p@a.b/x/y", "http://u:p@a.b/x/c")],
)
def test_resolve_against_base(spark, base, expected):
    got = evaluate(spark, ["c"], lambda c: urls.resolve_url(F.lit(base), c))
    assert got["c"] == expected


def test_canonical_key(spark):
    assert evaluate(spark, KEYS, urls.canonical_key) == KEYS


def test_key_is_host_and_path_of_parts(spark):
    parsed = evaluate(spark, KEYS, urls.url_parts)
    hosts = evaluate(spark, KEYS, urls.url_host)
    paths = evaluate(spark, KEYS, urls.url_path)
    origins = evaluate(spark, KEYS, urls.url_origin)
    for url, key in KEYS.items():
        if key is None:
            assert parsed[url] is None and hosts[url] is None and origins[url] is None
            continue
        assert hosts[url] == parsed[url].host
        assert paths[url] == parsed[url].path
        assert origins[url] == f"{parsed[url].scheme}://{parsed[url].host}"
        assert key == origins[url] + paths[url]


def test_keys_are_equal_when_bytes_are(spark):
    from urllib.parse import unquote_to_bytes

    paths = [
        "/%ff", "/%FF", "/%fF", "/%25FF", "/%25ff", "/é%ff", "/%c3%A9%Ff", "/%c3%a9", "/é", "/%41", "/A", "/%e2%82A", "/%e2%82%41",
        "/\ufffd", "/%ef%bf%bd", "/\ufffdFF", "/\ufffd\ufffd2FFF", "/%C0%80", "/%00", "/x+y", "/x%2By", "/x%20y", "/%ff%fe", "/%fe%ff",
    ]
    got = evaluate(spark, [f"http://h{p}" for p in paths], urls.canonical_key)
    keys = {p: got[f"http://h{p}"] for p in paths}
    assert all(keys.values())
    for a in paths:
        for b in paths:
            assert (keys[a] == keys[b]) == (unquote_to_bytes(a) == unquote_to_bytes(b)), (a, b)
    assert keys["/%c3%a9"] == "http://h/é" and keys["/x+y"] == "http://h/x+y"


def test_skip(spark):
    assert evaluate(spark, SKIPPED, urls.should_skip) == SKIPPED


def test_filters(spark):
    live = evaluate(spark, ["", "#x", "/x", "?x"], urls.is_live_href)
    assert live == {"": False, "#x": False, "/x": True, "?x": True}
    http = evaluate(spark, ["http://a", "https://a", "ftp://a", "HTTP://a"], urls.is_http)
    assert http == {"http://a": True, "https://a": True, "ftp://a": False, "HTTP://a": False}
    kept = evaluate(spark, ["/Wiki", "/wiki"], lambda c: urls.url_contains(c, F.lit("/wiki")))
    assert kept == {"/Wiki": False, "/wiki": True}
    assert evaluate(spark, ["x"], lambda c: urls.url_contains(c, F.lit("")))["x"]
    assert evaluate(spark, ["x"], lambda c: urls.url_contains(c, F.lit(None)))["x"]


def test_valid_url(spark):
    given = ["http://a.b", "HTTPS://a.b/x", "http://", "http:///x", "ftp://a.b", "a.b", ""]
    strict = evaluate(spark, given, urls.valid_url)
    assert [u for u in given if strict[u]] == ["http://a.b", "HTTPS://a.b/x"]
    prefix = evaluate(spark, given, lambda c: urls.valid_url(c, "prefix"))
    assert [u for u in given if prefix[u]] == ["http://a.b", "http://", "http:///x"]


def test_long_input_needs_no_deep_stack(spark):
    long = ["/" + "ü" * 200_000, "http://" + "ä" * 200_000 + "/x", "/" + "a/../" * 500]
    got = evaluate(spark, long, lambda c: urls.resolve_url(F.lit(BASE), c))
    assert got[long[0]] == "http://h.example/" + "%C3%BC" * 200_000
    assert got[long[1]] == "http://" + "%C3%A4" * 200_000 + "/x"
    assert got[long[2]] == "http://h.example/"
