from pyspark.sql import functions as F

from pagetrail.functions import html

TITLES = {
    "<title> A </title><body><svg><title>B</title></svg>": " A B",
    "<TITLE x='>'>a &amp; b</TITLE>": "a & b",
    "<!-- <title>no</title> --><title>yes</title>": "yes",
    "<script>var s='<title>no</title>'</script><title>yes": "yes",
    "<title>a <b>c</b></title>": "a <b>c</b>",
    "<p>none": "",
    "<title>caf&eacute; &#233;&#xE9;&#128;&#0;&notit; &ampx &am</title>": "café éé€�¬it; &x &am",
}

DESCRIPTIONS = {
    '<meta name=description content="one"><meta name="description" content="two">': "two",
    '<meta name="description" content="one"><meta name=description content="">'
    '<meta property="og:description" content="og">': "og",
    "<meta name=Description content=x>": "",
    '<meta content="a &lt; b" NAME="description"/>': "a < b",
    "<meta name=description content='one'><meta name=description>": "one",
    '<meta data-x="name=description content=no" content="no">': "",
    '<meta name="keywords" name="description" content="no">': "",
}

PARAGRAPHS = {
    "<p> a </p><p></p><p>b<p>c": "a\nb\nc\n",
    "<p>a &amp;quot; b</p>": "a &quot; b\n",
    "<p>a<div>b</div>c</p>d": "a\n",
    "<div><p>a</div>b<p>c": "a\nc\n",
    "<p>a<br>b <b>c</b></p>": "ab c\n",
    "<p>  x　</p>": "x\n",
    "<p>x\r\ny</p>": "x\ny\n",
    "<p>a</p><pre>b</pre><param>c<p class=q>d": "a\nd\n",
    '<script>var t="</p><p>no";</script><p>yes': "yes\n",
    "<p>a<script>b<c && d</script>e": "ab<c && de\n",
    "<p>a<!-- b --- > -->c": "ac\n",
    "<p>a<!-->b-->c": "ab-->c\n",
    "<p>a < b <3": "a < b <3\n",
    "<p title='a>b'>c": "c\n",
    "<p>a<a hre": "a\n",
    "<p>a</p": "a\n",
    "<p>a</": "a</\n",
    "<p>a</>b</ x>c": "abc\n",
    "no": "",
}

NEWS = {
    "<article>x</article><article>y</article>": "x",
    "<article>x<article>y</article>z</article>w": "xyz",
    "<div itemprop='articleBody'> u </div><p itemprop=articleBody>v</p><p>w": " u v",
    '<div itemprop="articleBody">a<div itemprop="articleBody">b</div></div>': "abb",
    "<meta itemprop=articleBody content=q><article> s </article>": " s ",
    "<article></article><div class='post-content'>z</div>": "",
    "<div class='article-content'> </div><div class='post-content'>z</div>": "",
    "<div class='a post-content b'>z<div>y</div></div>w": "z y".replace(" ", ""),
    "<div class='xpost-content'>z</div>": "",
    "<main><p>m1</p><p>m2</p></main><p>no": "m1\nm2",
    "<div class=content><p>c1<div class=content><p>c2</div></div>": "c1\nc2",
    "<div id='story-body'> s </div>": "s",
    "<span class='story-body'>1</span><b class='story-body'>2</b>": "1\n2",
    "<p>nothing": "",
    "<article><pre>\nx\n</pre>y</article>": "x\ny",
    "<article>a<LISTING class=q>\r\nx</LISTING></article>": "ax",
    "<div class=story-body>a<section class='story-body'>b<div>c</div></section>d</div>e<section>": "abcd\nbc",
    "<div class=entry-content>a<div>b": "ab",
    "<p class=entry-content>a<p>b</div>c": "a",
}

BASE = "http://h.example/dir/page?x=1"
LINKS = {
    '<a href="/a">1</a><A class=x HREF=\'b\'>2</A><a name=n>3</a><a href=c>': [
        "http://h.example/a", "http://h.example/dir/b", "http://h.example/dir/c",
    ],
    "<a href=''>x</a><a href='#t'>y</a><a href='mailto:x@y'>z</a>": [],
    '<a href="/x?a=1&amp;b=2&copy=3&lt">x</a>': ["http://h.example/x?a=1&b=2&copy=3<"],
    "<a href=/d>x</a><a href=/d>x</a>": ["http://h.example/d"] * 2,
    "<a data-x='href=no' href='/yes'>": ["http://h.example/yes"],
    "<a href=/one href=/two>": ["http://h.example/one"],
    "<a href='/in'><!-- <a href='/no'> --><noscript><a href='/no'></noscript>": [
        "http://h.example/in"
    ],
    "<abbr href=/no><a\nhref = '/ok' ><area href=/no>": ["http://h.example/ok"],
    "<a href='/cut": [],
    "<a href='/doc.PDF'><a href='/doc.pdf?d=1'>": ["http://h.example/doc.pdf?d=1"],
}


def evaluate(spark, values, expression):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return {r.v: r.out for r in df.select("v", expression(F.col("v")).alias("out")).collect()}


def test_title(spark):
    assert evaluate(spark, TITLES, html.title) == TITLES


def test_description(spark):
    assert evaluate(spark, DESCRIPTIONS, html.description) == DESCRIPTIONS


def test_paragraphs(spark):
    assert evaluate(spark, PARAGRAPHS, html.paragraphs) == PARAGRAPHS


def test_news(spark):
    assert evaluate(spark, NEWS, html.news) == NEWS


def test_links(spark):
    assert evaluate(spark, LINKS, lambda c: html.links(c, F.lit(BASE))) == LINKS


def test_strip_tags(spark):
    given = {
        " <html><head><title>t</title><style>p{}</style></head><p>a&lt;b</p> <b>c</b> ": "tp{}a<b c",
        "<script>1 &lt; 2</script>": "1 &lt; 2",
        "<p>x<textarea>\nq</textarea>": "xq",
        "<textarea>\n\nq": "q",
        "a<pre\nclass=x>\n b": "a b",
        "<script>'<pre>\nx'</script>": "'<pre>\nx'",
        "": "",
    }
    assert evaluate(spark, given, html.strip_tags) == given


def test_element_text(spark):
    page = "<div id=a> one <b>two</b></div><p class='x y'> three <p>four"
    given = {"#a": " one two", ".y": " three ", "b": "two", "[id='a']": " one two", "h1": None}
    for selector, expected in given.items():
        got = evaluate(spark, [page], lambda c: html.element_text(c, selector))
        assert got[page] == expected, selector


def test_large_page(spark):
    page = "<title>t</title>" + "<p>a &amp; b <a href='/x'>y</a>" * 20_000
    got = evaluate(
        spark,
        [page],
        lambda c: F.struct(
            html.paragraphs(c).alias("p"), html.links(c, F.lit(BASE)).alias("l"), html.news(c).alias("n")
        ),
    )[page]
    assert got.p == "a & b y\n" * 20_000
    assert got.l == ["http://h.example/x"] * 20_000
    assert got.n == ""


def test_many_matches_on_one_page(spark):
    import time

    page = "".join(f"<div class='story-body'>text of part {i} <b>é</b> and more of it</div>" for i in range(6400))
    evaluate(spark, ["<div class='story-body'>x</div>"], html.news)
    began = time.perf_counter()
    got = evaluate(spark, [page], html.news)[page]
    assert got.count("\n") == 6399 and got.startswith("text of part 0 é and more of it\n")
    print("seconds", time.perf_counter() - began)
    assert time.perf_counter() - began < 12


def test_links_are_extracted_once(spark):
    from pagetrail.operators import extraction

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = extraction.link_edges(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?i)<a(?=") == 1
