from helpers import rows

from pagetrail.llm import extract

PAGES = "page_id long, url string, html string, host string, page string, slot string"


def run(spark, pages):
    return {r[0]: r[2] for r in rows(extract.main_text(spark.createDataFrame([(*p, "clash", "clash", "clash") for p in pages], PAGES)))}


def page(title, *blocks):
    body = "".join(f"<p>{b}</p>" for b in blocks)
    return (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav>"
        f"<!-- ad --><div class='ad'>Buy</div><article><h1>{title}</h1>{body}</article><footer>&copy; x</footer></body></html>"
    )


def test_article_of_a_template(spark):
    pages = [(i, "http://a.org/x", page(f"Title {i}", f"First &amp; {i}  text", "Second\n&lt;b&gt; text")) for i in range(6)]
    assert run(spark, pages) == {i: f"Title {i}\nFirst & {i} text\nSecond <b> text" for i in range(6)}


def test_hosts_without_article(spark):
    text = "A long enough text that is the main thing here, number"
    shell = "<html><body><div id=menu><a>One</a></div><div class='main-text'><h2>H</h2><p>{}<br>tail</div><div class=sidebar>More more more</div><form><p>Name</form><div id='comments'><p>First!</div></body></html>"
    got = run(spark, [(i, "http://b.org/", shell.format(f"{text} {i}")) for i in range(4)])
    assert got == {i: f"H\n{text} {i} tail" for i in range(4)}


def test_copies_and_common_lines_stay(spark):
    pages = [(i, "http://c.org/", page("Same", "Line that all pages have", "Other")) for i in range(5)]
    assert set(run(spark, pages).values()) == {"Same\nLine that all pages have\nOther"}


def test_broken_markup(spark):
    broken = "<html><body><nav><li>m</nav><article><h1>T</h1><p><b>one.<br><p>two</p><p>three &amp four &unknown; <a href='x>y'>link</a></article><footer>f"
    cut = "<html><body><article><h1>T</h1><p>open end"
    got = run(spark, [(1, "http://d.org/", broken), (2, "http://d.org/", cut)])
    assert got == {1: "T\none.\ntwo\nthree & four &unknown; link", 2: "T\nopen end"}


def test_awkward_rows(spark):
    pages = [(1, None, None), (2, "x", ""), (3, "http://e.org", "just text"), (None, "http://e.org", "<p>a</p>"), (4, "http://e.org", "<p>" + "w " * 200_000), (5, "http://e.org", "<"), (6, "http://e.org", "<!--"), (7, "http://e.org", "<script>x")]
    got = run(spark, pages)
    assert [got[i] for i in (1, 2, 3, 6, 7)] == ["", "", "just text", "", ""] and got[None] == "a" and len(got[4]) == 399_999
    deep = [(1, "http://f.org", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    assert run(spark, deep)[1] == "deep"
    assert extract.main_text(spark.createDataFrame([], PAGES)).count() == 0
    repeated = [(1, "http://g.org/", page("T", "x"))] * 3
    assert len(rows(extract.main_text(spark.createDataFrame([(*p, "", "", "") for p in repeated], PAGES)))) == 3


def test_embedded_elements_end_where_they_end(spark):
    inside = [
        ("icon <svg class=i width='1'/> goes on", "icon goes on"),
        ("icon <svg><title>t</title><path d='x'/><svg><g/></svg> in </svg> after", "icon after"),
        ("an <object data=a><object data=b>inner</object> outer</object> after", "an after"),
        ("a <select><option>1<option>2</select> choice", "a choice"),
        ("a <template><p>t</p><template>u</template> v</template> after", "a after"),
        ("open <svg><path d='x'></p><p>next", "open\nnext"),
        ("open <svg><path d='x'><p>next", "open\nnext"),
        ("own <title-bar>bar</title-bar> element", "own bar element"),
        ("icon <svg><style/><title/><path/></svg> after", "icon after"),
    ]
    pages = [(i, f"http://h{i}.org/", f"<html><body><article><p>{a}</p><p>the rest</p></article></body></html>") for i, (a, _) in enumerate(inside)]
    assert run(spark, pages) == {i: f"{b}\nthe rest" for i, (_, b) in enumerate(inside)}


def test_words_of_a_class_do_not_drop_what_holds_the_text(spark):
    text = "A long enough text that is the main thing here, number"
    shells = [
        "<div class='layout has-sidebar'><article><p>{}</p></article><div class=sidebar>More</div></div>",
        "<div id='content' class='no-sidebar'><p>{}</p><div class=share>Share</div></div>",
        "<div class='post comments-open'><p>{}</p></div><div class=comments><p>First!</p></div>",
        "<form id=aspnet><div><p>{}</p></div></form>",
        "<main><div class='has-sidebar'><article><p>{}</p></article></div><div class=comments><article>First!</article></div></main>",
        "<div class='header-fixed'><div class=menu>" + "menu " * 4 + "</div><article><p>{}</p></article></div>",
    ]
    for n in (1, 4):
        pages = [(10 * h + i, f"http://h{h}.org/", f"<html><body>{x.format(f'{text} {i}')}</body></html>") for h, x in enumerate(shells) for i in range(n)]
        assert run(spark, pages) == {10 * h + i: f"{text} {i}" for h in range(len(shells)) for i in range(n)}


def test_all_slots_are_extracted(spark):
    def lead(i):
        return f"<html><body><nav>n</nav><div class=lead><p>{'lead ' * 8}{i}</p></div><div class=story><p>{'story ' * 10}{i}</p></div></body></html>"

    def small(i):
        return f"<html><body><div class=lead><p>small {i}</p></div><div class=story><p>{'story ' * 100}{i}</p></div></body></html>"

    pages = [(i, "http://a.org/", lead(i)) for i in range(4)] + [(10 + i, "http://b.org/", small(i)) for i in range(4)]
    want = {i: f"{'lead ' * 8}{i}\n{'story ' * 10}{i}" for i in range(4)} | {10 + i: f"small {i}\n{'story ' * 100}{i}" for i in range(4)}
    assert run(spark, pages) == want


def test_one_page_with_two_articles_leaves_the_slot(spark):
    shell = "<html><body><div class=top>Home and more</div>{}</body></html>"
    texts = [f"{'the main text of this page is long ' * 3}{i}" for i in range(8)]
    pages = [(i, "http://a.org/", shell.format(f"<article><p>{t}</p></article>")) for i, t in enumerate(texts)]
    pages.append((8, "http://a.org/", shell.format(f"<article><p>{texts[0]}</p></article><article><p>{texts[1]}</p></article>")))
    assert run(spark, pages) == dict(enumerate(texts)) | {8: f"{texts[0]}\n{texts[1]}"}
