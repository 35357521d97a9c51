"""HTML expressions: title, description, paragraphs, article text, links.

A page is *prepared* once: comments go, and the inside of raw-text elements
(scripts, styles, titles ...) is masked so that no tag can be found there.  All
extractors then work on the prepared text with regular expressions and
higher-order functions, so a whole page record is one projection over one scan.

The public functions take raw html.  Those ending in ``_of`` take prepared
text, for callers that extract several fields from the same page.
"""

from __future__ import annotations

from .entities import decode_entities
from .sqltext import S, Sql, expression, let
from .text import rest, trim_space
from .tree import build
from .urls import is_http, is_live_href, resolve_all, should_skip

# Fixed values of the HTML standard.
RAW_TEXT = ("script", "style", "noscript", "iframe", "noembed", "noframes", "xmp")
RAW_TEXT_WITH_ENTITIES = ("title", "textarea")
VOID_ELEMENTS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
    "param", "source", "track", "wbr",
)
# Where article text is looked for when nothing better is found.
ARTICLE_SELECTORS = (
    ".article-content", ".post-content", ".entry-content", "#article-body",
    "#story-body", ".story-body", "main p", ".content p",
)

# Characters of the private use area that stand for < and & in raw text.
_MASKED_LT = "\ue000"
_MASKED_AMP = "\ue001"

_EDGE = r"(?=[\s/>])"
_ATTRIBUTE = r"""[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?+"""
_GAP = r"[\s/=]*+"
_TAG_END = rf"(?:{_GAP}{_ATTRIBUTE})*+{_GAP}>"
_ANY_TAG = rf"<(?:[a-zA-Z][^\s/>]*+{_TAG_END}|/[a-zA-Z][^>]*+>)"
_VALUE = r"""("[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+)"""

# Elements that do not begin with a line end.
_FIRST_LINE_END_GOES = "pre|listing|textarea"

_RAW_NAMES = "|".join(RAW_TEXT + RAW_TEXT_WITH_ENTITIES)
_RAW_START = rf"<(?:{_RAW_NAMES}){_EDGE}{_TAG_END}"
_TOKEN = (
    r"(?is)<!--(?:-?>|.*?(?:--!?>|\z))"
    r"|<[!?][^>]*+(?:>|\z)"
    r"|</(?:[^a-z>][^>]*+(?:>|\z)|>)"
    rf"|<({_RAW_NAMES}){_EDGE}{_TAG_END}.*?(?=</\1[\s/>]|\z)"
    rf"|(?:[^<]++|<(?![!?]|/[^a-z]|(?:{_RAW_NAMES})[\s/>]))++"
    r"|<"
)
_DROPPED_TOKEN = r"^<(?:[!?]|/[^a-zA-Z])"
_CUT_OFF_TAG = r"</?[a-zA-Z][^>]*+\z"

_PARAGRAPH = rf"(?i)<p{_EDGE}{_TAG_END}((?:[^<]++|<(?!/?p{_EDGE}))*+)"


@expression
def prepare(html: Sql) -> Sql:
    """Drop comments, cut-off tags and the line end a ``pre`` begins with, mask raw text, unify line ends."""

    def token(t: Sql) -> Sql:
        opening = S.regexp_extract(t, f"(?i)^{_RAW_START}", 0)
        with_entities = t.rlike(rf"(?i)^<(?:{'|'.join(RAW_TEXT_WITH_ENTITIES)})[\s/>]")
        inside = rest(t, S.length(opening))
        masked = S.when(with_entities, S.translate(inside, "<", _MASKED_LT)).otherwise(
            S.translate(inside, "<&", _MASKED_LT + _MASKED_AMP)
        )
        return (
            S.when(~t.startswith("<"), t)
            .when(t.rlike(_DROPPED_TOKEN), "")
            .when(t.rlike(rf"(?i)^<(?:{_RAW_NAMES})[\s/>]"), S.concat(opening, masked))
            .otherwise(t)
        )

    text = S.when(html.contains("\r"), S.regexp_replace(html, "\r\n?", "\n")).otherwise(html)
    tokens = S.regexp_extract_all(text, _TOKEN, 0)
    joined = S.array_join(S.transform(tokens, token), "")
    whole = S.regexp_replace(joined, _CUT_OFF_TAG, "")
    return let(
        whole,
        lambda w: S.when(
            w.rlike(rf"(?i)<(?:{_FIRST_LINE_END_GOES}){_EDGE}"),
            S.regexp_replace(w, rf"(?i)(<(?:{_FIRST_LINE_END_GOES}){_EDGE}{_TAG_END})\n", "$1"),
        ).otherwise(w),
    )


@expression
def parse(html: Sql) -> Sql:
    """The prepared page as a tree builder understands it: every element opened and closed."""
    standard = S.rlike(html, r"(?is)^\s*+(?:<!--(?:-?>|.*?--!?>)\s*+)*+<!doctype\s++html\b")
    return let(S.struct(prepare(html).alias("doc"), standard.alias("standard")), lambda x: build(x["doc"], ~x["standard"], _ANY_TAG, _TAG_END))


def _plain(markup: Sql) -> Sql:
    """Text of a piece of prepared markup: no tags, entities decoded."""

    def untagged(m: Sql) -> Sql:
        return S.when(m.contains("<"), S.regexp_replace(m, _ANY_TAG, "")).otherwise(m)

    def unmasked(t: Sql) -> Sql:
        masked = t.contains(_MASKED_LT) | t.contains(_MASKED_AMP)
        return S.when(masked, S.translate(t, _MASKED_LT + _MASKED_AMP, "<&")).otherwise(t)

    return let(let(markup, untagged), lambda u: let(decode_entities(u), unmasked))


def _unquoted(value: Sql) -> Sql:
    def inside(v: Sql) -> Sql:
        quoted = v.startswith('"') | v.startswith("'")
        return S.when(quoted, S.substr(v, 2, S.length(v) - 2)).otherwise(v)

    return let(value, inside)


def _named(name: str) -> str:
    """Pattern from the element name up to the first attribute of that name."""
    not_it = rf"(?!{name}(?:[\s=/>]))"
    return rf"(?:{_GAP}{not_it}{_ATTRIBUTE})*+{_GAP}{name}"


def _attributes(tag: Sql, *names: str) -> Sql:
    """Decoded values of attributes of one start tag; null where absent."""

    def raw(name: str) -> Sql:
        opened = rf"(?i)^<[a-z][^\s/>]*+{_named(name)}"
        value = _unquoted(S.regexp_extract(tag, rf"{opened}\s*+=\s*+{_VALUE}", 1))
        return S.when(tag.rlike(rf"{opened}[\s=/>]"), value)

    return S.transform(
        S.array(*map(raw, names)), lambda v: decode_entities(v, in_attribute=True)
    )


# -- title and description -------------------------------------------------


@expression
def title_of(doc: Sql) -> Sql:
    found = S.regexp_extract_all(doc, rf"(?i)<title{_EDGE}{_TAG_END}([^<]*+)", 1)
    return _plain(S.array_join(found, ""))


@expression
def title(html: Sql) -> Sql:
    """Text of all title elements, joined and untrimmed."""
    return let(prepare(html), title_of)


@expression
def description_of(doc: Sql) -> Sql:
    def last(tags: Sql, place: int, wanted: str) -> Sql:
        named = S.filter(tags, lambda t: (S.get(t, place) == wanted) & S.get(t, 2).isNotNull())
        return S.get(S.try_element_at(named, -1), 2)

    tags = S.regexp_extract_all(doc, rf"(?i)<meta{_EDGE}{_TAG_END}", 0)
    # the word may only be missing where it is spelt with references
    near = S.filter(tags, lambda t: t.contains("description") | t.contains("&"))
    parsed = S.transform(near, lambda t: _attributes(t, "name", "property", "content"))
    return let(
        parsed,
        lambda t: S.coalesce(
            let(last(t, 0, "description"), lambda v: S.when(v != "", v)),
            last(t, 1, "og:description"),
            "",
        ),
    )


@expression
def description(html: Sql) -> Sql:
    """Last meta description with content, else the last og:description."""
    return let(prepare(html), description_of)


# -- paragraphs ------------------------------------------------------------


def _paragraph_markup(doc: Sql) -> Sql:
    """Markup of every paragraph of a tree in order."""
    opening = _opening("p")
    nested = rf"(?i)<p{_EDGE}(?:[^<]++|<(?!/?p{_EDGE}))*+<p{_EDGE}"
    return S.when(
        doc.rlike(nested),
        S.transform(S.array_sort(_elements(doc, opening, S.lit("p"))), lambda s: s["inside"]),
    ).otherwise(S.regexp_extract_all(doc, _PARAGRAPH, 1))


@expression
def paragraphs_of(doc: Sql) -> Sql:
    trimmed = S.transform(_paragraph_markup(doc), lambda p: trim_space(_plain(p)))
    kept = S.filter(trimmed, lambda t: t != "")
    return S.array_join(S.transform(kept, lambda t: S.concat(t, "\n")), "")


@expression
def paragraphs(html: Sql) -> Sql:
    """Trimmed, non-empty paragraph texts, each followed by a line end."""
    return let(parse(html), paragraphs_of)


# -- elements by selector --------------------------------------------------


def _opening(selector: str) -> str:
    """Pattern of the start tags a selector matches; group 1 is the tag name."""
    if selector.startswith("["):
        name, value = selector[1:-1].split("=", 1)
        value = value.strip("'\"")
    elif selector.startswith("#"):
        name, value = "id", selector[1:]
    elif selector.startswith("."):
        name, value = "class", None
    else:
        return rf"<((?i:{selector})){_EDGE}{_TAG_END}"
    if value is None:
        token = rf"\Q{selector[1:]}\E"
        inside = (
            rf"""(?:"(?:[^"]*\s)?{token}(?:\s[^"]*)?"|'(?:[^']*\s)?{token}(?:\s[^']*)?'"""
            rf"""|{token}(?=[\s>]))"""
        )
    else:
        inside = rf"""(?:"\Q{value}\E"|'\Q{value}\E'|\Q{value}\E(?=[\s>]))"""
    attribute = rf"(?i:{_named(name)})\s*+=\s*+{inside}"
    return rf"<([a-zA-Z][^\s/>]*+){attribute}{_TAG_END}"


def _balanced(after: Sql, name: Sql) -> Sql:
    """Inside of an element, given its name and all that follows its start tag."""

    edge = S.concat(r"/?\Q", name, r"\E[\s/>]")
    own_tag = S.concat("(?i)^<", edge)

    def cut(pieces: Sql) -> Sql:
        # depth 0 means closed; the length of everything before is the result
        walked = S.aggregate(
            pieces,
            S.struct(S.lit(1).alias("depth"), S.lit(0).alias("taken")),
            lambda acc, p: let(
                S.when(acc["depth"] == 0, 0)
                .when(~S.rlike(p, own_tag), acc["depth"])
                .when(p.startswith("</"), acc["depth"] - 1)
                .otherwise(acc["depth"] + 1),
                lambda depth: S.struct(
                    depth.alias("depth"),
                    (
                        acc["taken"] + S.when(depth == 0, 0).otherwise(S.length(p))
                    ).alias("taken"),
                ),
            ),
        )
        return walked["taken"]

    pieces = S.regexp_extract_all(
        after,
        S.concat("(?i)(?:<", edge, ")?(?:[^<]++|<(?!", edge, "))*+"),
        0,
    )
    nested = S.substr(after, 1, let(pieces, cut))
    lowered = S.lower(name)
    return S.when(lowered.isin(*VOID_ELEMENTS), "").otherwise(nested)


def _elements(doc: Sql, opening: str, name: Sql) -> Sql:
    """Struct(start, end, inside) of the matching elements of one name.

    The text is cut once at all tags of that name; a stack of open elements gives each end, and
    what is inside is put together from the pieces, so the work grows with the page and with what is found.
    """
    tag = S.concat(r"\Q", name, r"\E[\s/>]")
    cut = S.concat("(?i)(?:</?", tag, ")?(?:[^<]++|<(?!/?", tag, "))*+")
    is_open, is_close = S.concat("(?i)^<", tag), S.concat("(?i)^</", tag)
    opened = "array<struct<i:int,start:int,hit:boolean>>"
    closed = "array<struct<start:int,end:int,i:int,j:int>>"

    def step(acc: Sql, piece: Sql) -> Sql:
        held = acc["held"]
        top = S.try_element_at(held, -1)
        closing = S.rlike(piece, is_close) & (S.size(held) > 0)
        mark = S.struct(
            acc["i"].alias("i"), acc["at"].alias("start"), S.rlike(piece, f"^(?:{opening})").alias("hit")
        )
        found = S.struct(
            top["start"].alias("start"), acc["at"].alias("end"), top["i"].alias("i"), acc["i"].alias("j")
        )
        return S.struct(
            (acc["i"] + 1).alias("i"),
            (acc["at"] + S.length(piece)).alias("at"),
            S.when(closing, S.slice(held, 1, S.size(held) - 1))
            .when(S.rlike(piece, is_open), S.concat(held, S.array(mark)))
            .otherwise(held)
            .alias("held"),
            S.when(closing & top["hit"], S.concat(acc["found"], S.array(found)))
            .otherwise(acc["found"])
            .alias("found"),
        )

    def ends(pieces: Sql) -> Sql:
        walked = S.aggregate(
            pieces,
            S.struct(
                S.lit(0).alias("i"),
                S.lit(0).alias("at"),
                S.array().cast(opened).alias("held"),
                S.array().cast(closed).alias("found"),
            ),
            step,
        )
        return let(
            walked,
            lambda w: S.concat(
                w["found"],
                S.transform(
                    S.filter(w["held"], lambda h: h["hit"]),
                    lambda h: S.struct(
                        h["start"].alias("start"), w["at"].alias("end"), h["i"].alias("i"), S.size(pieces).alias("j")
                    ),
                ),
            ),
        )

    def inside(pieces: Sql, f: Sql) -> Sql:
        first = S.regexp_replace(S.get(pieces, f["i"]), f"^(?:{opening})", "")
        return S.when(S.lower(name).isin(*VOID_ELEMENTS), "").otherwise(
            S.concat(first, S.array_join(S.slice(pieces, f["i"] + 2, f["j"] - f["i"] - 1), ""))
        )

    return let(
        S.regexp_extract_all(doc, cut, 0),
        lambda pieces: S.transform(
            ends(pieces),
            lambda f: let(
                inside(pieces, f),
                lambda text: S.struct(
                    f["start"].alias("start"),
                    # an element that ends without its own tag ends with its text
                    S.when(S.lower(name).isin(*VOID_ELEMENTS), f["start"] + S.length(text))
                    .otherwise(f["end"])
                    .alias("end"),
                    text.alias("inside"),
                ),
            ),
        ),
    )


def _slices(doc: Sql, selector: str) -> Sql:
    """Struct(start, end, inside) of every matching element, in order; null without any."""
    opening = _opening(selector)
    names = S.array_distinct(
        S.transform(S.regexp_extract_all(doc, opening, 1), lambda n: S.lower(n))
    )
    return let(
        names,
        lambda found: S.when(
            S.size(found) > 0,
            S.array_sort(S.flatten(S.transform(found, lambda n: _elements(doc, opening, n)))),
        ),
    )


def _outermost(slices: Sql) -> Sql:
    """Slices that lie in no earlier one."""
    walked = S.aggregate(
        slices,
        S.struct(S.lit(0).alias("end"), S.array().cast("array<string>").alias("kept")),
        lambda acc, s: S.when(s["start"] < acc["end"], acc).otherwise(
            S.struct(
                s["end"].alias("end"), S.concat(acc["kept"], S.array(s["inside"])).alias("kept")
            )
        ),
    )
    return walked["kept"]


def _selected(doc: Sql, selector: str) -> Sql:
    """Markup of all matches of a selector (``x`` or ``x p``); null without any."""
    if selector.endswith(" p"):
        outer = _slices(doc, selector[: -len(" p")])
        inner = let(
            outer,
            lambda o: S.when(
                o.isNotNull(), S.flatten(S.transform(_outermost(o), _paragraph_markup))
            ),
        )
        return let(inner, lambda t: S.when(S.size(t) > 0, t))
    return S.transform(_slices(doc, selector), lambda s: s["inside"])


@expression
def element_text(html: Sql, selector: str) -> Sql:
    """Untrimmed text of the first match; null when nothing matches.

    Selectors: a tag name, ``.class``, ``#id`` or ``[attribute=value]``.
    """
    return let(parse(html), lambda doc: _plain(S.get(_selected(doc, selector), 0)))


@expression
def strip_tags(html: Sql) -> Sql:
    """All text of a document or fragment, trimmed; script text included."""
    return trim_space(_plain(parse(html)))


# -- article text ----------------------------------------------------------


@expression
def news_of(doc: Sql) -> Sql:
    def matches(selector: str) -> Sql:
        # a plain search for the word spares most pages the real one
        word = selector.split(" ")[0].strip(".#")
        found = _selected(doc, selector)
        return S.when(doc.contains(word), found) if selector[0] in ".#" else found

    def shown(markup: Sql, is_article: Sql) -> Sql:
        texts = S.transform(markup, _plain)
        lines = S.transform(texts, lambda t: S.concat(t, S.when(is_article, "").otherwise("\n")))
        return let(
            S.array_join(lines, ""),
            lambda t: S.when(is_article, t).otherwise(trim_space(t)),
        )

    body = S.when(doc.contains("articleBody"), _selected(doc, "[itemprop=articleBody]"))
    after = S.regexp_extract(doc, rf"(?s){_opening('article')}(.*+)", 2)
    article = S.when(
        doc.rlike(_opening("article")),
        S.array(let(after, lambda a: _balanced(a, S.lit("article")))),
    )
    others = S.coalesce(*map(matches, ARTICLE_SELECTORS), S.array().cast("array<string>"))
    return S.coalesce(
        let(
            S.array_join(S.transform(body, _plain), ""), lambda t: S.when(t != "", t)
        ),
        let(
            article,
            lambda a: shown(S.coalesce(a, others), a.isNotNull()),
        ),
    )


@expression
def news(html: Sql) -> Sql:
    """Article text: articleBody, else the first article, else known classes."""
    return let(parse(html), news_of)


# -- links -----------------------------------------------------------------


@expression
def hrefs_of(doc: Sql) -> Sql:
    """Decoded href of every anchor that has one, in order."""
    pattern = rf"(?i)<a{_EDGE}{_named('href')}\s*+=\s*+{_VALUE}{_TAG_END}"
    return S.transform(
        S.regexp_extract_all(doc, pattern, 1),
        lambda v: let(_unquoted(v), lambda u: decode_entities(u, in_attribute=True)),
    )


@expression
def links_of(doc: Sql, base: Sql) -> Sql:
    live = S.filter(hrefs_of(doc), is_live_href)
    return S.filter(
        resolve_all(base, live), lambda u: u.isNotNull() & is_http(u) & ~should_skip(u)
    )


@expression
def links(html: Sql, base: Sql) -> Sql:
    """Absolute links of a page worth following, in order, duplicates kept."""
    return let(parse(html), lambda doc: links_of(doc, base))
