"""The element tree of a page, written back as markup in which every element is opened and closed.

A stack machine walks over the tags of a prepared page in one ``aggregate``.  It knows what the HTML standard says about
end tags that are implied, missing or stray, about tables (rows and bodies that are implied, content
that does not belong in a table and is put before it), about ``select``, and about formatting elements that are nested
wrongly (closed before a block, opened again inside it).  Selecting elements in its result needs no rules.

What is open is a path of names, ``/div/p/``, so that every question about scopes is one pattern on a short string.  Each
piece of output begins with its place, a list of numbers: content that goes before a table gets a place before the table's,
and the pieces are sorted at the end.  Tags are walked in blocks, so that appending output costs a block and not the page.

Where nothing but plain elements is open, text with its phrasing elements is one token, and so is a block, a list item or a paragraph
that holds nothing else; these begin and end in themselves whatever formatting is open, so the walk takes one step for them.
"""

from __future__ import annotations

from .sqltext import S, Sql, let

# Fixed values of the HTML standard: kinds of elements.
VOID = (
    "area|base|basefont|bgsound|br|col|embed|hr|image|img|input|keygen|link|meta|param|source|track|wbr"
)
SPECIAL = (
    "address|applet|area|article|aside|base|basefont|bgsound|blockquote|body|br|button|caption|center|col|colgroup|dd|"
    "details|dir|div|dl|dt|embed|fieldset|figcaption|figure|footer|form|frame|frameset|h1|h2|h3|h4|h5|h6|head|header|"
    "hgroup|hr|html|iframe|img|input|keygen|li|link|listing|main|marquee|menu|meta|nav|noembed|noframes|noscript|object|"
    "ol|p|param|plaintext|pre|script|section|select|source|style|summary|table|tbody|td|template|textarea|tfoot|th|"
    "thead|title|tr|track|ul|wbr|xmp"
)
FORMATTING = "a|b|big|code|em|font|i|nobr|s|small|strike|strong|tt|u"
CLOSES_P = (
    "address|article|aside|blockquote|center|details|dialog|dir|div|dl|fieldset|figcaption|figure|footer|header|hgroup|"
    "main|menu|nav|ol|p|section|summary|ul|pre|listing|form|plaintext|xmp|hr"
)
ENDS_IN_SCOPE = (
    "address|article|aside|blockquote|button|center|details|dialog|dir|div|dl|fieldset|figcaption|figure|footer|header|"
    "hgroup|listing|main|menu|nav|ol|pre|section|summary|ul|form|applet|marquee|object|dd|dt"
)
RAW = "script|style|title|textarea|noscript|iframe|noembed|noframes|xmp"
IN_HEAD = "base|basefont|bgsound|link|meta|title|noscript|noframes|style|script|template|head"
SCOPE = "applet|caption|html|table|td|th|marquee|object|template|foreignobject"
MARKERS = "td|th|caption|applet|marquee|object|template"
TABLE_PARTS = "caption|colgroup|col|tbody|thead|tfoot|tr|td|th"
LEAVES_FOREIGN = (
    "b|big|blockquote|body|br|center|code|dd|div|dl|dt|em|embed|h1|h2|h3|h4|h5|h6|head|hr|i|img|li|listing|menu|meta|"
    "nobr|ol|p|pre|ruby|s|small|span|strong|strike|sub|sup|table|tt|u|ul|var"
)

# Elements that can be one token with what is in them: in a text, around a text, with masked text.
IN_TEXT = (
    "a|abbr|acronym|b|bdi|bdo|big|cite|code|data|del|dfn|em|font|i|ins|kbd|label|mark|output|q|s|samp|small|span|strike|"
    "strong|sub|sup|time|tt|u|var"
)
IN_TEXT_VOID = "br|img|input|wbr"
AROUND_TEXT = (
    "p|li|dd|dt|h[1-6]|address|article|aside|blockquote|center|details|dialog|div|fieldset|figcaption|figure|footer|header|"
    "hgroup|main|nav|pre|section|summary"
)
MASKED = "script|style|title"
#: Elements in which tokens mean other things, so that none is put together in them and next to them.
ELSEWHERE = (
    "table|caption|colgroup|col|tbody|thead|tfoot|tr|td|th|select|svg|math|foreignobject|template|applet|marquee|object"
)

#: Tokens walked before their output is put away, and parts of a token that is put together, at most.
BLOCK, PARTS = 64, 30

_ENTRY = "struct<at:string,pre:string,tag:string,f:int>"
_FORMAT = "struct<f:int,name:string,tag:string>"
#: Digits of a number in a place; what ends a place in a piece sorts before them.
_DIGITS, _END = 9, "!"


def _scoped(path: Sql, names: str, stops: str = SCOPE) -> Sql:
    """Whether one of the names is open with none of the stops inside it."""
    return path.rlike(rf"/(?:{names})/(?:(?!(?:{stops})/)[^/]+/)*$")


def _before(path: Sql, names: str) -> Sql:
    """The path up to the innermost of the names, which goes with all in it."""
    return S.regexp_extract(path, rf"^(.*/)(?:{names})/", 1)


def _without_p(path: Sql) -> Sql:
    return S.when(_scoped(path, "p", SCOPE + "|button"), _before(path, "p")).otherwise(path)


def _without_item(path: Sql, names: str) -> Sql:
    """The path in which a list item of the names begins."""
    stops = "|".join(x for x in SPECIAL.split("|") if x not in ("address", "div", "p"))
    open_one = path.rlike(rf"/(?:{names})/(?:(?!(?:{stops})/)[^/]+/)*$")
    return let(S.when(open_one, _before(path, names)).otherwise(path), _without_p)


def _without_heading(path: Sql) -> Sql:
    return let(_without_p(path), lambda p: S.regexp_replace(p, "/h[1-6]/$", "/"))


def _depth(path: Sql) -> Sql:
    return S.length(path) - S.length(S.replace(path, "/", "")) - 1


def _top(path: Sql) -> Sql:
    return S.regexp_extract(path, "([^/]*)/$", 1)


def _is(word: Sql, names: str) -> Sql:
    return word.rlike(f"^(?:{names})$")


def _plan(path: Sql, word: Sql, text: Sql, quirks: Sql, formats: Sql) -> Sql:
    """What a token does: the path it leaves open, names it opens on the way, whether formatting is opened again, and how
    it is written itself: ``+`` opened, ``.`` written, ``-`` left out, ``a`` a formatting element ends here."""

    def plan(kept: object, how: str | Sql, put: object = "", again: object = False) -> Sql:
        return S.struct(
            S.lit(kept).alias("kept") if isinstance(kept, str) else kept.alias("kept"),
            (S.lit(put) if isinstance(put, str) else put).alias("put"),
            (S.lit(again) if isinstance(again, bool) else again).alias("again"),
            (S.lit(how) if isinstance(how, str) else how).alias("how"),
        )

    drop = plan(path, "-")

    def with_table(body) -> Sql:
        """``body(base, rest)``: the path with the innermost table, and what is open in it."""
        base = S.regexp_extract(path, "^(.*/table/)", 1)
        return let(base, lambda b: body(b, S.substr(path, S.length(b) + 1)))

    def group(rest: Sql) -> Sql:
        return S.regexp_extract(rest, "^((?:tbody|thead|tfoot)/)", 1)

    def row(rest: Sql) -> Sql:
        return S.regexp_extract(rest, "^((?:tbody|thead|tfoot)/tr/)", 1)

    def part(base: Sql, rest: Sql) -> Sql:
        """A start tag that belongs in a table."""
        return (
            S.when(word == "tr", plan(S.concat(base, group(rest)), "+", S.when(group(rest) == "", "tbody/").otherwise("")))
            .when(
                word.isin("td", "th"),
                plan(
                    S.concat(base, S.when(row(rest) != "", row(rest)).otherwise(group(rest))),
                    "+",
                    S.when(row(rest) != "", "").when(group(rest) != "", "tr/").otherwise("tbody/tr/"),
                ),
            )
            .when(
                word == "col",
                plan(
                    S.concat(base, S.when(rest.startswith("colgroup/"), "colgroup/").otherwise("")),
                    ".",
                    S.when(rest.startswith("colgroup/"), "").otherwise("colgroup/"),
                ),
            )
            .otherwise(plan(base, "+"))
        )

    def part_end(base: Sql, rest: Sql) -> Sql:
        kept = (
            S.when(word.isin("/td", "/th"), S.when(rest.startswith(S.concat(row(rest), S.substr(word, 2), "/")) & (row(rest) != ""), S.concat(base, row(rest))))
            .when(word == "/tr", S.when(row(rest) != "", S.concat(base, group(rest))))
            .otherwise(S.when(rest.startswith(S.concat(S.substr(word, 2), "/")), base))
        )
        return let(kept, lambda k: S.when(k.isNotNull(), plan(k, "-")).otherwise(drop))

    def in_select() -> Sql:
        out = _before(path, "select")
        no_option = S.regexp_replace(path, "/option/$", "/")
        return (
            S.when(word == "", plan(path, "."))
            .when(word == "option", plan(no_option, "+"))
            .when(word == "optgroup", plan(S.regexp_replace(no_option, "/optgroup/$", "/"), "+"))
            .when(word == "/option", S.when(_top(path) == "option", plan(no_option, "-")).otherwise(drop))
            .when(
                word == "/optgroup",
                S.when(path.rlike("/optgroup/(?:option/)?$"), plan(_before(path, "optgroup"), "-")).otherwise(drop),
            )
            .when(word.isin("/select", "select"), plan(out, "-"))
            .when(word.isin("input", "keygen"), plan(out, ".", again=True))
            .when(word == "textarea", plan(out, "+", again=True))
            .when(_is(word, "script|template"), plan(path, "+"))
            .when(_is(word, "/script|/template") & path.endswith(S.concat(word, "/")), plan(_before(path, "script|template"), "-"))
            .otherwise(drop)
        )

    def in_foreign() -> Sql:
        out = _before(path, "svg|math")
        own = S.concat("^(.*/)\\Q", S.substr(word, 2), "\\E/")
        return (
            S.when(word == "", plan(path, "."))
            .when(_is(word, LEAVES_FOREIGN), plan(out, "+"))
            .when(
                word.startswith("/"),
                let(S.regexp_extract(path, own, 1), lambda k: S.when(k != "", plan(k, "-")).otherwise(drop)),
            )
            .otherwise(plan(path, S.when(text.endswith("/>"), ".").otherwise("+")))
        )

    def item(names: str) -> Sql:
        return plan(_without_item(path, names), "+")

    def start() -> Sql:
        return (
            S.when(_is(word, CLOSES_P + "|table"), let(
                S.when((word == "table") & quirks, path).otherwise(_without_p(path)),
                lambda p: S.when((word == "form") & path.contains("/form/"), drop).otherwise(plan(p, S.when(word == "hr", ".").otherwise("+"))),
            ))
            .when(_is(word, FORMATTING), plan(path, "+", again=True))
            .when(word == "li", item("li"))
            .when(_is(word, "dd|dt"), item("dd|dt"))
            .when(_is(word, "h[1-6]"), plan(_without_heading(path), "+"))
            .when(_is(word, "html|head|body"), S.when((path == "/") | (path == "/html/") | path.endswith("/head/") & (word == "body"), plan(S.regexp_replace(path, "/head/$", "/"), "+")).otherwise(drop))
            .when(_is(word, "area|br|embed|image|img|input|keygen|wbr"), plan(path, ".", again=True))
            .when(_is(word, VOID), plan(path, "."))
            .when(_is(word, RAW + "|template"), plan(path, "+"))
            .when(_is(word, "option|optgroup"), plan(S.regexp_replace(path, "/option/$", "/"), "+", again=True))
            .when(
                _is(word, "rb|rt|rtc|rp") & _scoped(path, "ruby"),
                plan(S.regexp_replace(path, S.when(_is(word, "rb|rtc"), "/(?:rb|rt|rtc|rp)/$").otherwise("/(?:rb|rt|rp)/$"), "/"), "+"),
            )
            .when(_is(word, TABLE_PARTS + "|frame|frameset"), drop)
            .otherwise(plan(path, "+", again=True))
        )

    def end() -> Sql:
        own = S.substr(word, 2)
        named = S.concat("/\\Q", own, "\\E/")
        scoped = S.concat(named, rf"(?:(?!(?:{SCOPE})/)[^/]+/)*$")
        plain = S.concat(named, rf"(?:(?!(?:{SPECIAL})/)[^/]+/)*$")
        kept = S.regexp_extract(path, S.concat("^(.*/)\\Q", own, "\\E/"), 1)
        return (
            S.when(word == "/p", S.when(_scoped(path, "p", SCOPE + "|button"), plan(_before(path, "p"), "-")).otherwise(plan(path, ".")))
            .when(_is(own, ENDS_IN_SCOPE), S.when(path.rlike(scoped), plan(kept, "-")).otherwise(drop))
            .when(word == "/li", S.when(_scoped(path, "li", SCOPE + "|ol|ul"), plan(kept, "-")).otherwise(drop))
            .when(_is(own, "h[1-6]"), S.when(_scoped(path, "h[1-6]"), plan(_before(path, "h[1-6]"), "-")).otherwise(drop))
            .when(word == "/br", plan(path, ".", again=True))
            .when(_is(own, "html|body|col|" + VOID), drop)
            .when(_is(own, FORMATTING), plan(path, "a"))
            .otherwise(S.when(path.rlike(plain), plan(kept, "-")).otherwise(drop))
        )

    context = S.regexp_extract(
        path, "^.*/(table|tbody|thead|tfoot|tr|td|th|caption|colgroup|select|svg|math|foreignobject|template)/", 1
    )
    has_table = path.rlike("/table/(?:(?!template/)[^/]+/)*$")
    in_table = lambda c: c.isin("table", "tbody", "thead", "tfoot", "tr", "colgroup")
    # what asks for an end first: a second link or row of breaks, a table in a table, a button in a button
    asked = word.startswith("!")
    return let(
        context,
        lambda c: S.when(word == "/", plan("/", "-"))
        .when(
            asked,
            S.when(word == "!table", S.when(in_table(c), plan(_before(path, "table"), "-")).otherwise(drop))
            .when(word == "!button", S.when(_scoped(path, "button"), plan(_before(path, "button"), "-")).otherwise(drop))
            .when(
                ~c.isin("select", "svg", "math") & S.exists(_since_marker(formats), lambda f: S.concat("!", f["name"]) == word),
                plan(path, "a"),
            )
            .otherwise(drop),
        )
        .when(_is(_top(path), RAW), S.when(word == S.concat("/", _top(path)), plan(_before(path, RAW), "-")).when(word == "", plan(path, ".")).otherwise(drop))
        .when((c == "select") & ~(_is(word, "/?(?:table|" + TABLE_PARTS + ")") & has_table), in_select())
        .when(c.isin("svg", "math"), in_foreign())
        .when(_is(word, TABLE_PARTS) & has_table, with_table(part))
        .when(_is(word, "/(?:" + TABLE_PARTS + ")"), S.when(has_table, with_table(part_end)).otherwise(drop))
        .when(word == "/table", S.when(has_table, plan(_before(path, "table"), "-")).otherwise(drop))
        .when(
            (word == ""),
            S.when((c == "colgroup") & text.rlike(r"\S"), plan(_before(path, "colgroup"), ".", again=True))
            .when(_is(_top(path), "html|head") & ~text.rlike(r"\S"), plan(path, "."))
            .otherwise(plan(path, ".", again=~(in_table(c) & ~text.rlike(r"\S")))),
        )
        .when(word.startswith("/"), end())
        .otherwise(start()),
    )


def _number(n: Sql) -> Sql:
    return S.lpad(n.cast("string"), _DIGITS, "0")


def _above(at: Sql) -> Sql:
    """A place without its last number."""
    return S.substr(at, 1, S.length(at) - _DIGITS)


def _fostered(at: Sql) -> Sql:
    """The beginning of all places right before a place."""
    return S.concat(_above(at), _number(S.right(at, _DIGITS).cast("int") - 1))


def _piece(at: Sql, text: Sql) -> Sql:
    return S.concat(at, _END, text)


def _end_tag(start: Sql) -> Sql:
    return S.concat("</", S.regexp_extract(start, r"^<([^\s/>]+)", 1), ">")


def _missing(formats: Sql, held: Sql) -> Sql:
    """Formatting elements that are to be opened again: those behind the last one that is open."""
    ids = S.transform(held, lambda e: e["f"])
    last = S.coalesce(
        S.array_max(S.transform(formats, lambda f, j: S.when((f["f"] == 0) | S.array_contains(ids, f["f"]), j + 1).otherwise(0))), 0
    )
    return S.slice(formats, last + 1, S.size(formats))


def _step(acc: Sql, token: Sql, quirks: Sql, start_tag: str) -> Sql:
    path, stack, i = acc["path"], acc["stack"], acc["i"]
    word, text = token["w"], token["t"]

    def closers(popped: Sql, depth: Sql) -> Sql:
        """End tags of the elements above a depth, each where its element is, the innermost first."""
        return S.transform(
            popped,
            lambda e, j: _piece(
                S.concat(_above(e["at"]), _number(i * 2 - 1), "-", _number(S.lit(10**8) - depth - j)),
                _end_tag(e["tag"]),
            ),
        )

    def formats_for(kept: Sql, formats: Sql) -> Sql:
        """Without those of cells and the like that are closed."""
        markers = S.size(S.filter(formats, lambda f: f["f"] == 0))
        wanted = S.regexp_count(kept, f"(?<=/)(?:{MARKERS})(?=/)")
        cut = lambda n: S.aggregate(
            formats,
            S.struct(S.lit(0).alias("m"), S.array().cast(f"array<{_FORMAT}>").alias("held")),
            lambda a, f: let(
                a["m"] + S.when(f["f"] == 0, 1).otherwise(0),
                lambda m: S.struct(m.alias("m"), S.when(m > n, a["held"]).otherwise(S.concat(a["held"], S.array(f))).alias("held")),
            ),
        )["held"]
        return S.when(S.size(formats) == 0, formats).otherwise(let(wanted, lambda n: S.when(markers <= n, formats).otherwise(cut(n))))

    def state(path: Sql, stack: Sql, formats: Sql, out: Sql) -> Sql:
        return S.struct(
            path.alias("path"), stack.alias("stack"), formats.alias("formats"), (i + 1).alias("i"), out.alias("out")
        )  # out: only of this token

    def write(plan: Sql) -> Sql:
        """Closes, opens what is implied or formatting again, writes the token and opens it."""
        kept = plan["kept"]
        depth = _depth(kept)

        def written(d: Sql, formats: Sql) -> Sql:
            held, popped = S.slice(stack, 1, d), S.slice(stack, d + 1, S.size(stack))
            ended = closers(popped, d)
            return S.when(
                plan["how"] == "-", state(kept, held, formats, ended)
            ).otherwise(opened(held, formats, ended))

        def opened(held: Sql, formats: Sql, out: Sql) -> Sql:
            stays = (
                _is(word, "/?(?:script|style|template|table|" + TABLE_PARTS + ")")
                | ((word == "") & ~text.rlike(r"\S"))
                | ((word == "input") & text.rlike(r"""(?i)\btype\s*=\s*["']?hidden\b"""))
            )
            moved = _is(_top(kept), "table|tbody|thead|tfoot|tr") & ~stays
            table = S.get(held, _depth(S.regexp_extract(kept, "^(.*/table/)", 1)) - 1)
            below = S.coalesce(S.try_element_at(held, -1)["pre"], "")
            pre = S.when(moved, _fostered(table["at"])).otherwise(below)
            missing = S.when(plan["again"] & (S.size(formats) > 0), _missing(formats, held)).otherwise(
                S.array().cast(f"array<{_FORMAT}>")
            )
            return let(S.struct(pre.alias("pre"), missing.alias("missing")), lambda x: finish(held, formats, out, x["pre"], x["missing"]))

        def finish(held: Sql, formats: Sql, out: Sql, pre: Sql, missing: Sql) -> Sql:
            at = S.concat(pre, _number(i * 2))
            entry = lambda tag, f: S.struct(at.alias("at"), pre.alias("pre"), tag.alias("tag"), f.alias("f"))
            implied = S.filter(S.split(plan["put"], "/"), lambda n: n != "")
            marks = _is(word, MARKERS) & (plan["how"] == "+")
            formatting = _is(word, FORMATTING) & (plan["how"] == "+")
            own = S.when(word == "/p", "<p></p>").when(word == "/br", "<br>").otherwise(text)
            piece = _piece(
                at,
                S.concat(
                    S.array_join(S.transform(implied, lambda n: S.concat("<", n, ">")), ""),
                    S.array_join(S.transform(missing, lambda f: f["tag"]), ""),
                    own,
                ),
            )
            is_open = plan["how"] == "+"
            names = S.concat(
                plan["put"], S.array_join(S.transform(missing, lambda f: S.concat(f["name"], "/")), ""), S.when(is_open, S.concat(word, "/")).otherwise("")
            )
            return state(
                S.concat(kept, names),
                S.concat(
                    held,
                    S.transform(implied, lambda n: entry(S.concat("<", n, ">"), S.lit(0))),
                    S.transform(missing, lambda f: entry(f["tag"], f["f"])),
                    S.when(is_open, S.array(entry(text, S.when(formatting, i).otherwise(0)))).otherwise(S.array().cast(f"array<{_ENTRY}>")),
                ),
                S.when(marks | formatting, S.concat(formats, S.array(S.struct(S.when(marks, 0).otherwise(i).alias("f"), word.alias("name"), text.alias("tag"))))).otherwise(formats),
                S.concat(out, S.array(piece)),
            )

        return let(
            S.struct(depth.alias("d"), formats_for(kept, acc["formats"]).alias("formats")),
            lambda x: written(x["d"], x["formats"]),
        )

    def adopt() -> Sql:
        """A formatting element ends.  Blocks open in it stay open: it is closed before each and opened again in it, up to here."""
        own = S.substr(word, 2)
        active = S.filter(_since_marker(acc["formats"]), lambda f: f["name"] == own)
        target = S.try_element_at(active, -1)["f"]
        # place in the stack, from 1; 0: not open
        place = S.array_position(S.transform(stack, lambda e: e["f"]), S.coalesce(target, S.lit(-1)))

        def ended(f: Sql, n: Sql) -> Sql:
            forgotten = S.filter(acc["formats"], lambda x: x["f"] != f)
            names = S.filter(S.split(path, "/"), lambda x: x != "")
            return let(
                S.struct(forgotten.alias("formats"), names.alias("names"), S.lit(n).alias("n") if isinstance(n, int) else n.alias("n")),
                lambda x: moved(f, x["formats"], x["names"], x["n"]),
            )

        def moved(f: Sql, formats: Sql, names: Sql, n: Sql) -> Sql:
            inside = S.slice(names, n + 1, S.size(names))
            blocks = S.transform(inside, lambda x: _is(x, SPECIAL))
            # depth below which nothing but phrasing is open
            last = n + S.coalesce(S.array_max(S.transform(blocks, lambda b, j: S.when(b, j + 1).otherwise(0))), 0)
            first = S.array_position(blocks, S.lit(True))
            entry = S.element_at(stack, n)
            end = S.concat("</", own, ">")

            def cut(last: Sql, first: Sql) -> Sql:
                between = S.slice(stack, n + 1, first - 1)  # phrasing between it and its first block
                shut = S.concat(
                    S.array_join(S.reverse(S.transform(between, lambda e: S.concat("</", S.regexp_extract(e["tag"], r"^<([^\s/>]+)", 1), ">"))), ""),
                    end,
                    S.array_join(S.transform(between, lambda e: e["tag"]), ""),
                )
                held = S.filter(S.slice(S.transform(stack, lambda e, j: S.struct(e.alias("e"), (j + 1).alias("j"), S.get(names, j).alias("name"))), n + 1, last - n), lambda x: _is(x["name"], SPECIAL))
                before = S.transform(
                    held,
                    lambda x, j: _piece(S.concat(_fostered(x["e"]["at"]), _number(i * 2 + 1)), S.when(j == 0, shut).otherwise(end)),
                )
                after = S.transform(held, lambda x: _piece(S.concat(x["e"]["at"], _number(S.lit(10**_DIGITS - 1) - i)), entry["tag"]))
                popped = S.slice(stack, last + 1, S.size(stack))
                deepest = S.element_at(stack, last)
                shut_now = S.array(_piece(S.concat(deepest["pre"], _number(i * 2)), end))
                rest = S.concat(S.slice(stack, 1, n - 1), S.slice(stack, n + 1, last - n))
                kept_names = S.concat(S.slice(names, 1, n - 1), S.slice(names, n + 1, last - n))
                return state(
                    S.concat("/", S.array_join(S.transform(kept_names, lambda x: S.concat(x, "/")), "")),
                    rest,
                    formats,
                    S.concat(before, after, closers(popped, last), shut_now),
                )

            simple = state(
                S.concat("/", S.array_join(S.transform(S.slice(names, 1, n - 1), lambda x: S.concat(x, "/")), "")),
                S.slice(stack, 1, n - 1),
                formats,
                closers(S.slice(stack, n, S.size(stack)), n - 1),
            )
            return S.when(first == 0, simple).otherwise(
                let(S.struct(last.alias("last"), first.cast("int").alias("first")), lambda x: cut(x["last"], x["first"]))
            )

        none = S.array().cast("array<string>")
        unchanged = state(path, stack, acc["formats"], none)
        forget = lambda f: state(path, stack, S.filter(acc["formats"], lambda x: x["f"] != f), none)
        scoped = lambda n: ~S.exists(
            S.slice(S.filter(S.split(path, "/"), lambda x: x != ""), n + 1, S.size(stack)), lambda x: _is(x, SCOPE)
        )
        return let(
            S.struct(target.alias("f"), place.cast("int").alias("n")),
            lambda x: S.when(x["f"].isNull(), unchanged)
            .when(x["n"] == 0, forget(x["f"]))
            .when(~scoped(x["n"]), unchanged)
            .otherwise(ended(x["f"], x["n"])),
        )

    def act(plan: Sql) -> Sql:
        return S.when(plan["how"] == "a", adopt()).otherwise(write(plan))

    def planned() -> Sql:
        # what does not belong in a head ends it
        ends_head = (_top(path) == "head") & S.when(word == "", text.rlike(r"\S")).otherwise(
            word.rlike("^[a-z]") & ~_is(word, IN_HEAD + "|html|body")
        )
        open_now = S.when(ends_head, _before(path, "head")).otherwise(path)
        return let(open_now, lambda p: let(_plan(p, word, text, quirks, acc["formats"]), act))

    def whole() -> Sql:
        """An element around nothing but text: formatting is opened again at the beginning of what is in it, and closed in it."""
        name, formats = S.substr(word, 2), acc["formats"]
        masked = name.isin(*MASKED.split("|"))
        open_now = S.when(path.endswith("/head/") & ~masked, _before(path, "head")).otherwise(path)
        kept = let(
            open_now,
            lambda p: S.when(masked, p)
            .when(name == "li", _without_item(p, "li"))
            .when(name.isin("dd", "dt"), _without_item(p, "dd|dt"))
            .when(name.rlike("^h[1-6]$"), _without_heading(p))
            .otherwise(_without_p(p)),
        )

        def opened_again(missing: Sql, start: Sql) -> Sql:
            inside = S.length(text) - S.length(start) - S.length(name) - 3
            ends = S.reverse(S.transform(missing, lambda f: _end_tag(f["tag"])))
            return S.when((inside == 0) | (S.size(missing) == 0), text).otherwise(
                S.concat(
                    start,
                    S.array_join(S.transform(missing, lambda f: f["tag"]), ""),
                    S.substr(text, S.length(start) + 1, inside),
                    S.array_join(ends, ""),
                    S.right(text, S.length(name) + 3),
                )
            )

        def placed(kept: Sql, held: Sql, ended: Sql) -> Sql:
            shown = S.when(masked | (S.size(formats) == 0), text).otherwise(
                let(
                    S.struct(_missing(formats, held).alias("missing"), S.regexp_extract(text, start_tag, 0).alias("start")),
                    lambda x: opened_again(x["missing"], x["start"]),
                )
            )
            at = S.concat(S.coalesce(S.try_element_at(held, -1)["pre"], ""), _number(i * 2))
            return state(kept, held, formats, S.concat(ended, S.array(_piece(at, shown))))

        def closing(kept: Sql, depth: Sql) -> Sql:
            return placed(kept, S.slice(stack, 1, depth), closers(S.slice(stack, depth + 1, S.size(stack)), depth))

        none = S.array().cast("array<string>")
        return let(kept, lambda k: S.when(k == path, placed(k, stack, none)).otherwise(let(_depth(k), lambda d: closing(k, d))))

    # most tokens: text where text belongs with nothing to open again, and the end of what was opened last
    top, formats = S.try_element_at(stack, -1), acc["formats"]
    newest = S.try_element_at(formats, -1)
    settled = (S.size(formats) == 0) | (newest["f"] == 0) | S.exists(stack, lambda e: e["f"] == newest["f"])
    plain_text = (word == "") & ~path.rlike("/(?:table|tbody|thead|tfoot|tr|colgroup|head|html)/$") & settled
    ends_top = word.startswith("/") & path.endswith(S.concat(word, "/")) & (word != "/")
    closed = lambda formats: state(
        S.substr(path, 1, S.length(path) - S.length(word)), S.slice(stack, 1, S.size(stack) - 1), formats,
        closers(S.slice(stack, S.size(stack), 1), S.size(stack) - 1),
    )
    return (
        S.when(plain_text, state(path, stack, formats, S.array(_piece(S.concat(S.coalesce(top["pre"], ""), _number(i * 2)), text))))
        .when(word.startswith("="), whole())
        .when(ends_top & ~_is(word, f"/(?:html|body|{FORMATTING}|{MARKERS})"), closed(formats))
        .when(ends_top & _is(word, f"/(?:{FORMATTING})") & (newest["f"] == top["f"]), closed(S.slice(formats, 1, S.size(formats) - 1)))
        .otherwise(planned())
    )


def _since_marker(formats: Sql) -> Sql:
    """Formatting elements that belong to the innermost cell or the like."""
    last = S.coalesce(S.array_max(S.transform(formats, lambda f, j: S.when(f["f"] == 0, j + 1).otherwise(0))), 0)
    return S.when(S.size(formats) == 0, formats).otherwise(let(last, lambda n: S.slice(formats, n + 1, S.size(formats))))


def _together(tag_end: str) -> str:
    """Pattern of tokens that are put together: elements around a text, and texts that hold elements."""
    end = rf"(?=[\s/>]){tag_end}"

    def item(name: str) -> str:
        """Elements in a text, one within another at most; ``name`` is for the groups of the pattern."""
        void = rf"<(?i:{IN_TEXT_VOID}){end}"
        inner = rf"<(?<{name}i>(?i:{IN_TEXT})){end}(?:[^<]++|{void}){{0,{PARTS}}}+</\k<{name}i>>"
        return rf"{void}|<(?<{name}o>(?i:{IN_TEXT})){end}(?:[^<]++|{void}|{inner}){{0,{PARTS}}}+</\k<{name}o>>"

    around = rf"<(?<around>(?i:{AROUND_TEXT})){end}(?:[^<]++|{item('a')}){{0,{PARTS}}}+</\k<around>>"
    masked = rf"<(?<masked>(?i:{MASKED})){end}[^<]*+</\k<masked>>"
    # a blank text before a head's end belongs in the head
    text = rf"(?:\s*+[^\s<][^<]*+)?+(?:{item('f')})(?:[^<]++|{item('r')}){{0,{PARTS}}}+"
    return rf"{around}|{masked}|{text}"


def build(doc: Sql, quirks: Sql, tag: str, tag_end: str) -> Sql:
    """The tree of a prepared page as markup; ``tag`` is the pattern of a tag, ``tag_end`` of a start tag behind its name.

    ``quirks``: whether the page has no document type, where a table does not end a paragraph.
    """
    start_tag = rf"^<[a-zA-Z][^\s/>]*+{tag_end}"

    def token(t: Sql) -> Sql:
        """``=p``: a whole paragraph, and so on; a text with elements has no word, like other texts."""
        name = S.lower(S.regexp_extract(t, r"^<(/?[a-zA-Z][^\s/>]*)", 1))
        several = t.rlike("^<[a-zA-Z]") & (S.length(S.regexp_extract(t, start_tag, 0)) < S.length(t))
        in_text = name.isin(*IN_TEXT.split("|"), *IN_TEXT_VOID.split("|"))
        word = S.when(~t.startswith("<"), "").when(several, S.when(in_text, "").otherwise(S.concat("=", name))).otherwise(name)
        return let(
            word,
            lambda w: S.when(
                w.isin("a", "nobr", "button", "table"),
                S.array(S.struct(S.lit("").alias("t"), S.concat("!", w).alias("w")), S.struct(t.alias("t"), w.alias("w"))),
            ).otherwise(S.array(S.struct(t.alias("t"), w.alias("w")))),
        )

    none = S.array().cast("array<string>")
    carried = ("path", "stack", "formats", "i")

    def state(now: Sql, out: Sql) -> Sql:
        return S.struct(now.alias("now"), out.alias("out"))

    def walked(parts: Sql, now: Sql, one_part) -> Sql:
        """``one_part`` over all parts; the result's ``out`` has the output of all.

        An aggregate copies what it holds at each step, lambdas what they return.  So a part's output is put away by the next
        step, and parts are nested: tokens in blocks, blocks in chapters, chapters in the page.
        """
        fresh = S.struct(*(now[n].alias(n) for n in carried), none.alias("out"))
        return S.aggregate(
            parts,
            state(fresh, none),
            lambda acc, part: state(one_part(acc["now"], part), S.concat(acc["out"], acc["now"]["out"])),
            lambda acc: S.struct(
                *(acc["now"][n].alias(n) for n in carried), S.concat(acc["out"], acc["now"]["out"]).alias("out")
            ),
        )

    other_tag, other = rf"(?!</?[aA][\s/>]){tag}", r"<(?!/?[aA][\s/>])"
    link_in_link = rf"(?i:<a)(?=[\s/>]){tag_end}(?:[^<]++|{other_tag}|{other})*+<[aA][\s/>]"

    def plain(now: Sql, part: Sql) -> Sql:
        """Whether tokens of a block mean the same put together."""
        return ~(
            now["path"].rlike(rf"/(?:{ELSEWHERE})/")
            | S.exists(now["formats"], lambda f: (f["f"] == 0) | (f["name"] == "a"))
            | part.rlike(rf"(?i)<(?:{ELSEWHERE})[\s/>]")
            | part.rlike(link_in_link)
        )

    def block(now: Sql, part: Sql) -> Sql:
        return walked(tokens(part, plain(now, part)), now, lambda n, t: _step(n, t, quirks, start_tag))

    def chapter(now: Sql, blocks: Sql) -> Sql:
        return walked(blocks, now, block)

    def joined(pieces: Sql) -> Sql:
        return S.array_join(S.transform(S.sort_array(pieces), lambda p: S.substr(p, S.instr(p, _END) + 1)), "")

    one = rf"{tag}|[^<]++|<"
    together = rf"{_together(tag_end)}|{one}"
    last = S.array(S.struct(S.lit("").alias("t"), S.lit("/").alias("w")))

    def tokens(part: Sql, is_plain: Sql) -> Sql:
        """The tokens of a block of markup; of the empty one at the end, the one that closes everything."""
        found = S.when(is_plain, S.regexp_extract_all(part, together, 0)).otherwise(S.regexp_extract_all(part, one, 0))
        return S.when(part == "", last).otherwise(S.flatten(S.transform(found, token)))

    blocks = S.concat(S.regexp_extract_all(doc, rf"(?:{together}){{1,{BLOCK}}}+", 0), S.array(""))
    start = S.struct(
        S.lit("/").alias("path"),
        S.array().cast(f"array<{_ENTRY}>").alias("stack"),
        S.array().cast(f"array<{_FORMAT}>").alias("formats"),
        S.lit(1).alias("i"),
        none.alias("out"),
    )
    def chapters(blocks: Sql) -> Sql:
        return S.transform(S.sequence(0, S.size(blocks) - 1, BLOCK), lambda b: S.slice(blocks, b + 1, BLOCK))

    return joined(walked(let(blocks, chapters), start, chapter)["out"])
