"""Character references (``&amp;``, ``&#233;``) in text and attribute values."""

from __future__ import annotations

from html.entities import html5

from .sqltext import S, Sql, let

# Names come from Python's own table of the HTML standard.  Those met most
# often go first, since a map literal is searched from the front.
_FREQUENT = ("amp;", "nbsp;", "quot;", "lt;", "gt;", "apos;", "copy;", "middot;", "amp")
# Text with no other names is decoded by plain replacement, ampersands last.
_SIMPLE = ("quot;", "nbsp;", "lt;", "gt;", "copy;", "middot;", "amp;")
_NAMES = dict.fromkeys([*_FREQUENT, *html5])

# What numbers 128 to 159 stand for (windows-1252).
_C1_START = 128
_C1_MEANING = (
    "€\u0081‚ƒ„…†‡ˆ‰Š‹Œ\u008dŽ\u008f"
    "\u0090‘’“”•–—˜™š›œ\u009džŸ"
)
_LONGEST_PREFIX = 6


def _table() -> Sql:
    pairs = "\x01".join(f"{n}\x02{html5[n]}" for n in _NAMES)
    return S.str_to_map(pairs, "\x01", "\x02")


def _character(code: Sql) -> Sql:
    """The character of a code point given as a number."""
    replaced = (
        S.when(
            code.between(_C1_START, _C1_START + len(_C1_MEANING) - 1),
            S.substr(_C1_MEANING, (code - (_C1_START - 1)).cast("int"), 1),
        )
        .when(
            (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "\ufffd"
        )
        .otherwise(S.decode(S.unhex(S.lpad(S.hex(code), 8, "0")), "UTF-32"))
    )
    return replaced


def _number(digits: Sql, base: int) -> Sql:
    """Value of a digit string; more than nine significant digits saturate."""
    digits = Sql(f"trim(LEADING '0' FROM {digits})")
    value = S.conv(S.when(digits == "", "0").otherwise(digits), base, 10).cast("bigint")
    return S.when(S.length(digits) > 9, S.lit(0x110000).cast("bigint")).otherwise(value)


def _decode_piece(piece: Sql, table: Sql, in_attribute: bool) -> Sql:
    """Decode the reference at the start of the text after an ampersand."""

    def numeric(token: Sql) -> Sql:
        digits = S.regexp_extract(token, "([0-9A-Fa-f]+);?\\z", 1)
        code = S.when(token.rlike("^#[xX]"), _number(digits, 16)).otherwise(_number(digits, 10))
        return let(code, lambda c: S.concat(_character(c), _after(piece, token)))

    def named(token: Sql) -> Sql:
        whole = S.try_element_at(table, token)
        if in_attribute:
            whole = S.when(
                token.endswith(";") | (S.left(_after(piece, token), 1) != "="), whole
            )
            found = S.concat(whole, _after(piece, token))
        else:
            found = S.coalesce(
                S.concat(whole, _after(piece, token)),
                *(
                    S.when(
                        S.length(token) > n,
                        S.concat(
                            S.try_element_at(table, S.left(token, n)), S.substr(piece, n + 1)
                        ),
                    )
                    for n in range(_LONGEST_PREFIX, 1, -1)
                ),
            )
        return S.coalesce(found, S.concat("&", piece))

    token = S.regexp_extract(piece, "^(#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z0-9]+;?)", 1)
    general = let(
        token,
        lambda t: S.when(t == "", S.concat("&", piece))
        .when(t.startswith("#"), numeric(t))
        .otherwise(named(t)),
    )
    quick = S.when(
        piece.startswith(_SIMPLE[0]), S.concat(html5[_SIMPLE[0]], S.substr(piece, len(_SIMPLE[0]) + 1))
    )
    for name in _SIMPLE[1:]:
        quick = quick.when(
            piece.startswith(name), S.concat(html5[name], S.substr(piece, len(name) + 1))
        )
    return quick.otherwise(general)


def _after(piece: Sql, token: Sql) -> Sql:
    return S.substr(piece, S.length(token) + 1)


def decode_entities(text: Sql, in_attribute: bool = False) -> Sql:
    """Replace every character reference once, from left to right."""

    def decoded(pieces: Sql) -> Sql:
        tail = let(
            _table(),
            lambda table: S.transform(
                S.slice(pieces, 2, S.size(pieces)),
                lambda p: _decode_piece(p, table, in_attribute),
            ),
        )
        return S.concat(S.get(pieces, 0), S.array_join(tail, ""))

    def chosen(t: Sql) -> Sql:
        simple = t
        for name in _SIMPLE:
            simple = S.replace(simple, f"&{name}", html5[name])
        return (
            S.when(~t.contains("&"), t)
            .when(t.rlike(f"&(?!{'|'.join(_SIMPLE)})"), let(S.split(t, "&", -1), decoded))
            .otherwise(simple)
        )

    return let(text, chosen)
