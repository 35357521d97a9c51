"""URL expressions: parse, resolve, canonical key, host and the link filters.

Everything is a ``Sql -> Sql`` function over built-in expressions.  Plain
addresses (the vast majority) take a branch of one or two regular expressions;
only odd ones enter the full rules.
"""

from __future__ import annotations

from .sqltext import S, Sql, expression, let
from .text import percent_decode, percent_key, rest

# Link endings and fragments that are never followed.
SKIPPED_ENDINGS = (
    "pdf", "jpg", "jpeg", "png", "gif", "css", "js", "ico", "svg", "xml", "json",
    "mp3", "mp4", "avi", "mov", "mpg", "mpeg", "zip", "tar", "gz", "rar",
)
SKIPPED_PARTS = (
    "/cdn-cgi/", "/wp-admin/", "/wp-includes/", "javascript:", "mailto:", "tel:",
    "sms:", "/feed/", "/rss/", "/print/", "/search?", "login", "logout", "signin",
    "signup", "register",
)

_HEX = "[0-9A-Fa-f]"
_BAD_ESCAPE = f"%(?!{_HEX}{{2}})"
_CONTROL = r"[\x00-\x1f\x7f]"
_PLAIN_HOST = r"[A-Za-z0-9.\-]++(?::[0-9]*+)?"

# Host: bracketed literal, or name.  Escapes are only allowed for bytes outside
# ASCII.  A port, if any, is numeric or empty.
_HOST_CHAR = rf"[A-Za-z0-9\-_.~!$&'()*+,;=:\[\]<>\"]|[^\x00-\x7f]|%[89A-Fa-f]{_HEX}"
_VALID_HOST = (
    rf"^(?:{_PLAIN_HOST}|\[[A-Za-z0-9\-_.~!$&'()*+,;=:%]*+\](?::[0-9]*+)?"
    rf"|(?!\[)(?:{_HOST_CHAR})*+)\z"
)
_BAD_PORT = r":[0-9]*+[^0-9:\]][^:\]]*+\z"
_VALID_USER = rf"^(?:[A-Za-z0-9\-._:~!$&'()*+,;=@]|%{_HEX}{{2}})*+\z"

# Bytes that may stand unescaped; one other byte re-encodes the whole part.
_PATH_AS_IS = r"^[A-Za-z0-9\-_.~$&+,/:;=@!'()*\[\]%]*+\z"
_FRAGMENT_AS_IS = r"^[A-Za-z0-9\-_.~$&+,/:;=@!'()*\[\]?%]*+\z"
_HOST_AS_IS = r"^[\x00-\x7f]*+\z"
_PATH_KEPT = "$&+,/:;=@~"
_FRAGMENT_KEPT = _PATH_KEPT + "?!()*"
_HOST_KEPT = _PATH_KEPT + "!'()*[]<>\"%"

_PLAIN_URL = (
    rf"^((https?://({_PLAIN_HOST}))((?:/[^%?#\x00-\x1f\x7f\ufffd]*+)?))"
    r"(?:\?[^#\x00-\x1f\x7f]*+)?(?:#[^%]*+)?\z"
)
# A page URL whose parts need no rewriting to be printed.
_PLAIN_PAGE = (
    rf"^((https?)://{_PLAIN_HOST})((?:/[A-Za-z0-9\-_.~$&+,/:;=@!'()*]*+)?)"
    r"((?:\?[^#\x00-\x1f\x7f]*+)?)(?:#([A-Za-z0-9\-_.~]*+))?\z"
)
_DOT_SEGMENT = r"(?:^|/)\.\.?(?:/|\z)"

# A reference that resolves without any rewriting of its own text.
_SAFE = r"A-Za-z0-9\-_~$&+,:;=@!'()*"
_PLAIN_PATH = rf"/(?![/.])(?:[{_SAFE}.]++|%{_HEX}{{2}}|/(?!\.))*+"
_PLAIN_TAIL = rf"(?:\?[^#\x00-\x1f\x7f]*+)?(?:#[{_SAFE}./?]++)?\z"
_PLAIN_ROOTED = rf"^{_PLAIN_PATH}{_PLAIN_TAIL}"
# A rooted path that only needs percent-encoding.
_ODD_BYTES_ROOTED = r"^/(?![/.])(?:[^%?#/\x00-\x1f\x7f]++|/(?!\.))*+\z"
_PLAIN_ABSOLUTE = rf"^https?://{_PLAIN_HOST}(?:{_PLAIN_PATH}|/)?{_PLAIN_TAIL}"


def _encode(text: Sql, kept: str) -> Sql:
    """Percent-encode all bytes but letters, digits, ``-_.`` and ``kept``."""
    out = S.replace(S.url_encode(text), "+", "%20")
    if "*" not in kept:
        out = S.replace(out, "*", "%2A")
    for char in kept:
        out = S.replace(out, f"%{ord(char):02X}", char)
    return out


def _escaped(raw: Sql, as_is: str, kept: str) -> Sql:
    """The part as it is printed: kept when valid, else encoded afresh."""
    return S.when(raw.rlike(as_is), raw).otherwise(_encode(percent_decode(raw), kept))


def _pieces(url: Sql) -> Sql:
    """Struct of the raw parts of any URL or reference; null when unparsable."""

    def with_scheme(a: Sql) -> Sql:
        scheme = S.regexp_extract(a["head"], r"^([A-Za-z][A-Za-z0-9+.\-]*+):", 1)
        return S.struct(
            a["head"].alias("head"),
            a["fragment"].alias("fragment"),
            S.lower(scheme).alias("scheme"),
            S.when(scheme == "", a["head"])
            .otherwise(rest(a["head"], S.length(scheme) + 1))
            .alias("body"),
        )

    def with_query(b: Sql) -> Sql:
        front = S.substring_index(b["body"], "?", 1)
        return S.struct(
            b["head"].alias("head"),
            b["fragment"].alias("fragment"),
            b["scheme"].alias("scheme"),
            b["body"].contains("?").alias("has_query"),
            rest(b["body"], S.length(front) + 1).alias("query"),
            front.alias("front"),
            (
                front.startswith("//") & ((b["scheme"] != "") | ~front.startswith("///"))
            ).alias("has_authority"),
            ((b["scheme"] != "") & ~front.startswith("/")).alias("is_opaque"),
        )

    def with_authority(c: Sql) -> Sql:
        authority = S.when(
            c["has_authority"], S.regexp_extract(c["front"], "^//([^/]*+)", 1)
        ).otherwise("")
        path = (
            S.when(c["is_opaque"], "")
            .when(c["has_authority"], S.regexp_extract(c["front"], r"(?s)^//[^/]*+(.*)\z", 1))
            .otherwise(c["front"])
        )
        return S.struct(
            *(
                c[n].alias(n)
                for n in (
                    "head", "fragment", "scheme", "has_query", "query", "front", "is_opaque",
                )
            ),
            authority.contains("@").alias("has_user"),
            S.regexp_extract(authority, "(?s)^(.*)@", 1).alias("user"),
            S.substring_index(authority, "@", -1).alias("host"),
            path.alias("path"),
        )

    def checked(d: Sql) -> Sql:
        colon_first = (
            (d["scheme"] == "") & ~d["front"].startswith("/") & d["front"].rlike("^[^/]*:")
        )
        bad = (
            d["head"].rlike(_CONTROL)
            | d["head"].startswith(":")
            | colon_first
            | d["path"].rlike(_BAD_ESCAPE)
            | d["fragment"].rlike(_BAD_ESCAPE)
            | ~d["user"].rlike(_VALID_USER)
            | ~d["host"].rlike(_VALID_HOST)
            | d["host"].rlike(_BAD_PORT)
        )
        return S.when(~bad, d)

    head = S.substring_index(url, "#", 1)
    first = S.struct(
        head.alias("head"), rest(url, S.length(head) + 1).alias("fragment")
    )
    return let(
        first,
        lambda a: let(
            with_scheme(a),
            lambda b: let(with_query(b), lambda c: let(with_authority(c), checked)),
        ),
    )


@expression
def url_parts(url: Sql) -> Sql:
    """Struct(scheme, host, path, query, fragment); null when unparsable.

    The scheme is in lower case, the host keeps case and port and has no user
    information, path and fragment are decoded, the query is left as written.  Paths
    are equal when their bytes are, also where these are no UTF-8 (``percent_key``).
    """
    return let(
        _pieces(url),
        lambda p: S.when(
            p.isNotNull(),
            S.struct(
                p["scheme"].alias("scheme"),
                percent_decode(p["host"]).alias("host"),
                percent_key(p["path"]).alias("path"),
                p["query"].alias("query"),
                percent_decode(p["fragment"]).alias("fragment"),
            ),
        ),
    )


@expression
def url_identity(url: Sql) -> Sql:
    """Struct(key, host, origin, path) of an address, all null when unparsable."""
    plain = S.struct(
        S.regexp_extract(url, _PLAIN_URL, 1).alias("key"),
        S.regexp_extract(url, _PLAIN_URL, 3).alias("host"),
        S.regexp_extract(url, _PLAIN_URL, 2).alias("origin"),
        S.regexp_extract(url, _PLAIN_URL, 4).alias("path"),
    )

    def full(p: Sql) -> Sql:
        origin = S.concat(p["scheme"], "://", p["host"])
        return S.struct(
            S.concat(origin, p["path"]).alias("key"),
            p["host"].alias("host"),
            origin.alias("origin"),
            p["path"].alias("path"),
        )

    return S.when(url.rlike(_PLAIN_URL), plain).otherwise(let(url_parts(url), full))


@expression
def canonical_key(url: Sql) -> Sql:
    """``scheme://host`` plus the decoded path: the identity of a page."""
    return url_identity(url)["key"]


@expression
def url_host(url: Sql) -> Sql:
    """Host with port, as used for grouping and same-site tests."""
    return url_identity(url)["host"]


@expression
def url_origin(url: Sql) -> Sql:
    """``scheme://host``, the owner of a robots file."""
    return url_identity(url)["origin"]


@expression
def url_path(url: Sql) -> Sql:
    """Decoded path, null when the address cannot be parsed."""
    return url_identity(url)["path"]


def _without_dots(path: Sql) -> Sql:
    """Remove ``.`` and ``..`` segments; a non-empty result is always rooted."""
    segments = S.split(path, "/", -1)
    walked = S.aggregate(
        segments,
        S.array().cast("array<string>"),
        lambda acc, s: S.when(s == ".", acc)
        .when(s == "..", S.slice(acc, 1, S.greatest(S.size(acc) - 1, 0)))
        .otherwise(S.concat(acc, S.array(s))),
    )
    closing = S.when(S.element_at(segments, -1).isin(".", ".."), "/").otherwise("")
    rooted = S.concat("/", S.array_join(walked, "/"), closing)
    cleaned = let(
        rooted, lambda r: S.when(r.startswith("//"), rest(r, 1)).otherwise(r)
    )
    simple = S.when(path.startswith("/") | (path == ""), path).otherwise(
        S.concat("/", path)
    )
    return S.when(path.rlike(_DOT_SEGMENT), cleaned).otherwise(simple)


def _printed_site(p: Sql) -> Sql:
    """``//user@host`` of a parsed URL as it is printed."""
    user = S.when(p["has_user"], S.concat(p["user"], "@")).otherwise("")
    return S.concat("//", user, _escaped(p["host"], _HOST_AS_IS, _HOST_KEPT))


def _base(base: Sql) -> Sql:
    """The parts of a page URL that its links need; null when unparsable."""

    def part(group: int) -> Sql:
        return S.regexp_extract(base, _PLAIN_PAGE, group)

    plain = S.struct(
        part(2).alias("scheme"),
        part(1).alias("site"),
        part(3).alias("path"),
        part(4).startswith("?").alias("has_query"),
        S.substr(part(4), 2).alias("query"),
        part(5).alias("fragment"),
    )
    full = let(
        _pieces(base),
        lambda p: S.when(
            p.isNotNull(),
            S.struct(
                p["scheme"].alias("scheme"),
                S.concat(p["scheme"], ":", _printed_site(p)).alias("site"),
                _escaped(p["path"], _PATH_AS_IS, _PATH_KEPT).alias("path"),
                p["has_query"].alias("has_query"),
                p["query"].alias("query"),
                p["fragment"].alias("fragment"),
            ),
        ),
    )
    return S.when(base.rlike(_PLAIN_PAGE), plain).otherwise(full)


def _resolve(base: Sql, href: Sql) -> Sql:
    def odd(p: Sql) -> Sql:
        own_site = (p["scheme"] != "") | (p["host"] != "") | p["has_user"]
        scheme = S.when(p["scheme"] != "", p["scheme"]).otherwise(base["scheme"])
        # A reference without path and query repeats those of the page.
        same_page = ~own_site & (p["path"] == "") & ~p["has_query"]
        has_query = S.when(same_page, base["has_query"]).otherwise(p["has_query"])
        query = S.when(same_page, base["query"]).otherwise(p["query"])
        fragment = S.when(same_page & (p["fragment"] == ""), base["fragment"]).otherwise(
            p["fragment"]
        )
        path = _escaped(p["path"], _PATH_AS_IS, _PATH_KEPT)
        merged = (
            S.when(own_site | path.startswith("/"), path)
            .when(path == "", base["path"])
            .otherwise(S.concat(S.regexp_extract(base["path"], "(?s)^(.*/)", 1), path))
        )
        # ``http:/x`` names a scheme but no authority and prints without one.
        no_site = (p["scheme"] != "") & ~p["front"].startswith("//")
        site = (
            S.when(~own_site, base["site"])
            .when(no_site, S.concat(scheme, ":"))
            .otherwise(S.concat(scheme, ":", _printed_site(p)))
        )
        resolved = S.when(p["is_opaque"], S.concat(scheme, ":", p["front"])).otherwise(
            S.concat(site, let(merged, _without_dots))
        )
        return S.concat(
            resolved,
            S.when(has_query, S.concat("?", query)).otherwise(""),
            S.when(
                fragment != "",
                S.concat("#", _escaped(fragment, _FRAGMENT_AS_IS, _FRAGMENT_KEPT)),
            ).otherwise(""),
        )

    return S.when(
        base.isNotNull() & href.isNotNull(),
        S.when(href.rlike(_PLAIN_ROOTED), S.concat(base["site"], href))
        .when(href.rlike(_PLAIN_ABSOLUTE), href)
        .when(
            href.rlike(_ODD_BYTES_ROOTED),
            S.concat(base["site"], _escaped(href, _PATH_AS_IS, _PATH_KEPT)),
        )
        .otherwise(let(_pieces(href), lambda p: S.when(p.isNotNull(), let(p, odd)))),
    )


@expression
def resolve_url(base: Sql, href: Sql) -> Sql:
    """Absolute, re-encoded URL of a reference; null when either is rejected."""
    return let(_base(base), lambda b: let(href, lambda h: _resolve(b, h)))


@expression
def resolve_all(base: Sql, hrefs: Sql) -> Sql:
    """``resolve_url`` over an array of references of one page."""
    return let(_base(base), lambda b: S.transform(hrefs, lambda h: _resolve(b, h)))


@expression
def is_http(url: Sql) -> Sql:
    return url.startswith("http://") | url.startswith("https://")


@expression
def is_live_href(href: Sql) -> Sql:
    """A reference worth resolving: present, not empty, not a mere fragment."""
    return href.isNotNull() & (href != "") & ~href.startswith("#")


@expression
def should_skip(url: Sql) -> Sql:
    """True for binary files, feeds, account pages and the like."""
    endings = "|".join(SKIPPED_ENDINGS)
    parts = "|".join(p.replace("?", r"\?") for p in SKIPPED_PARTS)
    return S.lower(url).rlike(rf"\.(?:{endings})\z|{parts}")


@expression
def url_contains(url: Sql, wanted: Sql) -> Sql:
    """Substring filter of a request; an empty or missing filter keeps all."""
    return S.when(S.coalesce(wanted, "") == "", True).otherwise(
        S.contains(url, wanted)
    )


@expression
def valid_url(url: Sql, mode: str = "strict") -> Sql:
    """``strict`` wants http(s) and a host, ``prefix`` only tests the prefix."""
    if mode == "prefix":
        return S.coalesce(is_http(url), False)
    if mode != "strict":
        raise ValueError(f"unknown mode: {mode}")
    return S.coalesce(url.rlike("^(?i:https?)://[^/?#]"), False)
