"""Small string helpers shared by the URL, HTML and robots expressions."""

from __future__ import annotations

from .sqltext import S, Sql, let

# The code points with the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def trim_space(text: Sql) -> Sql:
    """Strip Unicode white space on both sides (``trim`` only knows blanks)."""
    return S.btrim(text, WHITE_SPACE)


def rest(text: Sql, skip: Sql) -> Sql:
    """What follows the first ``skip`` characters."""
    return S.substr(text, skip + 1)


def percent_decode(text: Sql) -> Sql:
    """Undo ``%XX``; a plus sign stays a plus sign, unlike in form data.

    Bytes that are no UTF-8 would all become the same replacement character and
    make different addresses equal, so such text is left as it was written.
    """
    decoded = S.try_url_decode(S.replace(text, "+", "%2B"))
    usable = decoded.isNotNull() & ~decoded.contains("\ufffd")
    return S.when(~text.contains("%"), text).otherwise(S.when(usable, decoded).otherwise(text))


def percent_key(text: Sql) -> Sql:
    """Text with ``%XX`` undone in which two texts are equal just when their bytes are; ``%XX`` must be well formed.

    Bytes that are no UTF-8, and the replacement character itself, are followed by a replacement character and all bytes in
    hex.  What decodes to plain text has no replacement character, so the two kinds never meet.
    """

    def decoded(pieces: Sql) -> Sql:
        def joined(so_far: Sql, piece: Sql) -> Sql:
            return S.concat(so_far, S.unhex(S.left(piece, 2)), S.substr(piece, 3).cast("binary"))

        return S.aggregate(S.slice(pieces, 2, S.size(pieces) - 1), S.get(pieces, 0).cast("binary"), joined)

    def shown(data: Sql) -> Sql:
        return let(
            S.make_valid_utf8(data.cast("string")),
            lambda t: S.when(t.contains("\ufffd"), S.concat(t, "\ufffd", S.hex(data))).otherwise(t),
        )

    plain = ~text.contains("%") & ~text.contains("\ufffd")
    return S.when(plain, text).otherwise(let(S.split(text, "%", -1), lambda pieces: let(decoded(pieces), shown)))
