"""Main text of pages by deducing each host's template from equivalence classes of tokens.

A token is a tag at its path of enclosing tags.  Its occurrence vector says how often it occurs in
each page of the host; tokens that share a vector form an equivalence class.  Vectors are summed
up as a hash over (page, count), pre-combined per task, so that a host of any size is one
aggregation.  A class is valid if it is frequent and its tokens occur once on most of their pages; as tokens carry
their paths, valid classes nest by path into the template.  What lies between template tokens are
slots.  The article's slots lie in the template's article or main element if it holds half of the
host's text, else in the smallest container that holds all of it; they are extracted whole, except for
elements that are menus, headers, footers, side bars, notices, adverts, forms, scripts or comments.  A
form, or an element that only a word of its class, id or role marks, stays if it holds half of the
host's text (of the page's, if it isn't frequent), and the mark isn't inherited into an article.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, text_or_empty
from .urlfilter import host_of

#: A class is frequent if it occurs in this share of a host's pages.
FREQUENT = 0.5
#: The slot's container holds this share of the text that isn't outside; a page where it holds less gives all of it.
NEARLY = 1.0

# Element names, and words of class, id or role that mark what is no article.
RAW = "script|style|noscript|iframe|textarea|title"
#: Within these, a tag that ends in "/>" is closed, and no element is raw text.
FOREIGN = frozenset(("svg", "math"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
CONTAINER = frozenset("article main section div body td html".split())
OUTSIDE = frozenset("nav header footer aside menu head dialog button fieldset svg object select template".split())
#: HTML elements that end foreign ones that are open, and where in foreign ones HTML may stand.
BREAKS = BLOCK - {"title"} | frozenset("b code em i img s small span strong sub sup u var br embed meta".split())
HOLDS = frozenset(("foreignobject", "desc", "annotation-xml"))
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies dialog disclaimer disqus footer header menu modal nav navbar navigation newsletter notice notices "
    "notification popup promo promoted related respond search share sharing sidebar social sponsor sponsored subscribe "
    "toolbar widget".split()
)
#: Elements that an opening tag ends if they are open in the same container.
CLOSES = {"li": "li", "dt": "dd|dt", "dd": "dd|dt", "tr": "tr|td|th", "td": "td|th", "th": "td|th", "option": "option"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:" + RAW + r")(?=[\s/>])[^>]*>|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.S | re.I,
)
_RAW_TAG = re.compile(r"<(" + RAW + r")(?=[\s/>])([^>]*)>", re.I)
_MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[\s_\-]+")
_SPACE = re.compile(r"\s+")

_MASK = (1 << 63) - 1


def _is_marked(name: str, attributes: str) -> bool:
    """Whether an element may be no article, by a word of its class, id or role; what it holds decides."""
    if name == "form":
        return True
    if attributes and name not in ("html", "body", "article", "main"):
        for m in _MARKS.finditer(attributes):
            if not WORDS.isdisjoint(_SPLIT.split((m[1] or m[2] or m[3] or "").lower())):
                return True
    return False


def _step(path: int, name: str, mark: str) -> int:
    """Identity of a path that goes on with a tag; the same on every machine."""
    h = path
    for c in f"{name} {mark}".encode():
        h = ((h ^ c) * 0x100000001B3) & _MASK
    return h


class Mark:
    """A marked element: the mark above it, the one around it in the page, and the characters below it."""

    __slots__ = ("path", "above", "around", "in_article", "chars", "dropped")

    def __init__(self, path: int, above: Mark | None, around: Mark | None, in_article: bool) -> None:
        self.path, self.above, self.around, self.in_article, self.chars, self.dropped = path, above, around, in_article, 0, False


class Open:
    """An open element; ``mark`` is the one that holds for its text, ``around`` the innermost one."""

    __slots__ = ("name", "path", "outside", "mark", "around", "in_article")

    def __init__(self, name: str, path: int, outside: bool, mark: Mark | None, around: Mark | None, in_article: bool) -> None:
        self.name, self.path, self.outside, self.mark, self.around, self.in_article = name, path, outside, mark, around, in_article


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, attributes) for tags and ("text", text, "") for what stands between them."""
    at, n, foreign = 0, len(page), 0
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", page[at:], ""
            return
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        if m[2] is not None:
            kind, name = ("close" if m[1] else "open"), m[2].lower()
            if name in FOREIGN and not (kind == "open" and m[3].endswith("/")):
                foreign = foreign + 1 if kind == "open" else max(0, foreign - 1)
            elif foreign and kind == "open" and name in BREAKS:
                foreign = 0
            yield kind, name, m[3]
        else:
            raw = _RAW_TAG.match(page, m.start())
            if raw is None:
                continue
            if foreign:
                yield "open", raw[1].lower(), raw[2]
            else:
                end = re.compile(rf"</{raw[1]}\s*>", re.I).search(page, at)
                at = end.end() if end else n


class Walk:
    """Follows the open elements of a page; the two passes hook in at text and at ends."""

    def __init__(self) -> None:
        self.stack = [Open("", 1, False, None, None, False)]
        self.marks: list[Mark] = []

    def text(self, raw: str) -> None: ...

    def block(self) -> None: ...

    def opened(self, element: Open) -> None: ...

    def closed(self, element: Open) -> None: ...

    def _pop(self) -> None:
        self.closed(self.stack.pop())

    def _end(self, names: str, limit: frozenset[str]) -> None:
        wanted = names.split("|")
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].name in wanted:
                while len(self.stack) > i:
                    self._pop()
                return
            if self.stack[i].name in limit:
                return

    def _mark(self, element: Open, attributes: str) -> None:
        if element.name in ("article", "main"):
            # a mark around it says nothing about it, unless the mark is part of another article
            if element.mark is not None and not element.mark.in_article:
                element.mark = None
            element.in_article = True
        elif _is_marked(element.name, attributes):
            element.mark = element.around = Mark(element.path, element.mark, element.around, element.in_article)
            self.marks.append(element.around)

    def judge(self, total: int, known: dict[int, bool]) -> None:
        """Decides which marks hold: as the host does where it knows the path, else those with less than half of the page's text."""
        for m in reversed(self.marks):
            if m.around is not None:
                m.around.chars += m.chars
        for m in self.marks:
            m.dropped = (m.above is not None and m.above.dropped) or known.get(m.path, m.chars < FREQUENT * total)

    def _leave_foreign(self) -> None:
        """Ends foreign elements that are open, up to one that holds HTML."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].name in HOLDS:
                return
            if self.stack[i].name in FOREIGN:
                while len(self.stack) > i:
                    self._pop()

    def run(self, page: str) -> None:
        for kind, name, attributes in events(page):
            if kind == "text":
                self.text(name)
                continue
            if kind == "open" and name in BREAKS and self.stack[-1].outside:
                self._leave_foreign()
            if name in BLOCK and not self.stack[-1].outside:
                self.block()
            elif name == "br":
                self.text(" ")
            if kind == "open":
                if name in BLOCK and self.stack[-1].name not in ("body", "html", ""):
                    self._end("p", CONTAINER | OUTSIDE | {"li", "blockquote", "th", "button"})
                if name in CLOSES:
                    self._end(CLOSES[name], frozenset(("ul", "ol", "dl", "table", "select", "article", "body")))
                if name in VOID or attributes.endswith("/"):
                    continue
                top = self.stack[-1]
                outside = top.outside or name in OUTSIDE
                m = _MARKS.search(attributes) if attributes else None
                mark = (m[1] or m[2] or m[3] or "") if m else ""
                element = Open(name, _step(top.path, name, mark), outside, top.mark, top.around, top.in_article)
                if not outside:
                    self._mark(element, attributes)
                self.stack.append(element)
                self.opened(element)
            else:
                self._end(name, frozenset())
        self.block()
        while len(self.stack) > 1:
            self._pop()


class Profile(Walk):
    """Occurrences of each token of a page, and the text below it that may be an article's."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list] = []  # of each element: the row around it, path, name, depth, characters, mark, marked itself
        self.open = [-1]
        self.total = 0
        self.parts: list[tuple[int, int, Mark | None]] = []

    def text(self, raw: str) -> None:
        top = self.stack[-1]
        if not top.outside:
            n = len(raw.strip())
            self.total += n
            if top.around is not None:
                top.around.chars += n
            self.parts.append((self.open[-1], n, top.mark))

    def opened(self, element: Open) -> None:
        self.open.append(self.open[-1] if element.outside else len(self.rows))
        if not element.outside:
            own = element.around if self.marks and element.around is self.marks[-1] and element.around.path == element.path else None
            self.rows.append([self.open[-2], element.path, element.name, len(self.stack), 0, own])

    def closed(self, element: Open) -> None:
        self.open.pop()

    def found(self) -> tuple[int, dict[int, list]]:
        """Characters of the page that marks leave; by token name, depth, times, such characters, marked, all characters if marked."""
        self.judge(self.total, {})
        left = 0
        for row, n, mark in self.parts:
            if mark is None or not mark.dropped:
                left += n
                if row >= 0:
                    self.rows[row][4] += n
        tokens: dict[int, list] = {}
        for above, path, name, depth, chars, own in reversed(self.rows):
            if above >= 0:
                self.rows[above][4] += chars
            entry = tokens.setdefault(path, [name, depth, 0, 0, own is not None, 0])
            entry[2] += 1
            entry[3] += chars
            if own is not None:
                entry[5] += own.chars
        return left, tokens


class Article(Walk):
    """The text of a page, with what is in the slot of the template and what is marked."""

    def __init__(self, slot: int | None) -> None:
        super().__init__()
        self.slot, self.inside, self.seen = slot, 0, False
        self.total = 0
        self.pieces: list[tuple[str, Mark | None]] = []
        self.blocks: list[tuple[bool, list[tuple[str, Mark | None]]]] = []

    def text(self, raw: str) -> None:
        top = self.stack[-1]
        if not top.outside:
            n = len(raw.strip())
            self.total += n
            if top.around is not None:
                top.around.chars += n
            self.pieces.append((raw, top.mark))

    def block(self) -> None:
        if self.pieces:
            self.blocks.append((self.inside > 0, self.pieces))
            self.pieces = []

    def opened(self, element: Open) -> None:
        if element.path == self.slot:
            self.block()
            self.inside += 1
            self.seen = True
            element.mark = None

    def closed(self, element: Open) -> None:
        if element.path == self.slot:
            self.block()
            self.inside -= 1

    def texts(self, share: float) -> list[str]:
        """Blocks of the slot if it holds so much of the text that marks leave, else all."""
        every, within, whole, found = [], [], 0, 0
        for inside, pieces in self.blocks:
            left = "".join(raw for raw, mark in pieces if mark is None or not mark.dropped)
            text = _SPACE.sub(" ", entities.unescape(left)).strip()
            if text:
                every.append(text)
                whole += len(text)
                if inside:
                    within.append(text)
                    found += len(text)
        return within if self.seen and found >= share * whole else every


def article(page: str, slot: int | None, named: bool | None = None, kept: list[int] = (), dropped: list[int] = ()) -> str:
    """Text of the slot, or if the page lacks it or has much text elsewhere, everything that isn't outside; marks hold as the host says."""
    walk = Article(slot)
    walk.run(page)
    walk.judge(walk.total, dict.fromkeys(kept or (), False) | dict.fromkeys(dropped or (), True))
    return "\n".join(walk.texts(FREQUENT if named else NEARLY))


def templates(pages: DataFrame) -> DataFrame:
    """(host, slot, named, kept, dropped): paths of the article and of marked elements in each host's template; pages have page, host, html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for page, host, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                walk = Profile()
                walk.run(text)
                left, tokens = walk.found()
                rows.append((host, page, 1, "", 0, 1, left, False, walk.total))
                rows += [(host, page, path, *entry) for path, entry in tokens.items()]
            columns = list(zip(*rows)) if rows else [()] * 9
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "page", "token", "name", "depth", "times", "chars", "marked", "whole"]
            )

    found = in_batches(pages, run, "host string, page long, token long, name string, depth int, times int, chars long, marked boolean, whole long")
    tokens = found.groupBy("host", "token").agg(
        F.first("name").alias("name"),
        F.first("depth").alias("depth"),
        F.count("*").alias("pages"),
        F.sum("times").alias("times"),
        F.sum("chars").alias("chars"),
        F.sum((F.col("times") == 1).cast("long")).alias("once"),
        F.first("marked").alias("marked"),
        F.sum("whole").alias("whole"),
        F.sum(F.xxhash64("page", "times").cast("decimal(38,0)")).alias("vector"),
    )
    whole = tokens.where("token = 1").select("host", F.col("pages").alias("all_pages"), F.col("chars").alias("all_chars"), F.col("whole").alias("all_whole"))
    valid = tokens.join(whole, "host").where((F.col("once") >= FREQUENT * F.col("pages")) & (F.col("pages") >= FREQUENT * F.col("all_pages")))
    # tokens of one class share its size; in it the best container counts
    named = F.col("name").isin("article", "main")
    enough = F.when(named, FREQUENT).otherwise(NEARLY) * F.col("all_chars")
    classes = valid.where(F.col("name").isin(*CONTAINER) & (F.col("chars") >= enough)).groupBy("host", "vector", named.alias("named")).agg(
        F.max(F.struct("depth", "chars", "token")).alias("best")
    )
    # classes nest: the smallest one that holds all that the largest named one, if there is one, holds
    most = classes.groupBy("host").agg(F.max(F.struct("named", "best.chars")).alias("most"))
    inner = classes.join(most, "host").where((F.col("named") == F.col("most.named")) & (F.col("best.chars") >= NEARLY * F.col("most.chars")))
    slots = inner.groupBy("host").agg(F.max(F.struct("best.depth", "best.chars", "best.token", "named")).alias("best"))
    slots = slots.select("host", F.col("best.token").alias("slot"), F.col("best.named").alias("named"))
    # of frequent marked elements, those stay that hold most of the host's text
    marked = tokens.where("marked").join(whole, "host").where(F.col("pages") >= FREQUENT * F.col("all_pages"))
    stays = F.col("whole") >= FREQUENT * F.col("all_whole")
    marks = marked.groupBy("host").agg(
        F.collect_list(F.when(stays, F.col("token"))).alias("kept"), F.collect_list(F.when(~stays, F.col("token"))).alias("dropped")
    )
    return slots.join(marks, "host", "full")


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: key, url, text (empty if there is none), n_chars.

    Null and empty html give an empty text; a null url has the empty host.  Character references are decoded,
    white space inside a block becomes one blank, blocks are joined by a new line.  A page that
    lacks its host's slot, or has more text outside it than it may, gives all its text that is not a menu, header and so on.  Null keys and repeated
    rows stay; a repeated page counts twice in its host's vectors.  No rows: no rows.  Extra columns play no part.
    """
    rows = pages.select(
        F.col(key).cast("long").alias("page"), host_of(F.col(url)).alias("host"), text_or_empty(html).alias("html"), F.col(url).alias("url")
    )
    slots = templates(rows.select("page", "host", "html"))
    joined = rows.join(slots, "host", "left").select("page", "url", "html", "slot", "named", "kept", "dropped")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [article(*row) for row in zip(*(batch.column(i).to_pylist() for i in range(2, 7)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page", "url", "text", "n_chars"],
            )

    out = in_batches(joined, run, "page long, url string, text string, n_chars long")
    return out.select(F.col("page").alias(key), "url", "text", "n_chars")
