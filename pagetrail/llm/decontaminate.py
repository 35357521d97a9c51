"""Benchmark decontamination by pigeonhole pieces and Myers' bit-parallel distance.

A test item may occur in a document with up to k edits (inserted, deleted or changed characters).
Cut into k + 1 pieces, at least one piece then occurs unchanged.  XX  Of the pairs of pieces, one has at most one edit, so
beside a hit that counts there is half of its neighbour at least; and an edit destroys GRAM grams of the
item at most, so most of them are near it.  Around what is left Myers' algorithm gives the least distance
of the item to any passage there.

Documents and items are compared as runs of letters and digits, lower-cased, one blank between.
Items are the stated query set: they are split by hash into blocks of a bounded size, and each block
meets all documents.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, fresh, in_batches, text_or_empty

#: Edits allowed, as a share of the characters of an item.
ERRORS = 0.1
#: Of a piece, so many bytes are found as numbers at most; the rest is compared.
PIECE = 16
#: Characters of the grams that are counted before a distance is measured.
GRAM = 4
#: Bytes of items in a block (one block is in memory at a time).
BLOCK_BYTES = 4 << 20
#: Bytes of text searched at once; what is made of them stays in a core's cache.
PART = 1 << 16
#: Between texts that are searched together: a byte that no UTF-8 has.
APART = b"\xff"

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def plain(text: Column) -> Column:
    """Lower-cased runs of letters and digits, one blank between."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def budget(chars: int, size: int, errors: float = ERRORS) -> int:
    """Edits allowed for an item of so many characters, whatever its bytes."""
    return int(errors * chars)


def pieces(item: str, k: int) -> list[tuple[int, bytes, int]]:
    """Start, bytes and middle of k + 1 pieces of nearly equal size; no cut goes through a character."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    out, start = [], 0
    for a, b in zip(cuts, cuts[1:]):
        piece = item[a:b].encode()
        out.append((start, piece, len(item[a : (a + b) // 2].encode())))
        start += len(piece)
    return out


def myers(pattern: str, text: str) -> int:
    """Least edit distance of the pattern to any passage of the text; bit vectors as long as the pattern."""
    m = len(pattern)
    if m == 0:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, now = full, 0, m
    best = m
    get = masks.get
    for c in text:
        eq = get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        if ph & top:
            now += 1
        elif mh & top:
            now -= 1
            if now < best:
                best = now
        ph = ph << 1 & full
        mh = mh << 1 & full
        plus = mh | (full & ~(xv | ph))
        minus = ph & xv
    return best


def _words(data: np.ndarray, width: int) -> np.ndarray:
    """Each window of 1, 2, 4 or 8 bytes as a number, without a copy."""
    n = len(data) - width + 1
    return np.ndarray(n, f"<u{width}", data, 0, (1,)) if n > 0 else np.zeros(0, f"<u{width}")


def _mixed(words: np.ndarray, shift: np.uint64) -> np.ndarray:
    """Places of numbers in a filter of 64 - ``shift`` bits."""
    mixed = words * _FACTOR
    mixed >>= shift
    return mixed.view(np.int64)


@dataclass
class Pieces:
    """Pieces of at least ``width`` bytes and of fewer than twice as many, or of any number from eight on."""

    width: int
    #: Numbers that pieces begin with, ascending, and the filter of them.
    firsts: np.ndarray
    shift: np.uint64
    gate: np.ndarray
    #: By the distance of the last number from the first: both as one key, ascending, with item and piece of each.
    ends: dict[int, tuple[np.ndarray, list[tuple[int, int, int]]]]

    @classmethod
    def of(cls, width: int, found: list[tuple[bytes, int, int]]) -> Pieces:
        """``found``: first bytes, item and number of each piece."""
        number = lambda raw: int.from_bytes(raw, "little")
        firsts = np.array(sorted({number(raw[:width]) for raw, _, _ in found}), np.uint64)
        bits = min(22, max(10, len(firsts).bit_length() + 6))
        shift = np.uint64(64 - bits)
        gate = np.zeros(1 << bits, bool)
        gate[_mixed(firsts, shift)] = True
        ends: dict[int, list[tuple[int, int, int]]] = {}
        for raw, i, j in found:
            key = (number(raw[:width]) * int(_FACTOR) + number(raw[-width:])) % (1 << 64)
            ends.setdefault(len(raw) - width, []).append((key, i, j))
        return cls(width, firsts, shift, gate, {n: (np.array([f[0] for f in sorted(e)], np.uint64), sorted(e)) for n, e in ends.items()})

    def hits(self, part: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Place, item and number of pieces that begin in the first PART bytes, as far as the numbers tell."""
        words = _words(part, self.width)
        places = np.flatnonzero(self.gate[_mixed(words[:PART], self.shift)])
        first = words[places].astype(np.uint64)
        known = self.firsts[np.minimum(np.searchsorted(self.firsts, first), len(self.firsts) - 1)] == first
        places, first = places[known], first[known] * _FACTOR
        for distance, (keys, found) in self.ends.items():
            inside = np.count_nonzero(places + distance < len(words))  # places ascend
            key = first[:inside] + words[places[:inside] + distance]
            k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            equal = keys[k] == key
            for p, k in zip(places[:inside][equal].tolist(), k[equal].tolist()):
                value = found[k][0]
                while k < len(found) and found[k][0] == value:
                    yield p, found[k][1], found[k][2]
                    k += 1


def _grams(text: str) -> list[str]:
    return [text[i : i + GRAM] for i in range(len(text) - GRAM + 1)]


@dataclass
class Matcher:
    """The pieces of a block of items, by the numbers that their first bytes are."""

    ids: list[int]
    texts: list[str]

    def __post_init__(self) -> None:
        self.raw = [t.encode() for t in self.texts]
        self.edits = [budget(len(t), len(b)) for t, b in zip(self.texts, self.raw)]
        self.grams = [_grams(t) for t in self.texts]
        self.pieces = [pieces(t, k) for t, k in zip(self.texts, self.edits)]
        by_width: dict[int, list[tuple[bytes, int, int]]] = {}
        for i, cut in enumerate(self.pieces):
            for j, (_, piece, _) in enumerate(cut):
                if piece:
                    width = min(PIECE // 2, 1 << len(piece).bit_length() - 1)
                    by_width.setdefault(width, []).append((piece[:PIECE], i, j))
        self.by_width = [Pieces.of(width, found) for width, found in sorted(by_width.items())]

    def _hits(self, group: list[bytes]) -> dict[int, set[tuple[int, int]]]:
        """By text of a group: items and the places in it where they would begin, for pieces that occur."""
        starts = [0, *accumulate(len(data) + 1 for data in group)]
        whole = APART.join(group)
        hits: dict[int, set[tuple[int, int]]] = {}
        for at in range(0, len(whole), PART):
            part = np.frombuffer(whole[at : at + PART + PIECE - 1], np.uint8)
            for kind in self.by_width:
                for p, i, j in kind.hits(part):
                    n = bisect_right(starts, at + p) - 1
                    data, place = group[n], at + p - starts[n]
                    start, piece, _ = self.pieces[i][j]
                    if data.startswith(piece, place) and self._beside(i, j, data, place - start):
                        hits.setdefault(n, set()).add((i, place - start))
        return hits

    def _beside(self, i: int, j: int, data: bytes, begin: int) -> bool:
        """Whether the other piece of the pair may be there with one edit, which leaves one of its halves in place."""
        if j ^ 1 >= len(self.pieces[i]):
            return True
        start, piece, middle = self.pieces[i][j ^ 1]
        a = begin + start
        b, c = a + middle, a + len(piece)  # a character has four bytes at most
        return (
            data.find(piece[:middle], max(0, a - 4), max(0, b + 4)) >= 0 or data.find(piece[middle:], max(0, b - 4), max(0, c + 4)) >= 0
        )

    def _may_match(self, i: int, passage: str) -> bool:
        """Whether the passage has as many grams of the item as its budget leaves."""
        least = len(self.texts[i]) - GRAM + 1 - GRAM * self.edits[i]
        if least <= 0:
            return True
        near = set(_grams(passage))
        return sum(map(near.__contains__, self.grams[i])) >= least

    def matches(self, text: str) -> dict[int, int]:
        """Least distance by item id, for the items that occur within their budget."""
        return next(self.all_matches([text]))

    def all_matches(self, texts: Iterable[str]) -> Iterator[dict[int, int]]:
        """``matches`` of each text; short ones are searched together."""
        group: list[bytes] = []
        size = 0
        for text in texts:
            group.append(text.encode())
            size += len(group[-1]) + 1
            if size >= PART:
                yield from self._of_group(group)
                group, size = [], 0
        yield from self._of_group(group)

    def _of_group(self, group: list[bytes]) -> Iterator[dict[int, int]]:
        hits = self._hits(group)
        for n, data in enumerate(group):
            yield self._least(data, sorted(hits[n])) if n in hits else {}

    def _least(self, data: bytes, hits: list[tuple[int, int]]) -> dict[int, int]:
        best: dict[int, int] = {}
        reach: dict[int, int] = {}
        for i, begin in hits:
            if best.get(i) == 0:
                continue
            raw, k = self.raw[i], self.edits[i]
            if begin >= 0 and data.startswith(raw, begin):
                best[i] = 0
                continue
            if i in reach and begin <= reach[i]:
                continue  # the passage around the last hit covers this one
            slack = 4 * k
            low, high = max(0, begin - slack), begin + len(raw) + 2 * slack
            reach[i] = begin + slack // 2
            passage = data[low:high].decode(errors="ignore")
            if not self._may_match(i, passage):
                continue
            d = myers(self.texts[i], passage)
            if d <= k and d < best.get(i, k + 1):
                best[i] = d
        least: dict[int, int] = {}
        for i, d in best.items():  # an item may have several texts
            least[self.ids[i]] = min(d, least.get(self.ids[i], d))
        return least


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[Matcher]:
    """Matchers over the items, a block of bounded size at a time."""
    known = cut_lineage(
        items.select(F.col(key).cast("long").alias("i"), plain(text_or_empty(text)).alias("t")).where("t <> '' AND i IS NOT NULL").distinct(), "items"
    )
    size = known.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = int(size) // BLOCK_BYTES + 1
    for b in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()
        rows.sort()
        if rows:
            yield Matcher([r["i"] for r in rows], [r["t"] for r in rows])


def contamination(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per document row and item that occurs in it: key, item_id, distance.  An item may have a tenth of its characters edited.

    Null and empty texts on either side, and those without letters or digits, match nothing.  Items of fewer
    than ten characters must occur unchanged.  Items with a null key are ignored; an item repeated under another
    key is another item.  Of several texts of an item in one block the least distance counts; beyond BLOCK_BYTES of items there may be
    a row for each block.  Repeated documents give repeated rows, null document keys are kept.  No rows on
    either side: no rows.  Whole texts are searched, in parts; extra columns play no part.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), plain(text_or_empty(text)).alias("body"))
    out = spark.createDataFrame([], "key long, item_id long, distance int")
    for matcher in _blocks(items, item_key, item_text):
        out = out.union(_search(rows, matcher))
    return out.withColumnRenamed("key", key)


def _search(rows: DataFrame, matcher: Matcher) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(matcher)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, i, d) for k, t in zip(batch.column(0).to_pylist(), held.value.all_matches(batch.column(1).to_pylist())) for i, d in t.items()]
            k, i, d = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(i, pa.int64()), pa.array(d, pa.int32())], ["key", "item_id", "distance"])

    return in_batches(rows, run, "key long, item_id long, distance int")


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item occurs, with all their columns."""
    names = docs.columns
    body = fresh("x_plain", names)
    out = docs.withColumn(body, plain(text_or_empty(text)))
    for matcher in _blocks(items, item_key, item_text):
        held = docs.sparkSession.sparkContext.broadcast(matcher)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [not found for found in held.value.all_matches(batch.column(len(names)).to_pylist())]
                yield batch.filter(pa.array(keep, pa.bool_()))

        out = in_batches(out, run, out.schema)
    return out.drop(body)
