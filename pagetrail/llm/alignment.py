"""Alignment of two tokenizers by token-byte incidence matrices.

Both tokenizers cut the same bytes.  The incidence matrix of a side has a row per token and a column per byte; the
product of A with the transpose of B has an entry for each pair of tokens that share bytes: the overlap links,
with the number of bytes.  Offsets where tokens of both sides end cut the tokens into groups; the product
of the two token-group matrices has an entry for each pair within a group.  Matrices are sparse rows (CSR)
written out here, products are Gustavson's row by row, in blocks of rows, so that memory is bounded.

Texts are tokenized once and their ids written; counts over the corpus and everything that needs
them read the ids.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import merged, read_json
from .common import cut_lineage, in_batches, text_or_empty

#: Entries of a product worked on at once; pairs a task counts before it passes them on.
BLOCK, COUNTED = 1 << 20, 1 << 22
#: Bytes of ids of one side that are worked on at once.
SLICE = 1 << 19
#: Pairs whose counts every task holds: at most 2**FREQUENT of the most frequent, 17 bytes each; the others are joined.
FREQUENT = 20
#: Characters from which on a text is tokenized in parts, and about the length of a part.
LONG = 1 << 16

_SHIFT = 32

#: Tokenizer file of A, model of B, pattern of A.
Files = tuple[str, str, str]


# Sparse rows


class Csr:
    """A matrix of 0 and 1, or counts, by rows: ``columns[starts[i]:starts[i+1]]`` are the columns of row i."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, width: int) -> None:
        self.starts, self.columns, self.width = starts, columns, width

    @classmethod
    def of_pieces(cls, lengths: np.ndarray) -> Csr:
        """Rows that own so many columns each, one after the other."""
        starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        return cls(starts, np.arange(starts[-1], dtype=np.int64), int(starts[-1]))

    @property
    def height(self) -> int:
        return len(self.starts) - 1

    def transposed(self) -> Csr:
        rows = np.repeat(np.arange(self.height, dtype=np.int64), np.diff(self.starts))
        if len(self.columns) and (np.diff(self.columns) < 0).any():
            rows = rows[np.argsort(self.columns, kind="stable")]
        starts = np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width), dtype=np.int64)])
        return Csr(starts, rows, self.height)

    def times(self, other: Csr, block: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Entries (row, column, value) of the product, row after row, columns ascending.

        Gustavson: row i is the sum of the rows of ``other`` that the columns of row i name.  Whole rows are
        taken together up to ``block`` terms, or one row of more.
        """
        block = block or BLOCK
        sizes = np.diff(other.starts)[self.columns]
        terms = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[self.starts]  # before each row
        row = 0
        while row < self.height:
            end = max(int(np.searchsorted(terms, terms[row] + block, "right")) - 1, row + 1)
            lo, hi = self.starts[row], self.starts[end]
            named, size = self.columns[lo:hi], sizes[lo:hi]
            rows = np.repeat(np.repeat(np.arange(row, end, dtype=np.int64), np.diff(self.starts[row : end + 1])), size)
            within = np.arange(len(rows), dtype=np.int64) - np.repeat(np.cumsum(size) - size, size)
            yield _summed(rows, other.columns[np.repeat(other.starts[named], size) + within])
            row = end


def _summed(rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (row, column) terms as one entry with their number."""
    if len(rows) > 1 and ((rows[1:] == rows[:-1]) & (columns[1:] < columns[:-1])).any():
        order = np.lexsort((columns, rows))
        rows, columns = rows[order], columns[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (columns[1:] != columns[:-1])
    first = np.flatnonzero(new)
    return rows[first], columns[first], np.diff(first, append=len(rows))


def group_numbers(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Group of each token of A and of B, and the number of groups: cut where tokens of both end."""
    ends_a, ends_b = np.cumsum(a, dtype=np.int64), np.cumsum(b, dtype=np.int64)
    cuts = ends_a[np.searchsorted(ends_b, ends_a, "right") > np.searchsorted(ends_b, ends_a, "left")]
    cuts = np.unique(cuts)
    return np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b), len(cuts)


def _cuts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Last bytes of the tokens of A and of B, and for each byte whether tokens of both end with it."""
    last_a, last_b = np.cumsum(a, dtype=np.int64) - 1, np.cumsum(b, dtype=np.int64) - 1
    ends = np.zeros(int(last_a[-1]) + 1 if len(a) else 0, np.int8)
    ends[last_a] = 1
    ends[last_b] += 1
    return last_a, last_b, ends == 2


def group_numbers(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Group of each token of A and of B, and the number of groups: cut where tokens of both end."""
    last_a, last_b, cut = _cuts(a, b)
    before = np.cumsum(cut, dtype=np.int64) - cut
    return before[last_a], before[last_b], int(cut.sum())


def overlaps(a: np.ndarray, b: np.ndarray, block: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Overlap links of tokens of the byte lengths ``a`` and ``b``: (token of A, token of B, shared bytes).

    No link crosses a group, so matrices are built for whole groups of about ``block`` bytes together.
    """
    block = block or BLOCK
    last_a, last_b, cut = _cuts(a, b)
    ends = np.flatnonzero(cut)
    group, byte, a0, b0 = 0, 0, 0, 0
    while group < len(ends):
        group = max(int(np.searchsorted(ends, byte + block)), group + 1)
        byte = int(ends[group - 1])
        a1, b1 = (int(np.searchsorted(last, byte)) + 1 for last in (last_a, last_b))
        for rows, columns, shared in Csr.of_pieces(a[a0:a1]).times(Csr.of_pieces(b[b0:b1]).transposed(), block):
            yield rows + a0, columns + b0, shared
        byte, a0, b0 = byte + 1, a1, b1


def shared_groups(a: np.ndarray, b: np.ndarray, block: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Shared-group links (token of A, token of B, 1) of tokens of the byte lengths ``a`` and ``b``, in blocks."""
    of_a, of_b, n = group_numbers(a, b)
    one = lambda of: Csr(np.arange(len(of) + 1, dtype=np.int64), of.astype(np.int64), n)
    yield from one(of_a).times(one(of_b).transposed(), block)


# Tokenizers


class Bytewise:
    """A byte-level BPE tokenizer file; special strings inside texts are plain text.

    ``tiktoken`` reads the same vocabulary several times as fast, but joins any two neighbours that make a token, the
    lowest id first, whatever merges the file lists.  It is used where that is proven to be the same: ids follow
    the order of merges, and every token encodes alone as one token.  Then two neighbours that make a token are always a
    listed pair, as the token alone gets to the same two neighbours and goes on to one token.
    """

    def __init__(self, path: str, pattern: str) -> None:
        ids, merges, special = read_json(path)
        self.pieces = [b""] * (max([*ids.values(), *special.values()]) + 1)
        for piece, i in ids.items():
            self.pieces[i] = piece
        for piece, i in special.items():
            self.pieces[i] = piece.encode()
        if ranks_suffice(ids, merges) and _default_split(path):
            import tiktoken

            whole = tiktoken.Encoding("bytewise", pat_str=pattern, mergeable_ranks=ids, special_tokens={})
            self.encode = lambda texts: [whole.encode_ordinary(t) for t in texts]
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        slow.encode_special_tokens = True
        self.encode = lambda texts: [e.ids for e in slow.encode_batch(texts, add_special_tokens=False)]


def ranks_suffice(ids: dict[bytes, int], merges: dict[tuple[bytes, bytes], int]) -> bool:
    """Whether joining the lowest id first gives what the merges give."""
    made = [ids.get(a + b, -1) for a, b in sorted(merges, key=merges.get)]
    if made != sorted(set(made)) or (made and made[0] < 0):
        return False
    get = merges.get
    return all(len(merged(token, lambda a, b: get((a, b)))) == 1 for token in ids)


def _default_split(path: str) -> bool:
    """Whether the file splits texts by the usual pattern and changes nothing before."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    split = file["pre_tokenizer"] or {}
    plain = {"dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "ignore_merges": False}
    return (
        file["normalizer"] is None
        and split.get("type") == "ByteLevel"
        and not split.get("add_prefix_space")
        and split.get("use_regex", True)
        and all(file["model"].get(name) in (usual, "") for name, usual in plain.items())
    )


class Piecewise:
    """A sentencepiece model; it puts a space before a text by itself."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.pieces = [_piece_bytes(self.model.id_to_piece(i)) for i in range(self.model.get_piece_size())]
        #: No piece has a space behind something else, so none crosses the beginning of a word.
        self.words_part = all("▁" not in self.model.id_to_piece(i).lstrip("▁") for i in range(len(self.pieces)))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _piece_bytes(piece: str) -> bytes:
    if re.fullmatch("<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


#: A space between two letters: what follows is tokenized as if a text began there.
_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")


def parts_of(text: str) -> Iterator[str]:
    """A text in parts that were separated by one space each; one part if there is no place to cut."""
    at = 0
    while len(text) - at > 2 * LONG:
        cut = _CUT.search(text, at + LONG)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:] if at else text


class Pair:
    """Both tokenizers of a worker."""

    def __init__(self, a_path: str, b_path: str, pattern: str) -> None:
        self.a, self.b = Bytewise(a_path, pattern), Piecewise(b_path)
        if not self.b.words_part:
            raise ValueError("pieces of the model cross the beginnings of words")
        self.a_size, self.b_size = (np.array([len(p) for p in side.pieces], np.int64) for side in (self.a, self.b))
        #: Ids as text within a group, then those that begin one.
        self.a_shown, self.b_shown = (
            np.array([m + b"%d" % i for m in (b",", mark) for i in range(len(side.pieces))], object)
            for side, mark in ((self.a, b";"), (self.b, b"|"))
        )

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Ids of both sides by text, as little-endian unsigned 32-bit integers; none where there is nothing to align."""
        parts = [list(parts_of(t)) if t else [] for t in texts]
        flat = [p for group in parts for p in group]
        a_ids = self.a.encode([" " + p for p in flat])
        b_ids = self.b.encode(flat)
        at = 0
        for text, group in zip(texts, parts, strict=True):
            whole = b" " + text.encode()
            sides = []
            for side, ids in ((self.a, a_ids), (self.b, b_ids)):
                own = ids[at] if len(group) == 1 else list(chain.from_iterable(ids[at : at + len(group)]))
                if not text or b"".join(map(side.pieces.__getitem__, own)) != whole:
                    sides = [b"", b""]
                    break
                sides.append(np.fromiter(own, "<u4", len(own)).tobytes())
            at += len(group)
            yield tuple(sides)


_pairs: dict[tuple[str, str, str], Pair] = {}


def pair(*files: str) -> Pair:
    """Both tokenizers of the files and the pattern, one pair per worker process."""
    if files not in _pairs:
        _pairs[files] = Pair(*files)
    return _pairs[files]


# Spark


def encode(docs: DataFrame, files: Files, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, a_ids, b_ids) per row of ``docs``, written once; ids as little-endian unsigned 32-bit integers.

    ``row`` is a number of its own for every row, repeated rows included.  Texts that are null or empty, or that a
    tokenizer does not give back byte by byte, have no ids.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), text_or_empty(F.col(f"`{text}`")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(*files)
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                found = list(both.encode(part.column(1).to_pylist()))
                sides = [pa.array([ids[i] for ids in found], pa.binary()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *sides], ["key", "a_ids", "b_ids"])

    encoded = in_batches(rows, run, "key long, a_ids binary, b_ids binary")
    return cut_lineage(encoded.select(F.monotonically_increasing_id().alias("row"), "*"), "ids")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about SLICE bytes of ids, one text at least."""
    for batch in batches:
        sizes = np.cumsum([len(x.as_buffer()) for x in batch.column("a_ids")] if len(batch) else [0])
        at = 0
        while at < len(batch):
            end = max(int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE, "right")), at + 1)
            yield batch.slice(at, end - at)
            at = end


class Batch:
    """Texts one behind the other: a cut of both sides lies between any two of them."""

    def __init__(self, batch: pa.RecordBatch, both: Pair) -> None:
        self.both = both
        sides = []
        for name, size in (("a_ids", both.a_size), ("b_ids", both.b_size)):
            raw = batch.column(name).to_pylist()
            ids = np.frombuffer(b"".join(raw), "<u4").astype(np.int64)
            sides.append((ids, np.array([len(x) // 4 for x in raw], np.int64), size[ids]))
        (self.a_ids, self.a_n, self.a_size), (self.b_ids, self.b_n, self.b_size) = sides
        self.doc_of_a = np.repeat(np.arange(len(batch)), self.a_n)

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Tokens of A and of B by place, and the shared bytes."""
        return overlaps(self.a_size, self.b_size)

    def codes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Text and pair of ids, as one number, of every link."""
        for a, b, _ in self.links():
            yield self.doc_of_a[a], (self.a_ids[a] << _SHIFT) | self.b_ids[b]

    def group_texts(self) -> tuple[np.ndarray, list[bytes]]:
        """Number of groups by text, and its groups written out."""
        of_a, of_b, n = group_numbers(self.a_size, self.b_size)
        # place of each token when groups follow each other, A before B
        a_until, b_until = (np.cumsum(np.bincount(of, minlength=n)) for of in (of_a, of_b))
        a_place = np.arange(len(of_a)) + np.concatenate([[0], b_until])[of_a]
        b_place = np.arange(len(of_b)) + a_until[of_b]
        marks = np.empty(len(of_a) + len(of_b), object)
        a_first, b_first = (np.diff(of, prepend=-1) > 0 for of in (of_a, of_b))
        marks[a_place] = self.both.a_shown[self.a_ids + a_first * len(self.both.a_size)]
        marks[b_place] = self.both.b_shown[self.b_ids + b_first * len(self.both.b_size)]
        n_groups = np.bincount(self.doc_of_a[a_first], minlength=len(self.a_n))
        sizes = self.a_n + self.b_n
        return n_groups, [b"".join(marks[e - k : e])[1:] for e, k in zip(np.cumsum(sizes), sizes, strict=True)]


def overlap_links(encoded: DataFrame, files: Files) -> DataFrame:
    """(row, key, a_at, b_at, a_id, b_id, n_bytes): one row for each pair of token occurrences that share bytes; places count from 0 in each text."""
    return _pairs_of(encoded, files, lambda one: one.links())


def group_links(encoded: DataFrame, files: Files) -> DataFrame:
    """The same for pairs of token occurrences within one group; n_bytes is 1 for all of them."""
    return _pairs_of(encoded, files, lambda one: shared_groups(one.a_size, one.b_size))


def _pairs_of(encoded: DataFrame, files: Files, product) -> DataFrame:
    schema = pa.schema([(n, pa.int64()) for n in ("row", "key", "a_at", "b_at", "a_id", "b_id", "n_bytes")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(*files)
        for batch in _slices(batches):
            one = Batch(batch, both)
            a_first, b_first = np.cumsum(one.a_n) - one.a_n, np.cumsum(one.b_n) - one.b_n
            for a, b, n in product(one):
                doc = one.doc_of_a[a]
                rows = [batch.column(i).take(pa.array(doc)) for i in (0, 1)]
                values = (a - a_first[doc], b - b_first[doc], one.a_ids[a], one.b_ids[b], n)
                yield pa.RecordBatch.from_arrays(rows + [pa.array(v, pa.int64()) for v in values], schema=schema)

    return in_batches(encoded, run, ", ".join(f"{f.name} long" for f in schema))


def pair_counts(encoded: DataFrame, files: Files) -> DataFrame:
    """(pair, a_id, b_id, n, best): links over the whole corpus by pair of ids; ``best`` where no pair of the b_id has more.

    Tasks add up in a bounded array of pairs and pass it on when it is full.  The best count of a b_id is a table no
    longer than the vocabulary of B, which is what is broadcast.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(*files)
        known, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []
        size = 0

        def add() -> tuple[np.ndarray, np.ndarray]:
            codes, n = np.unique(np.concatenate(waiting), return_counts=True)
            merged, place = np.unique(np.concatenate([known, codes]), return_inverse=True)
            return merged, np.bincount(place, np.concatenate([counts, n])).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(known), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in (known, counts)], ["pair", "n"])

        for batch in _slices(batches):
            for _, codes in Batch(batch, both).codes():
                waiting.append(codes)
                size += len(codes)
                if size > COUNTED:
                    known, counts = add()
                    waiting, size = [], 0
                    if len(known) > COUNTED:
                        yield from out()
                        known, counts = known[:0], counts[:0]
        if waiting:
            known, counts = add()
        yield from out()

    counted = in_batches(encoded, run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = cut_lineage(
        counted.select("pair", F.shiftright("pair", _SHIFT).cast("int").alias("a_id"),
                       F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1)).cast("int").alias("b_id"), "n"),
        "pair-counts",
    )
    most = counted.groupBy("b_id").agg(F.max("n").alias("most"))
    return counted.join(F.broadcast(most), "b_id").select("pair", "a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best"))


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Pairs (sorted), counts and marks of the most frequent pairs, at most ``most``, and the least count among them.

    The bound is a power of two, chosen by a histogram of at most 64 rows.
    """
    bits = F.length(F.bin("n"))
    by_bits = {r[0]: r[1] for r in counts.groupBy(bits.alias("bits")).count().collect()}
    total, least = 0, 64
    for b in sorted(by_bits, reverse=True):
        total += by_bits[b]
        if total > most:
            break
        least = b
    bound = min(1 << (least - 1), (1 << 63) - 1)
    table = counts.where(F.col("n") >= F.lit(bound)).select("pair", "n", "best").toArrow()
    pairs, n, best = (table.column(i).to_numpy() for i in range(3))
    order = np.argsort(pairs)
    return pairs[order].astype(np.int64), n[order].astype(np.int64), best[order].astype(bool), bound


def _sums(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by text, exact; ``doc`` ascends."""
    before = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    bounds = np.searchsorted(doc, np.arange(n + 1))
    return np.diff(before[bounds])


def _rest(doc: np.ndarray, codes: np.ndarray, n: int) -> pa.Array:
    """Lists, one a text, of pairs with the number of links."""
    order = np.lexsort((codes, doc))
    doc, codes, times = _summed(doc[order], codes[order])
    bounds = pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32())
    entries = pa.StructArray.from_arrays([pa.array(codes, pa.int64()), pa.array(times, pa.int64())], ["pair", "times"])
    return pa.ListArray.from_arrays(bounds, entries)


def align(
    docs: DataFrame, files: Files, frequent: int = 1 << FREQUENT, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``files``: a tokenizer file (byte-level BPE, gets a space before the text), a sentencepiece model, which all
    executors have, and the pattern by which the first splits texts.  count_sum adds the corpus-wide counts of the pairs of ids of a text's
    links, n_best counts links whose pair no other pair of the same id of B outdoes.  groups_sha256 digests the groups.

    Null and empty texts, and texts that a tokenizer changes, have zeros and no digest ('').  Null keys and repeated rows
    stay rows of their own; an empty table gives an empty one; extra columns play no part; texts of any length are whole.
    Counts of the ``frequent`` most frequent pairs are held by every task (17 bytes each), links of other
    pairs are joined with theirs; what is joined is rare by construction, so no key of the join is hot.
    """
    encoded = encode(docs, files, key, text)
    counts = cut_lineage(pair_counts(encoded, files), "counts")
    pairs, n, best, bound = _frequent(counts, frequent)
    held = docs.sparkSession.sparkContext.broadcast((pairs, n, best))
    schema = pa.schema(
        [("row", pa.int64()), ("key", pa.int64())]
        + [(x, pa.int64()) for x in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
        + [("groups_sha256", pa.string()), ("rest", pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())])))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(*files)
        pairs, n, best = held.value
        for batch in _slices(batches):
            one = Batch(batch, both)
            n_links, n_best, count_sum = (np.zeros(len(batch), np.int64) for _ in range(3))
            rare = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for doc, codes in one.codes():
                place = np.minimum(np.searchsorted(pairs, codes), max(len(pairs) - 1, 0))
                hit = pairs[place] == codes if len(pairs) else np.zeros(len(codes), bool)
                n_links += np.bincount(doc, minlength=len(batch))
                n_best += _sums(doc[hit], best[place[hit]], len(batch))
                count_sum += _sums(doc[hit], n[place[hit]], len(batch))
                rare.append((doc[~hit], codes[~hit]))
            rest = _rest(*(np.concatenate(x) for x in zip(*rare, strict=True)), len(batch))
            n_groups, groups = one.group_texts()
            digests = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
            numbers = [pa.array(x, pa.int64()) for x in (one.a_n, one.b_n, n_groups, n_links, n_best, count_sum)]
            columns = [batch.column(0), batch.column(1), *numbers, pa.array(digests, pa.string()), rest]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    kinds = (
        "row long, key long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
        "groups_sha256 string, rest array<struct<pair: long, times: long>>"
    )
    done = cut_lineage(in_batches(encoded, run, kinds), "aligned")
    rare = done.select("row", F.explode("rest").alias("r")).select("row", "r.pair", "r.times")
    added = (
        rare.join(counts.where(F.col("n") < bound).select("pair", "n", "best"), "pair")
        .groupBy("row")
        .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.expr("times * n")).alias("more_sum"))
    )
    return done.join(added, "row", "left").select(
        F.col("key").alias(key),
        *("n_a", "n_b", "n_groups", "n_links"),
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )
