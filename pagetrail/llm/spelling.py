"""Spelling variants: words one edit apart, found with a bit-sliced position index.

For every (position, letter) the index holds a bitset of the words with that letter there.  A query word is read
letter by letter; four bitsets follow it at once: words that matched so far without an error, and words with
one error, by the shift it left behind (replaced: none, missing in the word: -1, extra in the word: +1).
Each letter costs a few word-parallel operations for all indexed words.

One index over a whole vocabulary grows too large, so words meet in regions: of two words one edit apart, either
the first half or the last half of the letters is the same.  Regions that are still too large are
halved again in what may differ, until at most two letters of a word are free.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, in_batches

#: Runs of letters, after A-Z became lower case.
_RUN = re.compile("[a-zÀ-ÿ]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

#: One run of a document in so many loses a letter.
EVERY = 199
LETTERS, OCCURRENCES, TIMES = 6, 5, 5

#: Members of a region beyond which it is halved again; words of a block, which is indexed at once; letters of a block.
REGION, BLOCK, BLOCK_LETTERS = 4096, 4096, 1 << 22
#: Queries read at once; bytes of bitsets beyond which they are built anew for each slice of queries.
QUERIES, KEPT_BYTES = 512, 1 << 25
#: Words a task counts before it passes its counts on.
COUNTED = 1 << 20


def words_of(key: int | None, text: str, every: int = EVERY) -> list[tuple[str, int]]:
    """Words of one document with their occurrences, a letter of some runs deleted; a word may come twice."""
    runs = Counter(_RUN.findall(text.encode().translate(_LOWER).decode()))
    start = zlib.crc32(f"{'' if key is None else key}:".encode())
    found = []
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        found.append((run, n))
    return found


def vocabulary(
    docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(word, n): words of at least so many letters and occurrences over all rows of ``docs``.

    A null text has no words, a null key counts as empty text, repeated rows count each.  Tasks count in a bounded
    table of words and pass it on when it is full; the counts are added by word.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("body")).where("body is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def out() -> Iterator[pa.RecordBatch]:
            words = list(counts)
            for at in range(0, len(words), 1 << 16):
                part = words[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.string()), pa.array([counts[w] for w in part], pa.int64())], ["word", "n"]
                )
            counts.clear()

        for batch in batches:
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in words_of(k, body):
                    if len(word) >= letters:
                        counts[word] = counts.get(word, 0) + n
                if len(counts) > COUNTED:
                    yield from out()
        yield from out()

    counted = in_batches(rows, run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


# Regions


def _halved(rows: DataFrame) -> DataFrame:
    """Each row in two smaller regions: more of the beginning is the same, or more of the end.

    A region (longest, ahead, behind, shared) has words of ``longest`` letters or one less that share the first
    ``ahead`` and the last ``behind`` letters.  What is between may differ; of the shorter words that are
    ``longest - 1 - ahead - behind`` letters.
    """
    half = "(longest - 1 - ahead - behind) div 2"
    rest = f"(longest - 1 - ahead - behind - {half})"
    both = rows.select(
        "word",
        "n",
        "longest",
        F.explode(
            F.expr(f"array(struct(ahead + {half} as ahead, behind as behind), struct(ahead as ahead, behind + {rest} as behind))")
        ).alias("zone"),
    )
    return both.select(
        "word",
        "n",
        "longest",
        F.col("zone.ahead").cast("int").alias("ahead"),
        F.col("zone.behind").cast("int").alias("behind"),
        F.expr("concat(left(word, int(zone.ahead)), '|', right(word, int(zone.behind)))").alias("shared"),
    )


_REGION = ["longest", "ahead", "behind", "shared"]


def regions(words: DataFrame, most: int = REGION) -> DataFrame:
    """Rows (word, n, region) such that any two words one edit apart share a region, and no region of
    more than ``most`` words has more than two free letters.  Regions of one word are left out."""
    size = F.length("word")
    whole = words.select(
        "word", "n", F.explode(F.array(size, size + 1)).alias("longest"), F.lit(0).alias("ahead"), F.lit(0).alias("behind")
    )
    rows = cut_lineage(_halved(whole), "regions")
    done = None
    while True:
        sizes = rows.groupBy(*_REGION).agg(F.count("*").alias("members"))
        free = F.expr("longest - 1 - ahead - behind")
        large = (F.col("members") > most) & (free > 1)
        sized = cut_lineage(rows.join(sizes.where("members > 1").withColumn("large", large), _REGION), "regions")
        fit = sized.where("not large").select("word", "n", *_REGION)
        done = fit if done is None else done.union(fit)
        if not sized.where("large").limit(1).count():
            return done
        rows = cut_lineage(_halved(sized.where("large")), "regions")


# The index


class Index:
    """Bitsets of indexed words by position and letter, and by size; 64 words a lane."""

    def __init__(self, words: list[str]) -> None:
        self.n = len(words)
        self.lanes = -(-self.n // 64)
        sizes = np.array([len(w) for w in words])
        self.width = int(sizes.max())
        points = _points(words, self.width)
        self.alphabet = np.union1d([0], points)  # 0: no letter
        self.codes = np.searchsorted(self.alphabet, points)
        self.by_size = self._packed(sizes[None, :] == np.arange(self.width + 2)[:, None])
        self.everything = self._packed(np.ones((1, self.n), bool))[0]
        self.kept: dict[int, np.ndarray] | None = {}
        if self.width * len(self.alphabet) * self.lanes * 8 > KEPT_BYTES:
            self.kept = None

    def _packed(self, flags: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(flags), self.lanes * 64), bool)
        padded[:, : self.n] = flags
        return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)

    def position(self, p: int) -> np.ndarray:
        """Bitsets by letter of the words that have it at position ``p``; the one of "no letter" is empty."""
        if self.kept is not None and p in self.kept:
            return self.kept[p]
        if 0 <= p < self.width:
            bits = self._packed(self.codes[:, p][None, :] == np.arange(len(self.alphabet))[:, None])
            bits[0] = 0
        else:
            bits = np.zeros((len(self.alphabet), self.lanes), np.uint64)
        if self.kept is not None:
            self.kept[p] = bits
        return bits

    def of_size(self, size: int) -> np.ndarray:
        return self.by_size[size if 0 <= size <= self.width else self.width + 1]

    def one_edit(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places (query, indexed word) of all pairs exactly one insertion, deletion or replacement apart."""
        sizes = np.array([len(w) for w in queries])
        longest = int(sizes.max())
        points = _points(queries, longest)
        codes = np.searchsorted(self.alphabet, points)
        known = self.alphabet[np.minimum(codes, len(self.alphabet) - 1)] == points
        codes = np.where(known, codes, 0)  # a letter no indexed word has leads nowhere

        exact = np.tile(self.everything, (len(queries), 1))
        replaced, missing, extra, result = (np.zeros_like(exact) for _ in range(4))
        before, here, after = self.position(-1), self.position(0), self.position(1)
        for p in range(longest + 1):
            ending = np.flatnonzero(sizes == p)
            if len(ending):
                result[ending] = (
                    (replaced[ending] & self.of_size(p))
                    | (missing[ending] & self.of_size(p - 1))
                    | ((extra[ending] | exact[ending]) & self.of_size(p + 1))
                )
            if p == longest:
                break
            letter = codes[:, p]
            match = here[letter]
            there = np.bitwise_or.reduce(here, axis=0)
            extra = (extra | exact) & after[letter]  # a letter of the word is passed over before this one
            missing = (missing & before[letter]) | exact  # this letter is passed over
            replaced = (replaced & match) | (exact & there & ~match)
            exact = exact & match
            before, here, after = here, after, self.position(p + 2)
        flags = np.unpackbits(result.view(np.uint8), axis=1, bitorder="little")
        return np.nonzero(flags[:, : self.n])


def _points(words: list[str], width: int) -> np.ndarray:
    """Letters by word and position as code points; 0 beyond the end."""
    return np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width)


def near_pairs(words: list[str]) -> Iterator[tuple[list[str], list[str]]]:
    """All ordered pairs of ``words`` (distinct, not empty) that are one edit apart.

    Queries and indexed words are taken in slices of as many as their length allows, so memory is bounded; words of a like length share a slice.
    """
    words = sorted(words, key=len)
    if len(words) < 2:
        return
    step = max(64, BLOCK_LETTERS // len(words[-1]))
    for i in range(0, len(words), step):
        index = Index(words[i : i + step])
        for q in range(0, len(words), min(step, QUERIES)):
            asked = words[q : q + min(step, QUERIES)]
            if len(asked[0]) > index.width + 1 or len(asked[-1]) + 1 < len(words[i]):
                continue  # all too long or too short
            found, near = index.one_edit(asked)
            yield [asked[j] for j in found], [words[i + j] for j in near]


def near_words(words: DataFrame, most: int = REGION) -> DataFrame:
    """(word, n) to (word, n, near, near_n), a row for each ordered pair of words one edit apart.  Nothing else of the pairs of a region leaves a task."""
    rows = regions(words, most)
    dealt = rows.repartition(*_REGION).sortWithinPartitions(*_REGION).select(F.struct(*_REGION).alias("region"), "word", "n")
    dealt = dealt.select(F.xxhash64("region").alias("region"), F.length("word").alias("size"), "word", "n")
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Regions follow each other; whole ones are put together until a block is full.

        A block may hold a word twice, and finds pairs of different regions, too: they are as near as others.
        """
        held: dict[str, int] = {}
        longest, now = 0, None
        for batch in batches:
            for region, size, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if region != now and (len(held) >= BLOCK or (len(held) + 64) * max(longest, size) > BLOCK_LETTERS):
                    yield from indexed(held)
                    held, longest = {}, 0
                now, longest = region, max(longest, size)
                held[word] = n
        yield from indexed(held)

    def indexed(held: dict[str, int]) -> Iterator[pa.RecordBatch]:
        for words, near in near_pairs(list(held)):
            columns = [words, [held[w] for w in words], near, [held[w] for w in near]]
            if words:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    found = in_batches(dealt, run, "word string, n long, near string, near_n long")
    # a pair may be met in several regions; both steps share one exchange
    return found.repartition("word").dropDuplicates(["word", "near"])


def _followed(forms: DataFrame) -> DataFrame:
    """(word, form) to (word, root) by pointer doubling: each round doubles the steps taken.

    Along a chain counts grow by a factor, so it has no circle and is short.
    """
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = cut_lineage(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not joined.where("moved").limit(1).count():
            return joined.select("word", "root")
        now = joined.select("word", "root")


def variants(words: DataFrame, times: int = TIMES, most: int = REGION) -> DataFrame:
    """Groups the spellings of a vocabulary (word, n): one row per word with form, root, n, n_near, form_n.

    n_near is the number of words one edit apart.  ``form`` is the one of them with most occurrences (ties: the
    smallest in code-point order) if it has at least ``times`` as many as the word, else null; ``root``
    is what following forms leads to, the word itself if it has none.  Words are distinct and not null.
    An empty vocabulary gives an empty table; extra columns play no part.
    """
    words = cut_lineage(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    summary = near_words(words, most).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    fits = F.expr(f"-best.less >= {times} * n")
    summary = cut_lineage(
        summary.select(
            "word",
            "n_near",
            F.when(fits, F.col("best.near")).alias("form"),
            F.when(fits, -F.col("best.less")).alias("form_n"),
        ),
        "near",
    )
    roots = _followed(summary.where("form is not null"))
    return (
        words.join(summary, "word", "left")
        .join(roots, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", _zero("n_near"), "form_n")
    )


def _zero(name: str) -> Column:
    return F.coalesce(name, F.lit(0).cast("long")).alias(name)


def variant_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``variants`` of the vocabulary of ``docs``."""
    return variants(vocabulary(docs, key=key, text=text))
