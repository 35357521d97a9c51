"""Token counts with a whole-token shortcut.

Before anything is counted, it is proven for every string of the vocabulary, by running the merges on it,
whether it encodes alone as one token.  A pre-token that is such a string counts one without merging;
only the others are merged, and their counts are remembered up to a bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import merged, parts_of, read_json
from .common import in_batches, text_or_empty

#: Merged pre-tokens that a worker remembers; beyond it forgets them and goes on.
REMEMBERED = 300_000

_counters: dict[tuple[str, str], Counter] = {}


class Counter(dict):
    """Tokens by pre-token: strings proven whole are there from the start, others are merged on demand."""

    def __init__(self, path: str, pattern: str) -> None:
        super().__init__()
        ids, merges, special = read_json(path)
        get = merges.get
        self.rank_of = lambda a, b: get((a, b))
        self.pattern = regex.compile(pattern)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.whole = self._proven(ids)
        self.update(self.whole)

    def _proven(self, ids: dict[bytes, int]) -> dict[str, int]:
        """Vocabulary strings, one per token, that are text and encode alone as one token."""
        proven = {}
        for raw in ids:
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                continue  # half a character is never a pre-token
            if self.pattern.fullmatch(text) and self.pattern.findall(text) == [text] and len(merged(raw, self.rank_of)) == 1:
                proven[text] = 1
        return proven

    def __missing__(self, word: str) -> int:
        if len(self) > len(self.whole) + REMEMBERED:
            self.forget()
        n = len(merged(word.encode(), self.rank_of))
        if len(word) <= 64:
            self[word] = n
        return n

    def forget(self) -> None:
        """Keeps only what was proven."""
        self.clear()
        self.update(self.whole)

    def count(self, text: str) -> int:
        """Special strings count one each; the text between them is split by the pattern."""
        if self.special is None:
            return self._plain(text)
        total, at = 0, 0
        for hit in self.special.finditer(text):
            total += self._plain(text[at : hit.start()]) + 1
            at = hit.end()
        return total + self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> int:
        get, words = self.__getitem__, self.pattern.findall
        return sum(sum(map(get, words(part))) for part in parts_of(text))


def counter(path: str, pattern: str) -> Counter:
    """One per worker process."""
    if (path, pattern) not in _counters:
        _counters[path, pattern] = Counter(path, pattern)
    return _counters[path, pattern]


def token_counts(
    docs: DataFrame, path: str, pattern: str, limit: int = 512, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``path`` is a tokenizer file (JSON, byte-level BPE) that every executor has, ``pattern`` splits text into pre-tokens.
    A null text counts as empty: no bytes, no tokens.  Null keys and repeated rows stay as they are; very
    long texts are worked on in parts; an empty table gives an empty one; extra columns play no part.
    """
    rows = docs.select(
        F.col(key).cast("long").alias("key"),
        text_or_empty(text).alias("body"),
        F.octet_length(text_or_empty(text)).cast("long").alias("size"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path, pattern)
        count = counts.count
        for batch in batches:
            tokens = [count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(tokens, pa.int64())], ["key", "n_bytes", "n_tokens"]
            )
        counts.forget()

    counted = in_batches(rows, run, "key long, n_bytes long, n_tokens long")
    return counted.select(
        F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
