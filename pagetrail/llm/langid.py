"""Language identification with error-correcting output codes.

Every language has a codeword.  One binary classifier per bit, over hashed character n-grams,
predicts it; loss-weighted decoding takes the language whose codeword costs least, and a text whose
two best languages cost nearly the same is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, remainder

#: Buckets of hashed n-grams (one to three characters in UTF-8 bytes).
BUCKETS = 2048
#: Training reads at most so many distinct labelled texts for each language, chosen by hash.
SAMPLE = 400
#: Below this difference of costs, relative to the largest possible one, a text is ambiguous.
AMBIGUOUS = 0.05
#: Bytes of text that are hashed at once.
PART = 1 << 16

_EDGE = 0x20


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # BUCKETS x bits
    bias: np.ndarray

    def decide(self, counts: np.ndarray) -> tuple[str, float, bool]:
        """Language, score in (0, 1], ambiguous."""
        margin = features(counts) @ self.weights + self.bias
        # logistic loss of each bit; sure bits weigh more than doubtful ones
        weight = np.abs(np.tanh(margin / 2)) + 1e-9
        loss = np.logaddexp(0.0, -self.codes * margin) @ weight
        chance = np.exp(loss.min() - loss)
        order = np.argsort(loss, kind="stable")
        score = float(1.0 / chance.sum())
        near = len(loss) > 1 and (loss[order[1]] - loss[order[0]]) <= AMBIGUOUS * max(loss.max(), 1e-9)
        return self.languages[order[0]], score, bool(near)


def codewords(n: int) -> np.ndarray:
    """The exhaustive code for up to 7 languages, else a random dense one; rows differ in about half of the bits."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 7:
        columns = [[1 if (j >> i) & 1 == 0 else -1 for i in range(n)] for j in range(1 << n) if j % 2 == 0 and 0 < j]
        return np.array(columns, float).T
    return np.random.default_rng(n).choice([-1.0, 1.0], (n, 10 * int(np.ceil(np.log2(n)))))


def gram_counts(text: str) -> np.ndarray:
    """How often each bucket occurs in the whole text: lower-cased letters, everything else one blank."""
    data = text.lower().encode()
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), PART):
        part = np.frombuffer(data[max(0, at - 2) : at + PART], np.uint8).astype(np.uint32)
        letter = (part >= 128) | ((part >= 97) & (part <= 122))
        part = np.where(letter, part, _EDGE)
        grams = [part, part[1:] * np.uint32(257) + part[:-1], (part[2:] * np.uint32(257) + part[1:-1]) * np.uint32(263) + part[:-2]]
        for size, g in enumerate(grams):
            g = (g + np.uint32(size)) * np.uint32(2654435761)
            total += np.bincount(g >> np.uint32(21), minlength=BUCKETS)
    return total


def features(counts: np.ndarray) -> np.ndarray:
    """Square roots of shares, so that the length of a text doesn't matter."""
    return np.sqrt(counts / max(1, counts.sum()))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def sample(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", size: int = SAMPLE) -> DataFrame:
    """(language, counts): distinct texts of each language of those that ``learn`` admits, about 1.5 * ``size`` of smallest hash."""
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("language"), F.col(text).alias("body"), F.xxhash64(text).alias("h")
    )
    # one count of distinct texts for each language gives the bound on the hash; only what is under it is gathered
    counts = rows.select("language", "h").distinct().groupBy("language").count().collect()
    if not counts:
        return _counted(rows.limit(0))
    most = {r["language"]: int(2**64 * min(1.0, 1.5 * (size + 50) / r["count"])) - 2**63 - 1 for r in counts}
    bound = F.create_map(*[F.lit(x) for pair in most.items() for x in pair])
    return _counted(rows.where(F.col("h") <= bound[F.col("language")]))


def _counted(few: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()  # no more than the bound on the hash admits
        for batch in batches:
            new = []
            for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new.append(pair not in seen)
                seen.add(pair)
            batch = batch.filter(pa.array(new, pa.bool_()))
            counts = [gram_counts(t).astype("<u4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.binary())], ["language", "h", "counts"])

    return in_batches(few.select("language", "h", "body"), run, "language string, h long, counts binary").dropDuplicates(["language", "h"])


def train(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", size: int = SAMPLE) -> Model:
    """Fits one logistic classifier per bit on the bounded sample."""
    rows = sorted(sample(docs, learn, text, lang, size).collect(), key=lambda r: (r["language"], r["h"]))
    taken: dict[str, int] = {}
    names, x = [], []
    for r in rows:
        if taken.setdefault(r["language"], 0) < size:
            taken[r["language"]] += 1
            names.append(r["language"])
            x.append(features(np.frombuffer(r["counts"], "<u4")).astype(np.float32))
    languages = sorted(set(names))
    codes = codewords(len(languages))
    if not languages:
        return Model([], codes, np.zeros((BUCKETS, 1)), np.zeros(1))
    data = np.array(x, np.float32)
    target = codes[[languages.index(n) for n in names]]
    weights, bias = np.zeros((BUCKETS, codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    target = target.astype(np.float32)
    speed_w, speed_b = np.zeros_like(weights), np.zeros_like(bias)
    for _ in range(300):
        slope = -target / (1 + np.exp(np.clip(target * (data @ weights + bias), -30, 30))) / len(data)
        speed_w = 0.9 * speed_w - 4.0 * (data.T @ slope + 1e-5 * weights)
        speed_b = 0.9 * speed_b - 1.0 * slope.sum(0)
        weights += speed_w
        bias += speed_b
    return Model(languages, codes, weights, bias)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, lang_pred, score (0 to 1), ambiguous.

    A null text, an empty one and one without a letter are ``und`` with score 0, as is every text if
    nothing was learned.  Ties go to the language first in order, and are ambiguous.  Null keys and repeated
    rows stay; whole texts are read, in parts; no rows: no rows; extra columns play no part.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide, known = held.value.decide, bool(held.value.languages)
        for batch in batches:
            found = [
                decide(gram_counts(t)) if known and has_letter(t) else ("und", 0.0, False) for t in batch.column(1).to_pylist()
            ]
            pred, score, near = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(near, pa.bool_())],
                ["key", "lang_pred", "score", "ambiguous"],
            )

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("body"))
    return in_batches(rows, run, "key long, lang_pred string, score double, ambiguous boolean").withColumnRenamed("key", key)


def learned_part(key: str = "doc_id") -> Column:
    """Rows a model may learn from: crc32 of the key as text, modulo 5, is not 0."""
    return remainder(key, 5) != 0


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text isn't ``und``, with all columns: only texts without a letter go, or all if nothing was learned."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bool(held.value.languages)
        for batch in batches:
            keep = [known and has_letter(t) and held.value.decide(gram_counts(t))[0] != "und" for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return in_batches(docs, run, schema)
