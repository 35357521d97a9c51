"""Document quality with a linear-chain conditional random field over lines.

Each line is good or bad; its features and those of its neighbours speak for either, and a
transition weight ties neighbouring labels.  The marginals of a forward-backward pass, weighted
by the lengths of the lines, add up to the quality of the document.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, remainder

#: Training reads about so many labelled rows, chosen by the hash of their key.
SAMPLE = 3000
#: Lines of a training document beyond which it is cut into several chains.
CHAIN = 64

FEATURES = 16

# classes of characters up to U+024F; what lies above counts as a letter without case
_UPPER, _LOWER, _DIGIT, _SPACE, _SYMBOL, _MARK = range(6)
_KIND = np.array(
    [
        _SPACE if chr(c).isspace() else _DIGIT if chr(c).isdigit() else _UPPER if chr(c).isupper() else _LOWER if chr(c).isalpha()
        else _MARK if chr(c) in ".,;:'\"-?" else _SYMBOL
        for c in range(0x250)
    ],
    np.uint8,
)


@dataclass
class Model:
    weights: np.ndarray  # of the features of previous, own and next line
    ties: np.ndarray  # [before][after], bad 0 and good 1


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of every line (lines x 3 * FEATURES) and their lengths."""
    lines = text.split("\n")
    n = len(lines)
    kind = _KIND[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 0x24F)]
    sizes = np.fromiter(map(len, lines), np.int64, n)
    starts = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
    stops = starts + sizes
    own = np.zeros((n, FEATURES))
    length = np.maximum(sizes, 1)
    for k in range(6):
        total = np.concatenate([[0], np.cumsum(kind == k)])
        own[:, k] = (total[stops] - total[starts]) / length
    # symbols and marks in runs
    odd = (kind == _SYMBOL) | (kind == _MARK)
    total = np.concatenate([[0], np.cumsum(odd[1:] & odd[:-1]), [0]]) if len(kind) > 1 else np.zeros(len(kind) + 2)
    own[:, 6] = (total[np.maximum(stops - 1, starts)] - total[starts]) / length
    times: dict[str, int] = {}
    for line in lines:
        times[line] = times.get(line, 0) + 1
    for i, line in enumerate(lines):
        words = line.split()
        if words:
            k = len(words)
            own[i, 7] = len(set(words)) / k
            own[i, 8] = sum(map(operator.eq, words, words[1:])) / k
            own[i, 9] = min(1.0, (sizes[i] / k) / 20)
            own[i, 10] = 1.0 if words[-1][-1] in ".!?" else 0.0
            own[i, 11] = 1.0 if k < 5 else 0.0
        own[i, 12] = 1.0 if times[line] > 1 and words else 0.0
    own[:, 13] = np.minimum(1.0, np.log1p(sizes) / 8)
    own[:, 14] = sizes == 0
    own[:, 15] = 1.0
    edge = np.zeros((1, FEATURES))
    return np.hstack([np.vstack([edge, own[:-1]]), own, np.vstack([own[1:], edge])]), sizes


def marginals(emission: list[float], ties: np.ndarray) -> list[float]:
    """Chance that each line is good, by forward and backward log odds."""
    (bb, bg), (gb, gg) = ties.tolist()

    def pass_on(odds: float, to_b: tuple[float, float], to_g: tuple[float, float]) -> float:
        top = odds if odds > 0 else 0.0
        g, b = math.exp(odds - top), math.exp(-top)
        return math.log((g * to_g[1] + b * to_g[0]) / (g * to_b[1] + b * to_b[0]))

    ebb, ebg, egb, egg = map(math.exp, (bb, bg, gb, gg))
    n = len(emission)
    ahead = [0.0] * n
    odds = 0.0
    for i in range(n - 2, -1, -1):
        odds = pass_on(odds + emission[i + 1], (ebb, ebg), (egb, egg))
        ahead[i] = odds
    out = []
    odds = 0.0
    for i in range(n):
        if i:
            odds = pass_on(odds, (ebb, egb), (ebg, egg))
        odds += emission[i]
        total = odds + ahead[i]
        out.append(1 / (1 + math.exp(-total)) if total > -500 else 0.0)
    return out


def score(text: str | None, model: Model) -> float:
    """Length-weighted share of good lines; 0 for a text without a character that is not white space."""
    if not text or text.isspace():
        return 0.0
    found, sizes = line_features(text)
    good = marginals(np.clip(found @ model.weights, -50, 50).tolist(), model.ties)
    return float(min(1.0, max(0.0, np.dot(good, sizes) / sizes.sum())))


def sample(docs: DataFrame, labels: DataFrame, learn: Column, key: str, text: str, size: int) -> DataFrame:
    """(k, body, label) of about ``size`` labelled rows, those with a small hash of the key."""
    rows = docs.where(learn & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("body"))
    known = labels.where(F.col("quality").isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max("quality").alias("label"))
    total = known.count()
    share = min(1.0, size / max(1, total))
    few = known.where((F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(share * (1 << 30))))
    return rows.join(few, "k").select("k", "body", "label")


def train(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", size: int = SAMPLE) -> Model:
    """Fits the field on the bounded sample; every line starts from the label of its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [line_features(t)[0].astype("<f4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], ["k", "found", "label"])

    few = sample(docs, labels, learn, key, text, size).select(F.col("k").cast("long").alias("k"), "body", F.col("label").cast("int").alias("label"))
    rows = sorted(in_batches(few, run, "k long, found binary, label int").collect(), key=lambda r: (r["k"], r["found"]))
    return fit([(np.frombuffer(r["found"], "<f4").reshape(-1, 3 * FEATURES), r["label"]) for r in rows])


def fit(chains: list[tuple[np.ndarray, int]], rounds: int = 250) -> Model:
    """Maximum likelihood with a quadratic penalty, all chains at once, padded to the longest."""
    cut = [(f[i : i + CHAIN], y, len(f)) for f, y in chains for i in range(0, len(f), CHAIN)]
    weights, ties = np.zeros(3 * FEATURES), np.zeros((2, 2))
    if not cut:
        return Model(weights, ties)
    m, steps = len(cut), max(len(f) for f, _, _ in cut)
    data, here = np.zeros((m, steps, 3 * FEATURES), np.float32), np.zeros((m, steps), bool)
    for i, (f, _, _) in enumerate(cut):
        data[i, : len(f)], here[i, : len(f)] = f, True
    label = np.array([y for _, y, _ in cut], float)
    # every document counts the same, and so do both labels together
    each = np.array([1 / n for _, _, n in cut])
    each = np.where(label == 1, each / max(1e-9, each[label == 1].sum()), each / max(1e-9, each[label == 0].sum()))
    flat = data.reshape(-1, 3 * FEATURES)
    mean_w, mean_v = np.zeros(3 * FEATURES + 4), np.zeros(3 * FEATURES + 4)
    for r in range(1, rounds + 1):
        e = (flat @ weights).reshape(m, steps)
        scores = np.stack([np.zeros_like(e), e], 2)
        ahead = np.zeros((m, steps, 2))
        back = np.zeros((m, steps, 2))
        ahead[:, 0] = scores[:, 0]
        for t in range(1, steps):
            step = np.logaddexp(ahead[:, t - 1, 0, None] + ties[0], ahead[:, t - 1, 1, None] + ties[1]) + scores[:, t]
            ahead[:, t] = np.where(here[:, t, None], step, ahead[:, t - 1])
        for t in range(steps - 2, -1, -1):
            onward = scores[:, t + 1] + back[:, t + 1]
            step = np.logaddexp(onward[:, 0, None] + ties[:, 0], onward[:, 1, None] + ties[:, 1])
            back[:, t] = np.where(here[:, t + 1, None], step, 0.0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        good = np.exp(np.minimum(0, ahead[:, :, 1] + back[:, :, 1] - total[:, None]))
        off = (label[:, None] - good) * here * each[:, None]
        slope = flat.T @ off.ravel()
        slope_t = np.zeros((2, 2))
        both = here[:, 1:]
        for a in (0, 1):
            for b in (0, 1):
                p = np.exp(np.minimum(0, ahead[:, :-1, a] + ties[a, b] + scores[:, 1:, b] + back[:, 1:, b] - total[:, None]))
                seen = (label == a)[:, None] & (a == b)
                slope_t[a, b] = ((seen - p) * both * each[:, None]).sum()
        # a strong penalty on ties: lines keep a say of their own
        g = np.concatenate([slope - 2e-4 * weights, (slope_t - 0.05 * ties).ravel()])
        mean_w = 0.9 * mean_w + 0.1 * g
        mean_v = 0.999 * mean_v + 0.001 * g * g
        move = 0.2 * (mean_w / (1 - 0.9**r)) / (np.sqrt(mean_v / (1 - 0.999**r)) + 1e-8)
        weights = weights + move[: 3 * FEATURES]
        ties = ties + move[3 * FEATURES :].reshape(2, 2)
    return Model(weights, ties)


def rate(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", cut: float = 0.7) -> DataFrame:
    """One row per row of ``docs``: key, score, predicted (1 if score >= ``cut``, else 0).

    Only the text counts.  A null, empty or blank text scores 0.  Null keys and repeated rows stay; equal
    texts score the same; whole texts are read; no rows: no rows; extra columns play no part.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score(t, held.value) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["key", "score"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("body"))
    return in_batches(rows, run, "key long, score double").select(
        F.col("key").alias(key), "score", (F.col("score") >= cut).cast("int").alias("predicted")
    )


def learned_part(key: str = "doc_id") -> Column:
    """Rows a model may learn from: crc32 of the key as text, modulo 4, is not 2."""
    return remainder(key, 4) != 2
