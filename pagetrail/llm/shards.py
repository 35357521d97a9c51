"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered in the order of their content, so that neither files nor partitions matter.  A keyed
permutation of 0..n-1 gives each number its place in the shuffle; the place says shard and slot, and the
inverse permutation says which row lies in a slot.  Nothing but the number of rows has to be known.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _bound_batches, _importable, cut_lineage, fresh, text_or_empty

ROUNDS = 6
#: Odd multipliers of the round function; the first one also spreads the keys of the rounds.
MIX, STIR = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
_MASK = (1 << 64) - 1


def round_keys(seed: int) -> list[int]:
    return [(seed + 1 + i) * MIX & _MASK for i in range(ROUNDS)]


def sides(total: int) -> tuple[int, int]:
    """Both sides of the square-like rectangle of at least ``total`` cells that the network permutes."""
    a = max(1, int(np.ceil(np.sqrt(total))))
    while a * a < total:  # the root of a large number is rounded
        a += 1
    return a, max(1, -(-total // a))


def _stirred(half: np.ndarray, key: int) -> np.ndarray:
    x = (half ^ np.uint64(key)) * np.uint64(STIR)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(MIX)
    return x >> np.uint64(32)


def _network(x: np.ndarray, a: int, b: int, keys: Sequence[int], back: bool) -> np.ndarray:
    """One pass: each round adds a function of one half to the other, modulo its side; ``back`` undoes it."""
    left, right = x // np.uint64(b), x % np.uint64(b)
    rounds = list(enumerate(keys))
    for i, key in reversed(rounds) if back else rounds:
        if i % 2:
            side, add = np.uint64(b), _stirred(left, key) % np.uint64(b)
            right = (right + (side - add if back else add)) % side
        else:
            side, add = np.uint64(a), _stirred(right, key) % np.uint64(a)
            left = (left + (side - add if back else add)) % side
    return left * np.uint64(b) + right


def permuted(numbers: np.ndarray, total: int, seed: int, back: bool = False) -> np.ndarray:
    """Places of row numbers below ``total``, or with ``back`` the row numbers of places.

    What falls into the cells beyond ``total`` walks on along its cycle until it is inside.
    """
    a, b = sides(total)
    keys = round_keys(seed)
    x = _network(np.asarray(numbers).astype(np.uint64), a, b, keys, back)
    while (outside := np.flatnonzero(x >= np.uint64(total))).size:
        x[outside] = _network(x[outside], a, b, keys, back)
    return x.astype(np.int64)


def locate(numbers: Sequence[int], total: int, shards: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of row numbers, without looking at any row."""
    place = permuted(np.asarray(numbers), total, seed)
    return place % shards, place // shards


def number_at(shard: int, slot: int, total: int, shards: int, seed: int = 0) -> int | None:
    """Row number in a slot of a shard; None where the shard has no such slot."""
    place = slot * shards + shard
    if not (0 <= shard < shards and 0 <= slot and place < total):
        return None
    return int(permuted(np.array([place]), total, seed, back=True)[0])


def place_of(number: Column, total: Column, seed: int) -> Column:
    """``permuted`` on columns; ``total`` is the same in all rows."""

    @F.pandas_udf("long")
    def place(numbers: pd.Series, totals: pd.Series) -> pd.Series:
        if not len(numbers):
            return pd.Series([], dtype="int64")
        return pd.Series(permuted(numbers.to_numpy(), int(totals.iloc[0]), seed))

    return place(number, total)


def shard(
    docs: DataFrame,
    shards: int = 24,
    seed: int = 13,
    key: str = "doc_id",
    text: str = "text",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """All rows of ``docs`` with size, text_crc32, law, shard, slot and grown_shard.

    ``keep`` names the columns to carry (default: all).  size is the UTF-8 length of the text plus 8,
    text_crc32 its unsigned checksum, law always ``rows``: counts of shards differ by one at most, slots run from 0
    without a gap.  Under this law a further shard moves most rows, so grown_shard is null.

    Row numbers follow (key, size, checksum), nulls first, then a hash of the text; rows alike in all of these
    (repeated rows) are numbered in any order, which the result doesn't show but for carried columns.  A null text
    counts as empty.  An empty table gives an empty one.  Columns of ``docs`` with the name of a new one are
    replaced; other extra columns play no part.  Equal rows are spread by a stored random number, so a group of
    copies lands in as many tasks as its size asks for.
    """
    spark = docs.sparkSession
    keep = list(docs.columns if keep is None else keep)
    new = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    keep = [c for c in keep if c.lower() not in new]
    inner = lambda name: fresh(name, [*keep, *new])
    order, check, spread, part, at, first, total, place = map(
        inner, ("x_key", "x_hash", "x_spread", "x_part", "x_at", "x_first", "x_total", "x_place")
    )
    body = text_or_empty(text)
    rows = docs.select(
        *(F.col(f"`{c}`") for c in keep),
        (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.col(f"`{key}`").alias(order),
        F.xxhash64(body).alias(check),
        F.rand(seed).alias(spread),
    )
    # written, so that sampling and dealing see the same random numbers, and texts are read once
    rows = cut_lineage(rows, "shard-rows")
    by = [F.col(c) for c in (order, "size", "text_crc32", check, spread)]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    counter = F.monotonically_increasing_id()  # number of the partition, then the place in it
    numbered = dealt.select(
        *(F.col(f"`{c}`") for c in (*keep, "size", "text_crc32")), F.shiftright(counter, 33).alias(part),
        counter.bitwiseAND(F.lit((1 << 33) - 1)).alias(at),
    )
    numbered = cut_lineage(numbered, "shard-numbers")
    counts = {r[0]: r[1] for r in numbered.groupBy(part).count().collect()}  # one row a partition
    starts, before = [], 0
    for i in sorted(counts):
        starts.append((i, before))
        before += counts[i]
    offsets = spark.createDataFrame(starts, f"{part} long, {first} long")
    _bound_batches(spark)
    _importable(spark)
    placed = (
        numbered.join(F.broadcast(offsets), part)
        .withColumn(total, F.lit(before).cast("long"))
        .withColumn(place, place_of(F.col(first) + F.col(at), F.col(total), seed))
    )
    return placed.select(
        *(F.col(f"`{c}`") for c in (*keep, "size", "text_crc32")),
        F.lit("rows").alias("law"),
        (F.col(place) % shards).cast("int").alias("shard"),
        F.expr(f"{place} div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(placed: DataFrame, path: str) -> None:
    """Writes what ``shard`` returned as one folder a shard, in files of slots in order.

    Files are cut by ranges of (shard, slot): any number of tasks write one shard, and no row waits for another shard.
    """
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
