"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Every step keeps only the groups that more than one row shares.  The survivors of the first
two steps are marked in a bitmap of fixed size, so that the step that hashes whole texts
tests a bit per row instead of shuffling texts; a bit set by chance only costs one hash.
What is shuffled are counts and fixed-size keys, pre-combined per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_or_empty

#: Characters of the prefix, and bits of the bitmap (2**25 bits are 4 MB, the most that is broadcast).
PREFIX, BITS = 64, 2**25

#: A bitmap of bitmap_construct_agg has so many bits.
_CHUNK = 32768


def _shared(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that several rows share."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1").drop("rows")


def _bit(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BITS))


def _hashed(docs: DataFrame, text: str, prefix: int) -> DataFrame:
    """``docs`` with length, prefix hash and, for rows whose group survives both, the hash of the whole text."""
    sized = docs.withColumns(
        {
            "x_length": F.octet_length(text_or_empty(text)).cast("long"),
            "x_prefix": F.xxhash64(F.substring(text_or_empty(text), 1, prefix)),
        }
    )
    narrow = sized.select("x_length", "x_prefix")
    alike = narrow.join(_shared(narrow, "x_length"), "x_length", "left_semi")
    marks = (
        _shared(alike, "x_length", "x_prefix")
        .select(_bit("x_length", "x_prefix").alias("position"))
        .groupBy(F.floor(F.col("position") / _CHUNK).alias("x_chunk"))
        .agg(F.bitmap_construct_agg((F.col("position") % _CHUNK).cast("long")).alias("x_marks"))
    )
    # at most BITS / _CHUNK rows of 4 KB
    marked = sized.withColumn("x_bit", _bit("x_length", "x_prefix")).join(
        F.broadcast(marks), F.floor(F.col("x_bit") / _CHUNK) == F.col("x_chunk"), "left"
    )
    at = "cast(x_bit % 32768 as int)"
    byte = f"cast(conv(hex(substring(x_marks, {at} div 8 + 1, 1)), 16, 10) as int)"
    hit = F.expr(f"coalesce((shiftright({byte}, {at} % 8) & 1) = 1, false)")
    return marked.withColumn("x_full", F.when(hit, F.sha2(text_or_empty(text), 256))).drop(
        "x_bit", "x_chunk", "x_marks"
    )


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", prefix: int = PREFIX) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, and x_full (hash or null).

    Texts are equal when identical; a null text equals an empty one.  Of equal texts the row
    with the largest key stays (null keys are smallest).  A row repeated with the same key counts
    in group_size, and every such copy says kept.  Without rows the result is empty.  Other
    columns of ``docs`` play no part, whatever they are called.
    """
    rows = docs.select(F.col(key).alias("x_key"), F.col(text).alias("x_text"))
    hashed = _hashed(rows, "x_text", prefix).drop("x_text")
    groups = _groups(hashed)
    return hashed.join(groups, ["x_length", "x_full"], "left").select(
        F.col("x_key").alias(key),
        F.coalesce("x_keep", "x_key").alias("keep_id"),
        F.coalesce("x_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("x_key").eqNullSafe(F.coalesce("x_keep", "x_key")).alias("kept"),
        "x_full",
    )


def exact_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", prefix: int = PREFIX) -> DataFrame:
    """As ``exact_groups``, but with text_sha256 for every row: texts nobody shares are hashed for this column alone."""
    rows = docs.select(F.col(key).alias("x_key"), F.col(text).alias("x_text"))
    hashed = _hashed(rows, "x_text", prefix)
    shown = hashed.select(
        "x_key", "x_length", "x_full", F.coalesce("x_full", F.sha2(text_or_empty("x_text"), 256)).alias("text_sha256")
    )
    groups = _groups(hashed)
    return shown.join(groups, ["x_length", "x_full"], "left").select(
        F.col("x_key").alias(key),
        F.coalesce("x_keep", "x_key").alias("keep_id"),
        F.coalesce("x_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("x_key").eqNullSafe(F.coalesce("x_keep", "x_key")).alias("kept"),
        "text_sha256",
    )


def _groups(hashed: DataFrame) -> DataFrame:
    return (
        hashed.where("x_full IS NOT NULL")
        .groupBy("x_length", "x_full")
        .agg(F.max("x_key").alias("x_keep"), F.count("*").alias("x_size"))
        .where("x_size > 1")
    )


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", prefix: int = PREFIX) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one row for each text.

    Where a row is repeated with the same key and text, the smallest of the repeated rows stays.
    """
    names = docs.columns
    body = fresh("x_row", names)
    rows = docs.select(F.col(key).alias("x_key"), F.col(text).alias("x_text"), F.struct(*names).alias(body))
    hashed = _hashed(rows, "x_text", prefix).drop("x_text")
    # rows that no other can equal never leave their task
    alone = hashed.where("x_full IS NULL").select(body)
    alike = hashed.where("x_full IS NOT NULL")
    largest = alike.groupBy("x_length", "x_full").agg(F.max("x_key").alias("x_keep"))
    # one row remains for each key; only repeated rows meet in the last step
    several = (
        alike.join(largest, ["x_length", "x_full"])
        .where(F.col("x_key").eqNullSafe(F.col("x_keep")))
        .groupBy("x_length", "x_full")
        .agg(F.min(body).alias(body))
    )
    return alone.unionByName(several.select(body)).select(f"{body}.*")
