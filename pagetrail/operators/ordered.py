"""Ordered computations over groups of any size.

A window function sends each group to one task, where its rows stream by in order.  That is the
plain, lazy way.  Where some groups are far too large for one task, ``hot_rows`` says from which size on a
group is split: only these groups are range-partitioned by group *and* order; every task computes
its own part, and one small row per part and group carries the result over from the parts
before it.  The other groups keep the window.  Splitting has to know the groups and the ranges, so with
``hot_rows`` steps are run and written; without it nothing runs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut_lineage

_PART = "_part"


def _by_size(
    df: DataFrame,
    keys: Sequence[str],
    hot_rows: int | None,
    plain: Callable[[DataFrame], DataFrame],
    split: Callable[[DataFrame, int], DataFrame],
) -> DataFrame:
    """``plain`` for groups of up to ``hot_rows`` rows, ``split`` (with a number of parts) for the others."""
    if hot_rows is None:
        return plain(df)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > hot_rows)
    hot = cut_lineage(sizes, "hot")
    total = hot.agg(F.sum("_rows")).first()[0]
    if not total:
        return plain(df)
    same = [df[k].eqNullSafe(hot[k]) for k in keys]
    cold = plain(df.join(hot, same, "left_anti"))
    return cold.unionByName(split(df.join(hot, same, "left_semi"), 2 * -(-total // hot_rows)))


def _spread(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int) -> DataFrame:
    """Rows in ranges of (keys, order), with the number of the range.

    Written out, because the limits of the ranges are found by sampling and
    must be the same for all that is computed from them.
    """
    ranged = df.repartitionByRange(parts, *keys, *order)
    return cut_lineage(ranged.withColumn(_PART, F.spark_partition_id()), "ranges")


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    hot_rows: int | None = None,
) -> DataFrame:
    """Adds the sum of ``value`` over the rows before each row of its group."""
    until_here = (Window.unboundedPreceding, -1)

    def plain(rows: DataFrame) -> DataFrame:
        before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*until_here)
        return rows.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)).cast("bigint"))

    def split(rows: DataFrame, parts: int) -> DataFrame:
        spread = _spread(rows.withColumn("_value", value), keys, order, parts)
        here = Window.partitionBy(*keys, _PART).orderBy(*order).rowsBetween(*until_here)
        earlier = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(*until_here)
        sums = spread.groupBy(*keys, _PART).agg(F.sum("_value").alias("_sum"))
        carried = sums.withColumn("_carried", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
        own = spread.withColumn(name, F.coalesce(F.sum("_value").over(here), F.lit(0)))
        return (
            _carry(own, carried, keys)
            .withColumn(name, (F.col(name) + F.col("_carried")).cast("bigint"))
            .drop(_PART, "_value", "_carried")
        )

    return _by_size(df, keys, hot_rows, plain, split)


def _carry(rows: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with what their part takes over; null keys meet as well."""
    named = carried.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(_PART).alias("_p"), "_carried")
    same = [rows[k].eqNullSafe(named[f"_k{i}"]) for i, k in enumerate(keys)]
    met = rows.join(named, [*same, rows[_PART] == named["_p"]])
    return met.drop("_p", *(f"_k{i}" for i in range(len(keys))))


def row_number(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    hot_rows: int | None = None,
) -> DataFrame:
    """Adds the position of each row in its group, from 1."""
    counted = running_sum(df, keys, order, F.lit(1), name, hot_rows)
    return counted.withColumn(name, F.col(name) + 1)


def last_value(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
    hot_rows: int | None = None,
) -> DataFrame:
    """Adds the last non-null ``value`` up to and including each row."""
    up_to_here = (Window.unboundedPreceding, Window.currentRow)

    def plain(rows: DataFrame) -> DataFrame:
        seen = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*up_to_here)
        return rows.withColumn(name, F.last(value, ignorenulls=True).over(seen))

    def split(rows: DataFrame, parts: int) -> DataFrame:
        spread = _spread(rows, keys, order, parts)
        here = Window.partitionBy(*keys, _PART).orderBy(*order).rowsBetween(*up_to_here)
        earlier = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
        newest = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order)))
        lasts = spread.groupBy(*keys, _PART).agg(newest.alias("_last"))
        carried = lasts.withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier)).drop("_last")
        own = spread.withColumn(name, F.last(value, ignorenulls=True).over(here))
        return (
            _carry(own, carried, keys)
            .withColumn(name, F.coalesce(F.col(name), F.col("_carried")))
            .drop(_PART, "_carried")
        )

    return _by_size(df, keys, hot_rows, plain, split)
