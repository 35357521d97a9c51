"""Groups and keys beyond the bound give the same rows as small ones."""

from pyspark.sql import functions as F

from pagetrail.operators import ordered


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def hot(spark):
    """A third of the rows share one key."""
    return spark.range(600).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 17).alias("k"),
        ((F.col("id") * 7919) % 600).alias("o"),
        F.when(F.col("id") % 13 == 5, F.col("id")).alias("v"),
    )


def test_only_hot_groups_are_split(spark):
    df = hot(spark).unionByName(hot(spark).withColumn("k", F.lit(None).cast("bigint")).filter("o < 300"))
    split = ordered.row_number(df, ["k"], ["o"], "s", hot_rows=100)
    assert rows(split) == rows(ordered.row_number(df, ["k"], ["o"], "s"))
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "_part" in plan


def test_without_a_bound_nothing_runs(spark):
    group = "no-jobs"
    spark.sparkContext.setJobGroup(group, "plans only")
    df = hot(spark)
    ordered.row_number(df, ["k"], ["o"], "s")
    ordered.last_value(df, ["k"], ["o"], "v", "s")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setJobGroup("", "")


def test_running_sum_and_row_number(spark):
    df = hot(spark)
    value = F.coalesce("v", F.lit(1))
    columns = ["k", "o", "v", "s"]
    expected = rows(ordered.running_sum(df, ["k"], ["o"], value, "s").select(*columns))
    assert rows(ordered.running_sum(df, ["k"], ["o"], value, "s", 25).select(*columns)) == expected
    expected = rows(ordered.row_number(df, ["k"], ["o"], "s").select(*columns))
    assert rows(ordered.row_number(df, ["k"], ["o"], "s", 25).select(*columns)) == expected


def test_last_value(spark):
    df = hot(spark)
    columns = ["k", "o", "v", "s"]
    expected = rows(ordered.last_value(df, ["k"], ["o"], "v", "s").select(*columns).fillna(-1))
    got = rows(ordered.last_value(df, ["k"], ["o"], "v", "s", 25).select(*columns).fillna(-1))
    assert got == expected


def test_partition_count_changes_nothing(spark):
    df = hot(spark)
    expected = rows(ordered.row_number(df.repartition(1), ["k"], ["o"], "s", 25))
    assert rows(ordered.row_number(df.repartition(7), ["k"], ["o"], "s", 25)) == expected
