"""URL filters: host-suffix and path-prefix expressions, met by short hash prefixes.

A rule is (host, path, verdict).  It fits an address whose host is the rule's host or lies
below it and whose path starts with the rule's path.  Every address is expanded into the
expressions ``suffix of the host + prefix of the path`` that some rule could have, i.e. of
the label counts and path lengths that occur among the rules.  Expressions and rules meet in an
equi-join on the first 32 bits of a SHA-256 digest; the full digest confirms, and among the
confirmed rules the longest one (host and path together, then the longer host) decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From there up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: key, host, path, rule (text of the rule or null), verdict.

    ``rules`` has host, path and verdict (allow or block).  Defined results: a null address or one
    without ``://`` has an empty host and path and gets the default; an empty host fits no rule.
    Repeated pages give repeated rows, null keys are kept.  Rules with a null host or verdict
    are ignored, a null path counts as empty; of rules with the same host and path, block wins.
    No rules: all default.  Other columns of either table play no part.
    """
    known = (
        rules.where("host IS NOT NULL AND host <> '' AND verdict IS NOT NULL")
        .select(
            F.translate("host", UPPER, LOWER).alias("r_host"),
            F.coalesce("path", F.lit("")).alias("r_path"),
            F.col("verdict").alias("r_verdict"),
        )
        .groupBy("r_host", "r_path")
        .agg(F.max("r_verdict").alias("r_verdict"))
        .withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path")))
        .withColumn("r_short", F.substring("r_digest", 1, 8))
    )
    # the pairs (labels, path length) of all rules, as one array
    shapes = known.agg(
        F.collect_set(F.struct(F.size(F.split("r_host", r"\.")).alias("labels"), F.length("r_path").alias("length")))
    ).scalar()
    parts = pages.select(
        F.col(key).alias("page_key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    )
    expressions = (
        parts.where("host <> ''")
        .select("host", "path")
        .distinct()
        .select("host", "path", F.explode(shapes).alias("shape"))
        .where((F.size(F.split("host", r"\.")) >= F.col("shape.labels")) & (F.length("path") >= F.col("shape.length")))
        .select(
            "host",
            "path",
            F.expr("sha2(concat(substring_index(host, '.', -shape.labels), '\n', substring(path, 1, shape.length)), 256)").alias(
                "digest"
            ),
        )
        .withColumn("short", F.substring("digest", 1, 8))
    )
    decided = (
        expressions.join(known, (F.col("short") == F.col("r_short")))
        .where(F.col("digest") == F.col("r_digest"))
        .groupBy("host", "path")
        .agg(
            F.max(
                F.struct(
                    (F.length("r_host") + F.length("r_path")).alias("size"),
                    F.length("r_host").alias("host_size"),
                    F.concat("r_host", "r_path").alias("rule"),
                    F.col("r_verdict").alias("verdict"),
                )
            ).alias("best")
        )
    )
    return parts.join(decided, ["host", "path"], "left").select(
        F.col("page_key").alias(key),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
