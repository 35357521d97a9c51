"""The same work on pages and links that keep arriving."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import urls
from ..lineage import Steps, remove
from ..operators import extraction
from ..sources import results

#: Works off what is there and ends; ``{"processingTime": "1 minute"}`` keeps a stream running.
ONCE: Mapping[str, object] = {"availableNow": True}


def parsed_stream(pages: DataFrame, news: bool = False, extract_links: bool = False) -> DataFrame:
    """Page records of arriving pages; stateless."""
    return extraction.parse_pages(pages, news, extract_links)


def start_page_stream(
    page_data: DataFrame, path: str, checkpoint: str, fmt: str = "json", trigger: Mapping[str, object] = ONCE
) -> StreamingQuery:
    """Appends each page record as soon as its page is parsed."""
    if fmt == "csv":
        sink = results.csv_rows(page_data).writeStream.format("csv").options(
            header=True, escape='"', emptyValue=""
        )
    else:
        sink = results.json_lines(page_data).select("value").writeStream.format("text")
    return (
        sink.option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**trigger)
        .start(path)
    )


FIRST = "key string, src_id bigint, link_pos int, url string"

#: Parts of the memory of the dedup stream; log2 of the bits of its filter (16 MB).
BUCKETS, FILTER_BITS = 256, 27


def _placed(keys: DataFrame) -> DataFrame:
    """Adds bucket, chunk and bit of each key; 32768 bits are a chunk."""
    place = F.col("_hash").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    return (
        keys.withColumn("_hash", F.xxhash64("key"))
        .withColumns(
            {
                "bucket": F.shiftrightunsigned("_hash", 40).bitwiseAND(F.lit(BUCKETS - 1)).cast("int"),
                "_chunk": F.shiftright(place, 15).cast("int"),
                "_bit": place.bitwiseAND(F.lit(32767)).cast("int"),
            }
        )
        .drop("_hash")
    )


def _perhaps_seen(placed: DataFrame, bits: DataFrame) -> DataFrame:
    """Rows whose bit is set; a row without is new for sure."""
    octet = F.conv(F.hex(F.substring(F.col("bits"), F.expr("_bit div 8 + 1"), F.lit(1))), 16, 10).cast("int")
    is_set = octet.bitwiseAND(F.expr("shiftleft(1, _bit % 8)")) != 0
    return placed.join(bits.withColumnRenamed("chunk", "_chunk"), "_chunk").filter(is_set)


def _opened(spark: SparkSession, path: str, number: int, buckets: list[int]) -> DataFrame:
    """Keys of earlier batches in some buckets; no file of another bucket is opened."""
    log = spark.read.schema(f"{FIRST}, batch bigint, bucket int").parquet(path)
    return log.filter((F.col("batch") < number) & F.col("bucket").isin(buckets)).select("key")


def start_dedup_stream(
    links: DataFrame, path: str, checkpoint: str, trigger: Mapping[str, object] = ONCE
) -> StreamingQuery:
    """Appends every key when it is first seen, with the link that showed it first.

    ``links``: src_id, link_pos, url, key.  Of the links in one batch the first one of the page with the smallest id counts.  The
    table is the memory: keys are never forgotten, nothing is held by executors between batches, and a batch
    that is run again replaces its own rows.  Repeats are combined before the shuffle, so a page that all
    others link to costs little.  Links without a key are left out.

    The table is cut into buckets by a hash of the key, and a filter of one bit for each key lies beside it (``path``
    + ``-filter``).  A key whose bit is not set is new; for the others only their buckets are opened.  So what a batch
    reads depends on what it may have in common with earlier ones, not on how many there were.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = _placed(
            batch.filter(F.col("key").isNotNull())
            .groupBy("key")
            .agg(F.min(F.struct("src_id", "link_pos", "url")).alias("first"))
            .select("key", "first.*")
        )
        steps = Steps(spark, "dedup")
        try:
            first = steps.cut(first, "first")
            known = None
            if number:
                bits = spark.read.schema("chunk int, bits binary").parquet(f"{path}-filter/batch={number - 1}")
                perhaps = steps.cut(_perhaps_seen(first, bits).select("key", "bucket"), "perhaps")
                buckets = sorted(r[0] for r in perhaps.select("bucket").distinct().collect())  # BUCKETS at most
                if buckets:
                    seen = _opened(spark, path, number, buckets).join(perhaps.select("key"), "key", "left_semi")
                    first = steps.cut(first.join(seen, "key", "left_anti"), "new")
                known = bits
            first.select("key", "src_id", "link_pos", "url", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(
                f"{path}/batch={number}"
            )
            new = first.groupBy(F.col("_chunk").alias("chunk")).agg(F.bitmap_construct_agg("_bit").alias("bits"))
            if known is not None:
                new = known.unionByName(new).groupBy("chunk").agg(F.bitmap_or_agg("bits").alias("bits"))
            new.write.mode("overwrite").parquet(f"{path}-filter/batch={number}")
        finally:
            steps.close()
        # the filter before the last one is of no more use, even if this batch is run again
        remove(spark, f"{path}-filter/batch={number - 2}")

    return (
        links.select("key", "src_id", F.col("link_pos").cast("int").alias("link_pos"), "url")
        .writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


SEEN = "key string, at timestamp, batch bigint"
LATE = "key string, n bigint, batch bigint"


def start_bounded_dedup_stream(
    links: DataFrame, path: str, checkpoint: str, delay_s: int = 86_400, trigger: Mapping[str, object] = ONCE
) -> StreamingQuery:
    """Appends keys when they are seen and were not within ``delay_s`` seconds of event time; late rows are counted.

    ``links``: key, at; read twice in every batch, so write links that cost much to make before.  For streams whose memory must not grow for ever: state holds the keys of the last ``delay_s``
    seconds before the newest time, in the state store of the query, and a key that comes again after that is appended
    again.  Rows older than the watermark can't be judged any more; they are counted by key in ``path`` + ``-late``, as are
    rows without a time.  Rows without a key are left out.

    Spark judges lateness in a batch by the watermark that the batch before ran with, which comes from the newest
    time of the batches before that one; these times lie beside the table (``path`` + ``-newest``).  A batch that is run
    again replaces its own rows.
    """
    timed = links.filter(F.col("key").isNotNull()).select("key", "at").withWatermark("at", f"{delay_s} seconds")
    first = timed.filter(F.col("at").isNotNull()).dropDuplicatesWithinWatermark(["key"])
    # the same rows of the same batch, once as the state lets them through and once as they came
    both = first.withColumn("first", F.lit(True)).unionByName(timed.withColumn("first", F.lit(False)))

    def newest(spark: SparkSession, number: int) -> int:
        """Milliseconds of the newest time up to a batch; 0 before the first."""
        if number < 0:
            return 0
        return spark.read.schema("newest bigint").parquet(f"{path}-newest/batch={number}").first()[0]

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        steps = Steps(spark, "bounded-dedup")
        try:
            rows = steps.cut(batch, "rows")  # the state is asked once
            came = rows.filter(~F.col("first"))
            rows.filter("first").select("key", "at").write.mode("overwrite").parquet(f"{path}/batch={number}")
            bound = max(0, newest(spark, number - 2) - delay_s * 1000)
            on_time = F.unix_micros("at") > F.lit(bound).cast("bigint") * 1000
            late = came.filter(~F.coalesce(on_time, F.lit(False))).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
            late.write.mode("overwrite").parquet(f"{path}-late/batch={number}")
            high = F.greatest(F.max(F.unix_millis("at")), F.lit(newest(spark, number - 1)).cast("bigint"))
            came.agg(high.alias("newest")).write.mode("overwrite").parquet(f"{path}-newest/batch={number}")
        finally:
            steps.close()
        # a batch that is run again needs those of the two before it
        remove(spark, f"{path}-newest/batch={number - 3}")

    return both.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def stream_stats(page_data: DataFrame, key: str = "request_id") -> DataFrame:
    """Running page and link counts; output mode ``update``."""
    return page_data.groupBy(key).agg(
        F.count(F.lit(1)).alias("pages_crawled"),
        F.sum(F.size("links")).alias("links_discovered"),
    )


REFETCH = "origin string, fetched_at timestamp"


def refetch_times(visits: DataFrame, held: DataFrame, ttl_hours: float = 24) -> DataFrame:
    """When each origin's robots file has to be fetched, given the files at hand.

    ``visits``: origin, at.  ``held``: origin, fetched_at, one row per origin.
    A visit uses the file at hand unless it is older than ``ttl_hours``; then,
    and without a file, a fetch is due at that moment and its file serves the
    visits after it.  Which visit comes to fetch depends on the one before, so the distinct times of an
    origin are read in order, once; a task holds the time of the last fetch and goes from fetch to fetch.
    Visits without an origin or a time make nothing due.
    """
    ttl = int(ttl_hours * 3600 * 1_000_000)
    dated = visits.filter(F.col("origin").isNotNull() & F.col("at").isNotNull())
    times = dated.select("origin", F.unix_micros("at").alias("t")).distinct()
    known = held.select("origin", F.unix_micros("fetched_at").alias("held"))
    ordered = times.join(known, "origin", "left").repartition("origin").sortWithinPartitions("origin", "t")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            origins, at = batch.column(0), batch.column(1).to_numpy()
            # where another origin begins, then from fetch to fetch
            other = pc.not_equal(origins.slice(1), origins.slice(0, max(len(origins) - 1, 0))).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(other) + 1, [len(at)]]) if len(at) else np.zeros(1, int)
            found, due = [], []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                origin = origins[a].as_py()
                if origin != now:
                    now, last = origin, batch.column(2)[a].as_py()
                while (i := a if last is None else a + int(np.searchsorted(at[a:b], last + ttl, "right"))) < b:
                    last = int(at[i])
                    found.append(origin)
                    due.append(last)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.string()), pa.array(due, pa.int64())], ["origin", "due"]
            )

    found = ordered.select("origin", "t", "held").mapInArrow(scan, "origin string, due bigint")
    return found.select("origin", F.timestamp_micros("due").alias("fetched_at"))


def start_robots_stream(
    visits: DataFrame,
    path: str,
    checkpoint: str,
    ttl_hours: float = 24,
    trigger: Mapping[str, object] = ONCE,
) -> StreamingQuery:
    """Appends the fetches that arriving visits (url, at) make due to a table.

    The table is the memory of the stream: the files at hand are its newest row
    per origin.  Rows older than a file's lifetime before the batch say no more
    than no row at all, so they are not read.  A batch that is run again
    replaces its own rows.  Visits without an origin or a time make nothing due and say nothing about files at hand.
    """
    named = visits.select(urls.url_origin("url").alias("origin"), "at").filter(
        F.col("origin").isNotNull() & F.col("at").isNotNull()
    )

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number == 0:
            held = spark.createDataFrame([], REFETCH)
        else:
            log = spark.read.schema(f"{REFETCH}, batch bigint").parquet(path)
            start = batch.agg(F.min("at")).first()[0]
            recent = F.col("fetched_at") >= F.lit(start).cast("timestamp") - F.make_dt_interval(
                hours=F.lit(0), secs=F.lit(ttl_hours * 3600)
            )
            held = (
                log.filter((F.col("batch") < number) & recent)
                .groupBy("origin")
                .agg(F.max("fetched_at").alias("fetched_at"))
            )
        due = refetch_times(batch, held, ttl_hours)
        due.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        named.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
