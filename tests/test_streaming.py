import datetime as dt

from pyspark.sql import functions as F

from pagetrail.operators import extraction
from pagetrail.sources import results, tables
from pagetrail.streaming import jobs


def put(spark, folder, number, rows):
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(
        f"{folder}/{number}-pages.parquet"
    )


def batch(first, n=6):
    return [
        (i, f"http://h{i % 2}/{i}", f"<title>{i}</title><p>x<a href=/{i % 4}><a href=/{i}?q>")
        for i in range(first, first + n)
    ]


def test_pages_restart_from_checkpoint(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        pages = tables.stream_pages(spark, f"{folder}/*", files_per_batch=1)
        records = jobs.parsed_stream(pages, extract_links=True)
        jobs.start_page_stream(records, out, str(tmp_path / "c")).awaitTermination()
        return results.read_results(spark, out)

    put(spark, folder, 1, batch(0))
    assert run().count() == 6
    put(spark, folder, 2, batch(6))
    got = run()
    whole = extraction.parse_pages(spark.read.parquet(f"{folder}/*"), extract_links=True)
    expected = whole.select("url", "title", "content", "links")
    assert sorted(map(tuple, got.select("url", "title", "content", "links").collect())) == sorted(
        map(tuple, expected.collect())
    )
    csv = str(tmp_path / "csv")
    records = jobs.parsed_stream(tables.stream_pages(spark, f"{folder}/*"))
    jobs.start_page_stream(records, csv, str(tmp_path / "c2"), "csv").awaitTermination()
    assert spark.read.csv(csv, header=True, escape='"', multiLine=True).count() == 12


def test_dedup_over_batches(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for number in (1, 2):
        put(spark, folder, number, batch(6 * number))
        edges = extraction.link_edges(tables.stream_pages(spark, f"{folder}/*", files_per_batch=1))
        jobs.start_dedup_stream(edges, out, out + "-c").awaitTermination()
    got = {r.key: r.url for r in spark.read.schema(jobs.FIRST).parquet(out).collect()}
    assert spark.read.parquet(out).count() == len(got)
    edges = extraction.link_edges(spark.read.parquet(f"{folder}/*")).orderBy("src_id", "link_pos").collect()
    expected = {}
    for r in edges:
        expected.setdefault(r.key, r.url)
    assert got == expected


def test_what_dedup_reads_does_not_grow(spark, tmp_path, monkeypatch):
    """Twelve batches of new keys and a few old ones: the log grows, what is read of it stays about the same."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "key string, src_id bigint, link_pos int, url string"
    read, plain = [], jobs._opened

    def opened(session, path, number, buckets):
        found = plain(session, path, number, buckets)
        files = {f.split("bucket=")[1].split("/")[0] for f in found.inputFiles()}
        assert len(found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")) > 1
        read.append((number, len(buckets), found.count(), len(files)))
        return found

    monkeypatch.setattr(jobs, "_opened", opened)
    everything = []
    for number in range(12):
        rows = [(f"k{number}-{i}", number, i, f"u{number}-{i}") for i in range(200)]
        rows += [(f"k{max(number - 1, 0)}-{i}", number, 500 + i, "again") for i in range(3)] + [(None, number, 0, "no key")]
        everything += rows
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{number}")
        arriving = spark.readStream.schema(schema).parquet(f"{folder}/*")
        jobs.start_dedup_stream(arriving, out, out + "-c").awaitTermination()
    got = spark.read.schema(schema).parquet(out).collect()
    first = {}
    for key, src, pos, url in everything:
        if key is not None and (key not in first or (src, pos) < first[key][:2]):
            first[key] = (src, pos, url)
    assert {r.key: (r.src_id, r.link_pos, r.url) for r in got} == first and len(got) == len(first) == 2400
    # three old keys open three buckets of 256, whatever the log holds
    assert len(read) == 11 and all(b <= 4 for _, b, _, _ in read) and max(n for *_, n, _ in read) < 60
    filters = [p.name for p in (tmp_path / "out-filter").iterdir()]
    assert sorted(filters) == ["batch=10", "batch=11"]


def test_dedup_batch_run_again(spark, tmp_path):
    """A batch whose end was not recorded is run again and replaces its rows and its filter."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "key string, src_id bigint, link_pos int, url string"

    def arrive(number, keys):
        spark.createDataFrame([(k, number, 0, f"{k}{number}") for k in keys], schema).write.parquet(f"{folder}/{number}")
        jobs.start_dedup_stream(spark.readStream.schema(schema).parquet(f"{folder}/*"), out, out + "-c").awaitTermination()

    arrive(0, "abc")
    arrive(1, "bcd")
    (tmp_path / "out-c" / "commits" / "1").unlink()
    (tmp_path / "out-c" / "commits" / ".1.crc").unlink(missing_ok=True)
    arrive(2, "ade")
    assert sorted(r.url for r in spark.read.schema(schema).parquet(out).collect()) == ["a0", "b0", "c0", "d1", "e2"]


def test_bounded_dedup_counts_late_rows(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    day = dt.datetime(2024, 1, 1)
    schema = "key string, at timestamp"
    parts = [
        [("a", 0), ("a", 1), ("b", 60), (None, 70)],
        [("a", 20), ("c", 90), ("c", None)],  # 'a' is at hand still
        [],
        [("a", 100), ("b", 30), ("d", 10), ("d", 29)],  # watermark at 30: 'b' and 'd' are late
        [("e", 39), ("d", 41), ("f", 41), ("g", 200)],  # watermark at 40
        [("a", 150)],  # watermark at 140: 'a' is forgotten
    ]
    dropped = 0
    for number, rows in enumerate(parts):
        timed = [(k, None if m is None else day + dt.timedelta(minutes=m)) for k, m in rows]
        spark.createDataFrame(timed, schema).coalesce(1).write.parquet(f"{folder}/{number}")
        arriving = spark.readStream.schema(schema).parquet(f"{folder}/*")
        query = jobs.start_bounded_dedup_stream(arriving, out, out + "-c", 3600)
        query.awaitTermination()
        dropped += sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
    seen = [(r.key, int((r.at - day).total_seconds()) // 60) for r in spark.read.schema(jobs.SEEN).parquet(out).collect()]
    assert sorted(x for x in seen if x[0] != "a") == [("b", 60), ("c", 90), ("d", 41), ("f", 41), ("g", 200)]
    again = sorted(m for k, m in seen if k == "a")
    assert len(again) == 2 and again[0] in (0, 1) and again[1] == 150
    late = {(r.key, r.n) for r in spark.read.schema(jobs.LATE).parquet(out + "-late").collect()}
    # the row without a time counts as late here, though Spark never drops it
    assert late == {("c", 1), ("b", 1), ("d", 2), ("e", 1)}
    assert dropped == 4


def test_a_stream_can_keep_running(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, folder, 1, batch(0))
    edges = extraction.link_edges(tables.stream_pages(spark, f"{folder}/*"))
    query = jobs.start_dedup_stream(edges, out, out + "-c", {"processingTime": "1 second"})
    try:
        query.processAllAvailable()
        before = spark.read.parquet(out).count()
        put(spark, folder, 2, batch(6))
        query.processAllAvailable()
        assert query.isActive and spark.read.parquet(out).count() > before
    finally:
        query.stop()


def test_a_year_of_visits_takes_one_pass(spark):
    day = dt.datetime(2024, 1, 1)
    visits = spark.range(4000).selectExpr("concat('http://h', id % 3) AS origin", "timestamp_micros(1704067200000000 + (id * 7919 % 4000) * 7884000000) AS at")
    held = spark.createDataFrame([("http://h1", day + dt.timedelta(days=3))], jobs.REFETCH)
    got = {}
    for r in jobs.refetch_times(visits, held).collect():
        got.setdefault(r.origin, []).append(r.fetched_at)
    at = {}
    for r in visits.collect():
        at.setdefault(r.origin, []).append(r.at)
    for origin, times in at.items():
        last = day + dt.timedelta(days=3) if origin == "http://h1" else None
        expected = []
        for t in sorted(times):
            if last is None or t - last > dt.timedelta(days=1):
                last = t
                expected.append(t)
        assert sorted(got[origin]) == expected and len(expected) > 200


def test_robots_cache(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    day, hour = dt.datetime(2024, 1, 1), dt.timedelta(hours=1)

    def visits(number, hours):
        rows = [("http://h/x", day + h * hour) for h in hours] + [("http://g/", day)]
        df = spark.createDataFrame(rows, "url string, at timestamp")
        df.coalesce(1).write.parquet(f"{folder}/{number}")
        arriving = spark.readStream.schema(df.schema).parquet(f"{folder}/*")
        jobs.start_robots_stream(arriving, out, out + "-c").awaitTermination()
        return sorted((r.fetched_at - day) / hour for r in spark.read.parquet(out).filter("origin = 'http://h'").collect())

    assert visits(1, [3, 0, 24, 24.5, 30]) == [0, 24.5]
    assert visits(2, [48.5, 48, 100]) == [0, 24.5, 100]
    assert spark.read.parquet(out).filter("origin = 'http://g'").count() == 1


def test_robots_cache_without_times(spark, tmp_path):
    """Visits without a time or an origin make nothing due, alone in a batch or beside a held file."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    day = dt.datetime(2024, 1, 1)
    schema = "url string, at timestamp"

    def arrive(number, rows):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{number}")
        jobs.start_robots_stream(spark.readStream.schema(schema).parquet(f"{folder}/*"), out, out + "-c").awaitTermination()
        return sorted((r.origin, r.fetched_at) for r in spark.read.parquet(out).collect())

    first = [("http://h", day)]
    assert arrive(0, [("http://h/x", day), ("http://h/x", None), (None, day), ("http://h/%zz", day)]) == first
    assert arrive(1, [("http://h/x", None), ("http://g/x", None)]) == first
    assert arrive(2, [("http://h/x", None), ("http://h/y", day + dt.timedelta(hours=24))]) == first
    assert arrive(3, [("http://h/y", day + dt.timedelta(hours=25))]) == [*first, ("http://h", day + dt.timedelta(hours=25))]
    held = spark.createDataFrame([("http://h", day), ("http://k", None)], jobs.REFETCH)
    visits = spark.createDataFrame([("http://h", None), (None, day), ("http://k", day)], "origin string, at timestamp")
    assert [tuple(r) for r in jobs.refetch_times(visits, held).collect()] == [("http://k", day)]


def test_running_stats(spark, tmp_path):
    folder = str(tmp_path / "in")
    seen = []
    for number in (1, 2):
        put(spark, folder, number, batch(6 * number))
        pages = tables.stream_pages(spark, f"{folder}/*", files_per_batch=1)
        counted = jobs.stream_stats(
            extraction.page_links(pages).withColumn("request_id", F.lit(1)), "request_id"
        )
        query = counted.writeStream.foreachBatch(
            lambda df, _: seen.extend(map(tuple, df.collect()))
        ).option("checkpointLocation", str(tmp_path / "c"))
        query.outputMode("update").trigger(availableNow=True).start().awaitTermination()
    assert seen == [(1, 6, 12), (1, 12, 24)]
