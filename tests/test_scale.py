"""What must not grow faster than the input: who reads what arrives, and what goes through the driver."""

from pyspark.sql import functions as F

from pagetrail.operators import fetching, frontier
from workload import inputs, queries


def test_arriving_parts_are_dealt_out(spark):
    """A part is a range of ids; its rows lie in one file of four, but many tasks have to get some of it."""
    rows = spark.range(0, 4000, 1, 4).withColumnRenamed("id", "page_id")
    files = []

    class Done:
        def awaitTermination(self):
            pass

    def run(folder):
        got = spark.read.parquet(folder)
        files.append(got.filter(F.col("page_id") >= len(files) * 1000).select(F.input_file_name()).distinct().count())
        return Done()

    queries._arriving(spark, rows, F.floor(F.col("page_id") / 1000), 4, run)
    assert len(files) == 4 and min(files) > 1


def test_growing_sides_are_not_broadcast(spark):
    """Small as they are here, tables of requests and pages meet in merge joins."""
    rows = spark.createDataFrame([("r", "k", "http://h/", 0, [0])], "request_id string, key string, url string, depth int, path array<int>")
    answers = spark.createDataFrame([("k", "http://h/", 1, "ok", None, 0)], "key string, address string, page_id long, outcome string, crawled_at timestamp, links_found long")
    found = [
        fetching.answer(rows, answers.drop("address"), answers.drop("key")),
        frontier.admit(rows, rows),
        frontier.visited_lookup(rows.select("request_id", "url"), rows),
    ]
    for df in found:
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert [f.count() for f in found] == [1, 0, 1]


def test_parsed_pages_are_dealt_out(spark, tmp_path):
    """One row group is read by one task; the pages in it are parsed by all."""
    rows = [(None if i == 7 else i % 500, f"http://h/{i}", None if i == 9 else f"<nav><a href=/{i}>x</a></nav><article>t{i}</article>") for i in range(1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    for df in (inputs.varied_pages(spark, str(tmp_path)), inputs.tangled_pages(spark, str(tmp_path))):
        held = df.select(F.spark_partition_id().alias("part")).groupBy("part").count()
        assert held.count() >= spark.sparkContext.defaultParallelism and held.agg(F.max("count")).first()[0] <= 250
    assert queries.QUERIES["news_content"](spark, str(tmp_path)).count() == 1000
    written = spark.read.parquet(f"{tmp_path}/pages.parquet")
    dealt = inputs.dealt_pages(spark, str(tmp_path))
    assert dealt.exceptAll(written).isEmpty() and written.exceptAll(dealt).isEmpty()
