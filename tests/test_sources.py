import datetime as dt
import glob
import json

from pagetrail.schemas import PAGE_DATA
from pagetrail.sources import results, tables

AT = dt.datetime(2024, 1, 2, 3, 4, 5, 678000)
ROWS = [
    ("http://h/1", 'q"t', "d,e", "line\nnext\n", ["http://h/a", "http://h/b"], AT, 0),
    ("http://h/2", " t ", "", "", [], AT.replace(microsecond=0), 1),
]


def text(path):
    return "".join(open(p, newline="").read() for p in sorted(glob.glob(f"{path}/part-*")))


def test_json_lines(spark, tmp_path):
    df = spark.createDataFrame(ROWS, PAGE_DATA)
    path = str(tmp_path / "out")
    results.write_json(df, path)
    first, second = sorted(map(json.loads, text(path).splitlines()), key=lambda r: r["url"])
    assert first["links"] == ["http://h/a", "http://h/b"]
    assert first["crawled_at"] == "2024-01-02T03:04:05.678Z"
    assert "links" not in second and "content" not in second
    assert second["description"] == "" and second["crawled_at"] == "2024-01-02T03:04:05Z"
    assert sorted(map(tuple, results.read_results(spark, path).collect())) == ROWS
    results.write_json(df.limit(1), path)  # overwrites
    assert results.read_results(spark, path).count() == 1


def test_json_array(spark, tmp_path):
    path = str(tmp_path / "out")
    many = spark.createDataFrame(
        [(f"http://h/{i:03}", "t", "", "c", [], AT, 0) for i in range(200)], PAGE_DATA
    ).repartition(5)
    results.write_json(many, path, as_array=True)
    assert [r["url"] for r in json.loads(text(path))] == [f"http://h/{i:03}" for i in range(200)]
    assert results.read_results(spark, path).count() == 200
    results.write_json(many.limit(0), path, as_array=True)
    assert json.loads(text(path)) == []
    assert results.read_results(spark, path).count() == 0


def test_read_one_document(spark, tmp_path):
    file = tmp_path / "results.json"
    file.write_text(json.dumps([{"url": "u", "title": "t", "description": "", "crawled_at": "2024-01-02T03:04:05.678Z", "depth": 2}]))
    row = results.read_results(spark, str(file), one_document=True).first()
    assert tuple(row) == ("u", "t", "", "", [], AT, 2)


def test_csv(spark, tmp_path):
    path = str(tmp_path / "out")
    results.write_results(spark.createDataFrame(ROWS, PAGE_DATA).coalesce(1), path, "csv")
    assert text(path) == (
        "URL,Title,Description,Content,Links,CrawledAt,Depth\n"
        'http://h/1,"q""t","d,e","line\nnext\n","http://h/a,http://h/b",2024-01-02T03:04:05Z,0\n'
        "http://h/2, t ,,,,2024-01-02T03:04:05Z,1\n"
    )
    results.write_results(spark.createDataFrame([], PAGE_DATA).coalesce(1), path, "csv")
    assert text(path).strip() == "URL,Title,Description,Content,Links,CrawledAt,Depth"


def test_unknown_format_is_json(spark, tmp_path):
    path = str(tmp_path / "out")
    results.write_results(spark.createDataFrame(ROWS, PAGE_DATA), path, "yaml")
    assert results.read_results(spark, path).count() == 2


def test_link_jobs_read_no_html(spark):
    df = tables.read_pages(spark, "/root/testdata/sf0.001/pages.parquet").select("url")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<url:string>" in plan
