import corpus_pipeline
from helpers import docs, prose

from pagetrail.llm.common import cut_lineage


def test_every_stage_takes_effect(spark, tmp_path):
    item = prose("item", 40)
    texts = {i: prose(i, 60) for i in range(30)}
    texts |= {100: texts[1], 101: texts[2] + " tail", 102: prose(7, 10) + " " + item.replace("a", "A") + " " + prose(8, 30), 103: "123 ...", 104: None}
    table = spark.createDataFrame([(i, t, "en" if i < 20 else None, "s", 0) for i, t in texts.items()], docs(spark, []).schema)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = cut_lineage(stage(spark, frame, str(tmp_path)), name)
        assert frame.columns == table.columns
        seen.append({r["doc_id"] for r in frame.select("doc_id").collect()})
    every = set(texts)
    assert seen[0] == every - {103, 104}
    assert seen[1] == seen[0] - {1}
    assert seen[2] == seen[1] - {101}
    assert seen[3] == seen[2] - {102}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == seen[3] and all(r["n_tokens"] > 0 for r in out)


def test_awkward_rows(spark, tmp_path):
    """Clashing extra columns, nulls, repeated rows, empty and long texts: each stage keeps the columns."""
    extra = ["key", "body", "h", "row", "keep_id", "n_shingles", "component_id"]
    long = " ".join(prose(i, 50) for i in range(200, 400))
    rows = [(1, prose(1, 50)), (1, prose(1, 50)), (2, ""), (3, None), (4, long), (5, prose(5, 4)), (None, prose(6, 50))]
    base = docs(spark, []).schema
    table = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], base).selectExpr("*", *[f"'x' AS `{c}`" for c in extra])
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (None, ""), (2, prose("item", 40))], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = cut_lineage(stage(spark, frame, str(tmp_path)), name)
        assert frame.columns == table.columns, name
    assert sorted(r["text"] for r in frame.collect()) == sorted([prose(1, 50), long, prose(5, 4), prose(6, 50)])


def test_empty_tables(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.collect() == [] and "ids_sha256" in out.columns


def test_texts_without_words_stay_in_later_stages(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = docs(spark, [(1, None), (2, ""), (3, " "), (4, prose(4, 20)), (4, prose(4, 20))])
    stages = dict(corpus_pipeline.STAGES)
    for name in ("near_dedup", "decontamination"):
        assert sorted(r["doc_id"] for r in stages[name](spark, table, str(tmp_path)).collect()) == [1, 2, 3, 4, 4]
    assert sorted(r["doc_id"] for r in stages["exact_dedup"](spark, table, str(tmp_path)).collect()) == [2, 3, 4]
    counted = stages["byte_bpe"](spark, table, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["n_tokens"] > 0) for r in counted) == [(1, False), (2, False), (3, True), (4, True), (4, True)]
