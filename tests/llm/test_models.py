import numpy as np
from helpers import awkward, docs, prose, rows
from pyspark.sql import functions as F

from pagetrail.llm import langid, quality


def german(seed, words):
    return prose(seed, words).replace("a", "ü").replace("s", "sch")


def labelled(spark):
    data = [(i, prose(i, 40), "en") for i in range(60)] + [(i, german(i, 40), "de") for i in range(60, 120)] + [(i, prose(i, 40).replace("e", "ñ"), "es") for i in range(120, 160)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string")


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 7, 12):
        codes = langid.codewords(n)
        apart = [(codes[i] != codes[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= max(1, codes.shape[1] // 4)
        assert all(len(set(c)) == 2 for c in codes.T) or n > 7


def test_language_held_out(spark):
    table = labelled(spark)
    model = langid.train(table, langid.learned_part())
    assert model.languages == ["de", "en", "es"]
    got = langid.identify(table, model).join(table, "doc_id").where(~langid.learned_part())
    assert got.where("lang = lang_pred").count() == got.count() > 20


def test_language_awkward_rows(spark):
    model = langid.train(labelled(spark), langid.learned_part())
    table = docs(spark, awkward(), extra=True)
    got = langid.identify(table, model).collect()
    assert len(got) == len(awkward())
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (1, 2, 3, 13)] == ["und"] * 4 and by[1]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got)
    assert langid.identify(docs(spark, []), model).count() == 0
    kept = langid.accepted(table, model)
    assert kept.columns == table.columns and kept.count() == len(awkward()) - 5
    empty = langid.train(labelled(spark).limit(0), F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(table, empty).collect()} == {"und"}


def test_ties_are_ambiguous():
    model = langid.Model(["a", "b"], langid.codewords(2), np.zeros((langid.BUCKETS, 1)), np.zeros(1))
    assert model.decide(langid.gram_counts("word")) == ("a", 0.5, True)


def test_counts_do_not_depend_on_parts(monkeypatch):
    text = prose(4, 500) + " é日"
    whole = langid.gram_counts(text)
    n = len(text.lower().encode())
    assert whole.sum() == 3 * n - 3


def junk(seed, words):
    return "\n".join(w.upper() + "!! " + w.upper() + "!!" for w in prose(seed, words).split())


def test_quality_held_out(spark):
    data = [(i, (prose(i, 60) + ".\n" + prose(-i, 30) + ".").capitalize() if i % 3 else junk(i, 30)) for i in range(150)]
    table = docs(spark, data)
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0) for i in range(150)], "doc_id long, quality int")
    model = quality.train(table, labels, quality.learned_part())
    got = {r["doc_id"]: r for r in quality.rate(table, model).where(~quality.learned_part()).collect()}
    assert len(got) > 20 and all(r["predicted"] == (1 if i % 3 else 0) for i, r in got.items())


def test_marginals_against_enumeration():
    rnd = np.random.default_rng(1)
    ties = rnd.normal(size=(2, 2))
    e = rnd.normal(size=6).tolist()
    total, good = 0.0, np.zeros(6)
    for code in range(64):
        y = [(code >> i) & 1 for i in range(6)]
        p = np.exp(sum(v for v, s in zip(e, y) if s) + sum(ties[a, b] for a, b in zip(y, y[1:])))
        total += p
        good += p * np.array(y)
    assert np.allclose(quality.marginals(e, ties), good / total)


def test_quality_awkward_rows(spark):
    model = quality.fit([(quality.line_features("Good text.")[0], 1), (quality.line_features("BAD!!")[0], 0)])
    got = quality.rate(docs(spark, awkward(), extra=True), model).collect()
    assert len(got) == len(awkward()) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in got if r["doc_id"] in (1, 2, 3)} == {0.0}
    assert len({r["score"] for r in got if r["doc_id"] == 6}) == 1
    assert quality.rate(docs(spark, []), model).count() == 0
    assert rows(quality.rate(docs(spark, [(1, "a\n" * 3000)]), quality.fit([])))[0][0] == 1


def test_copies_do_not_hide_a_language(spark):
    texts = spark.createDataFrame([(f"l{i}", prose(i, 30)) for i in range(8)], "lang string, text string")
    table = spark.range(2000).withColumnRenamed("id", "doc_id").crossJoin(texts)
    model = langid.train(table, F.lit(True))
    assert model.languages == [f"l{i}" for i in range(8)]
    assert langid.sample(table, F.lit(True)).count() == 8
