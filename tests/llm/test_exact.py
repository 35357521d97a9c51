import hashlib
from collections import defaultdict

from helpers import awkward, docs, rows

from pagetrail.llm import exact


def expected(data):
    groups = defaultdict(list)
    for i, t in data:
        groups[t or ""].append(i)
    out = []
    for i, t in data:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_groups(spark):
    data = awkward()
    # same length and prefix, other ends
    data += [(20, "p" * 70 + "a"), (21, "p" * 70 + "b"), (22, "p" * 70 + "a"), (23, "p" * 64), (24, "q" * 64)]
    assert rows(exact.exact_rows(docs(spark, data))) == expected(data)
    assert rows(exact.exact_groups(docs(spark, data, extra=True)).drop("x_full")) == sorted((r[:4] for r in expected(data)), key=repr)


def test_rows_that_stay(spark):
    data = awkward()
    kept = exact.deduplicate(docs(spark, data, extra=True))
    assert kept.columns == docs(spark, data, extra=True).columns
    got = sorted(((r["doc_id"], r["text"] or "") for r in kept.collect()), key=repr)
    assert got == sorted(((k, t) for t, k in largest(data).items()), key=repr)


def largest(data):
    out = {}
    for i, t in data:
        t = t or ""
        if t not in out or out[t] is None or (i is not None and i > out[t]):
            out[t] = i
    return out


def test_empty(spark):
    assert exact.exact_rows(docs(spark, [])).count() == 0
    assert exact.deduplicate(docs(spark, [])).count() == 0


def test_native_plan(spark):
    plan = exact.exact_rows(docs(spark, awkward()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
