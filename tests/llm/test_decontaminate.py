import pickle
import random

import numpy as np
from helpers import awkward, docs, prose, rows

from pagetrail.llm import decontaminate as d

ITEMS = "item_id long, text string, key string"


def distance(pattern, text):
    """Plain dynamic programme: least distance of the pattern to a passage."""
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(pattern, 1):
        new = np.empty_like(row)
        new[0] = i
        for j, t in enumerate(text, 1):
            new[j] = min(row[j - 1] + (c != t), row[j] + 1, new[j - 1] + 1)
        row = new
    return int(row.min())


def test_myers_against_the_plain_programme():
    rnd = random.Random(1)
    for _ in range(150):
        p = "".join(rnd.choice("abé ") for _ in range(rnd.randint(1, 20)))
        t = "".join(rnd.choice("abé ") for _ in range(rnd.randint(0, 40)))
        assert d.myers(p, t) == distance(p, t)


def edited(text, k, rnd):
    out = list(text)
    for _ in range(k):
        i = rnd.randrange(len(out))
        kind = rnd.randrange(3)
        if kind == 0:
            out[i] = rnd.choice("xyzé")
        elif kind == 1:
            del out[i]
        else:
            out.insert(i, rnd.choice("xyz"))
    return "".join(out)


def test_search_against_brute_force(spark):
    rnd = random.Random(2)
    items = [(i, prose(100 + i, rnd.randint(3, 30)), "clash") for i in range(12)]
    data = []
    for i in range(60):
        item = items[i % 12][1]
        passage = edited(item, rnd.randint(0, 2 + len(item) // 8), rnd)
        data.append((i, f"{prose(i, 20)} {passage if i % 4 else ''} {prose(i + 999, 15)}".upper() if i % 3 else prose(i, 30)))
    got = {(a, b): c for a, b, c in rows(d.contamination(docs(spark, data), spark.createDataFrame(items, ITEMS)))}
    want = {}
    for i, t in data:
        for j, x, _ in items:
            if (k := distance(x, t.lower())) <= d.budget(len(x), len(x.encode())):
                want[i, j] = k
    assert got == want and any(want.values()) and len(want) > 5


def test_awkward_rows(spark):
    items = [(1, None, ""), (2, "", ""), (3, "!!!", ""), (None, prose(2, 40), ""), (4, prose(2, 40).upper(), ""), (4, prose(2, 40), ""), (5, "one two", ""), (6, "日本語 テキスト", ""), (7, prose(1, 3000), "")]
    table = docs(spark, awkward(), extra=True)
    items = spark.createDataFrame(items, ITEMS)
    got = rows(d.contamination(table, items).distinct())
    assert got == sorted([(5, 5, 0), (6, 4, 0), (7, 4, 0), (None, 4, 0), (8, 7, 0), (9, 7, 0), (11, 6, 0)], key=repr)
    kept = d.clean(table, items)
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 7, 10, 12, 13]
    assert d.contamination(docs(spark, []), items).count() == 0
    assert d.contamination(table, items.limit(0)).count() == 0 and d.clean(table, items.limit(0)).count() == table.count()


def test_blocks_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(i, prose(i, 25), "") for i in range(9)], ITEMS)
    table = docs(spark, [(i, prose(i + 50, 9) + " " + prose(i, 25)) for i in range(9)])
    whole = rows(d.contamination(table, items))
    monkeypatch.setattr(d, "BLOCK_BYTES", 300)
    assert rows(d.contamination(table, items)) == whole and len(whole) == 9


def changed(text, k, step):
    """The text with k characters exchanged, one in each stretch of ``step``."""
    out = list(text)
    for i in range(k):
        out[i * step + step // 2] = "7"
    return "".join(out)


def test_a_tenth_of_the_characters_may_differ():
    rnd = random.Random(5)
    texts = [prose(f"t{n}", 60)[:n].strip().ljust(n, "q") for n in (9, 10, 15, 19, 20, 31, 40, 93, 233)]
    texts += [t.translate(str.maketrans("aeo", "ñ日é")) for t in texts]
    matcher = d.Matcher(list(range(len(texts))), texts)
    for i, t in enumerate(texts):
        k = len(t) // 10  # the stated budget: a tenth
        step = len(t) // max(1, k)
        assert matcher.matches(f"vor {changed(t, k, step)} nach").get(i) == k
        assert i not in matcher.matches(f"vor {changed(t, k + 1, len(t) // (k + 1))} nach")
        # at the very start and end of a document, with the item's head or tail gone
        assert matcher.matches(t[k:] + " nach").get(i) == distance(t, t[k:] + " nach") <= k
        assert matcher.matches("vor " + t[: len(t) - k]).get(i) == distance(t, "vor " + t[: len(t) - k]) <= k
        for _ in range(20):
            text = f"{prose(rnd.random(), 5)} {edited(t, rnd.randint(0, k + 1), rnd)} {prose(rnd.random(), 5)}"
            least = distance(t, text)
            assert matcher.matches(text).get(i) == (least if least <= k else None)
    # one long word exchanged
    item = "the whole of it and then extraordinarily many other words that nobody has changed since those were written"
    assert d.Matcher([1], [item]).matches(item.replace("many other", "no further")) == {1: distance(item, item.replace("many other", "no further"))}


def test_item_of_two_texts(spark):
    """The text that is nearer to the document counts, whatever the order of the texts."""
    cat, dog = ("the quick brown fox jumps over the lazy %s near the old river bank" % x for x in ("cat", "dog"))
    table = spark.createDataFrame([(5, cat), (5, dog)], "item_id long, text string")
    for text in (cat, dog):
        found = d.contamination(docs(spark, [(1, text)]), table).collect()
        assert [tuple(r) for r in found] == [(1, 5, 0)]


def test_what_tasks_hold_of_items_is_small():
    """A block of items comes to every Python worker; it must not bring filters that are larger than the items ask for."""
    matcher = d.Matcher(list(range(200)), [prose(i, 30) for i in range(200)])
    assert len(pickle.dumps(matcher)) < 4 << 20


def test_texts_searched_together(monkeypatch):
    """Short texts are joined, long ones cut into parts; nothing is found across texts and nothing lost between parts."""
    rnd = random.Random(9)
    items = [prose(i, n) for i, n in enumerate((1, 2, 5, 30, 60))] + ["ab", "x", "日本", "q" * 8, "é" * 40]
    matcher = d.Matcher(list(range(len(items))), items)
    texts = [edited(items[i % 10], rnd.randint(0, len(items[i % 10]) // 10), rnd) + " " * (i % 3) + prose(i, i % 7) for i in range(60)]
    texts += ["", "a", "b", items[3][:40], items[3][40:], "x"]
    want = [{i: k for i, x in enumerate(items) if (k := distance(x, t)) <= d.budget(len(x), 0)} for t in texts]
    for part in (64, 1 << 16):
        monkeypatch.setattr(d, "PART", part)
        assert list(matcher.all_matches(texts)) == want == [matcher.matches(t) for t in texts]
    assert sum(map(len, want)) > 30
