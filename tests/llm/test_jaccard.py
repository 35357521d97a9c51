import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, docs, prose, rows

from pagetrail.llm import bits, jaccard
from pagetrail.llm.components import components
from pagetrail.llm.shingles import shingle_sets


def plain_set(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(data):
    sets = [plain_set(t) for _, t in data]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, k in Counter(j for x in s for j in where[x] if j > i).items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                parent[find(j)] = find(i)
    least = {}
    for i, (key, _) in enumerate(data):
        least.setdefault(find(i), []).append(key)
    name = lambda i: min((k for k in least[find(i)] if k is not None), default=None)
    return sorted(((key, len(sets[i]), name(i) if sets[i] else key) for i, (key, _) in enumerate(data)), key=repr)


def corpus(seed, n):
    """Near copies of many degrees, chains of them, shared passages, and a large group of copies."""
    rnd = random.Random(seed)
    passage = prose("p", 60)
    out = []
    base = prose("base", 120).split()
    for i in range(n):
        kind = i % 6
        if kind < 2:  # a third of all rows
            words = list(base)
        elif kind == 2:
            words = prose(rnd.randint(0, 4), 90).split()
        elif kind == 3:
            words = (prose(i, 60) + " " + passage).split()
        elif kind == 4:
            words = prose(rnd.randint(0, 3), rnd.randint(1, 12)).split()
        else:
            words = prose(i, rnd.randint(3, 200)).split()
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 5])):
            at = rnd.randrange(len(words))
            words[at] = f"w{rnd.randint(0, 9)}"
        text = " ".join(words)
        out.append((i * 7 % (n * 7), text.upper() if i % 11 == 0 else text.replace(" ", "\n ", 2)))
    return out


def test_sets_match_plain_ones():
    texts = [t for _, t in awkward()] + [t for _, t in corpus(1, 40)]
    for t, found in zip(texts, shingle_sets(pa.array(texts, pa.string())), strict=True):
        assert len(found) == len(plain_set(t)), (t or "")[:50]
    a, b = shingle_sets(pa.array(["A b\tc D e f", "a B c d e F"]))
    assert np.array_equal(a, b)
    x, y = shingle_sets(pa.array(["a b", "b a"]))
    assert x[0] != y[0]


def test_join_against_brute_force(spark):
    for seed in (1, 2):
        data = corpus(seed, 400)
        assert rows(jaccard.near_groups(docs(spark, data))) == brute(data)


def test_large_regions_take_pivots(spark, monkeypatch):
    data = corpus(3, 300)
    monkeypatch.setattr(jaccard, "SMALL", 3)
    monkeypatch.setattr(jaccard, "COMMON", 10**9)  # no order by frequency: passages make large regions
    monkeypatch.setattr(jaccard, "ROUNDS", 2)
    monkeypatch.setattr(jaccard, "HELD", 500)
    assert rows(jaccard.near_groups(docs(spark, data))) == brute(data)


def stub():
    """The set with fewest shingles is like nothing in its region, whose other members are alike."""
    w = prose("stub", 5)
    return [(1, w), (2, f"{w} p q"), (3, f"{w} p q r")] + [(10 + i, f"{w} u{i} v{i}") for i in range(6)]


@pytest.mark.parametrize("small", [1, 24])
@pytest.mark.parametrize("common", [2, 10**9])
def test_pivot_unlike_its_region(spark, monkeypatch, small, common):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "COMMON", common)
    data = stub()
    assert {r[0]: r[2] for r in brute(data)}[3] == 2
    assert rows(jaccard.near_groups(docs(spark, data))) == brute(data)


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_rounds_do_not_matter(spark, monkeypatch, rounds):
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "COMMON", 10**9)
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    data = corpus(4, 150) + [(5000 + i, t) for i, t in stub()]
    assert rows(jaccard.near_groups(docs(spark, data))) == brute(data)


def test_long_words_differ(spark):
    """Words whose polynomial hashes are equal for every base: letters in the order of Thue and Morse, and their complement."""
    words = []
    for n in (1024, 2048, 4096):
        word = "".join("ab"[i.bit_count() % 2] for i in range(n))
        words += [word, word.translate(str.maketrans("ab", "ba"))]
    data = list(enumerate(words))
    assert rows(jaccard.near_groups(docs(spark, data))) == [(i, 1, i) for i in range(6)]


def test_awkward_rows(spark):
    data = awkward()
    assert rows(jaccard.near_groups(docs(spark, data, extra=True))) == brute(data)
    assert jaccard.near_groups(docs(spark, [])).count() == 0
    assert rows(jaccard.near_groups(docs(spark, [(1, None), (2, "")]))) == [(1, 0, 1), (2, 0, 2)]


def test_one_of_each_group_stays(spark):
    data = [(3, prose(1, 50)), (1, prose(1, 50)), (2, prose(2, 50)), (5, ""), (6, None), (None, "x")]
    table = docs(spark, data, extra=True)
    kept = jaccard.keep_one(table)
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 5, 6]


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 1), (20, 21), (5, 5), (None, 4), (2, 1)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "x long, y long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 6: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0
    chain = spark.range(1, 200).selectExpr("id AS x", "id + 1 AS y")
    assert {r["root"] for r in components(chain).collect()} == {1}


def test_filter_never_misses(spark):
    values = spark.range(5000).selectExpr("xxhash64(id) AS s")
    made = bits.build(values, "s", 16)
    members = np.array([r["s"] for r in values.collect()]).view(np.uint64)
    assert bits.test(made, members).all()
    assert bits.test(made, members + np.uint64(1)).mean() < 0.2
