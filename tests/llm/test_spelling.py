"""Spelling variants against pairwise comparison."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from helpers import DOCS, awkward, docs, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from pagetrail.llm import spelling


def one_edit(a, b):
    """Exactly one insertion, deletion or replacement, by trying each place."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_pairs(words):
    return {(a, b) for a in words for b in words if one_edit(a, b)}


def found_pairs(words):
    got = [p for found, near in spelling.near_pairs(words) for p in zip(found, near)]
    assert len(got) == len(set(got))
    return set(got)


@given(st.lists(st.text("abé", min_size=1, max_size=8), unique=True, max_size=150))
@settings(max_examples=150, deadline=None)
def test_recurrences(words):
    assert found_pairs(words) == brute_pairs(words)


@pytest.mark.parametrize(("letters", "queries", "kept"), [(64, 7, 1 << 25), (1 << 22, 3, 1 << 25), (512, 64, 0)])
def test_slices(monkeypatch, letters, queries, kept):
    for name, value in (("BLOCK_LETTERS", letters), ("QUERIES", queries), ("KEPT_BYTES", kept)):
        monkeypatch.setattr(spelling, name, value)
    rnd = random.Random(1)
    words = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 6))) for _ in range(400)})
    assert found_pairs(words) == brute_pairs(words)


def test_long_words():
    word = "ab" * 30_000
    words = [word, word + "c", word[:20_000] + word[20_001:], word[:5] + "z" + word[6:], "short"]
    assert found_pairs(words) == {(word, w) for w in words[1:4]} | {(w, word) for w in words[1:4]}


def brute(rows):
    """The whole query on plain Python values."""
    counts = Counter()
    for key, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [] for w in words}
    for a, b in brute_pairs(words):
        near[a].append(b)
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda o: (-words[o], o))
            if words[best] >= 5 * words[w]:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out, key=repr)


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def variant_rows():
    """Words, rarer misspellings of them, and misspellings of those: chains of forms."""
    rnd = random.Random(3)
    rows = awkward()
    words = [prose(100 + i, 1) + "aber" for i in range(60)]
    for i, word in enumerate(words):
        at = rnd.randrange(len(word))
        wrong = word[:at] + "q" + word[at + rnd.randint(0, 1) :]
        worse = wrong + "x"
        rows.append((1000 + i, " ".join([word.upper()] * 160 + [wrong] * 30 + [worse] * 6)))
    rows += [(2000, "Ünderung ünderung " * 30), (2000, "×÷×÷×÷ " * 5), (None, "nullkeyword " * 9), (2001, "y" * 5000 + " ")] * 5
    return rows


def test_whole_query_against_brute_force(spark):
    rows = variant_rows()
    got = spelling.variant_groups(docs(spark, rows, extra=True).repartition(5))
    assert got.columns == COLUMNS
    expected = brute(rows)
    assert sorted(map(tuple, got.collect()), key=repr) == expected
    assert max(sum(1 for _ in chain(dict((r[0], r[1]) for r in expected), r[0])) for r in expected) >= 2


def chain(form, word):
    while form.get(word):
        word = form[word]
        yield word


@pytest.mark.parametrize("most", [1, 2, 50])
def test_small_regions_lose_no_pair(spark, most):
    """A vocabulary in which most words begin alike is halved down to what may differ."""
    rnd = random.Random(5)
    stem = "gemeinsamer"
    words = {stem + "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 7))) for _ in range(120)}
    words |= {"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 5))) + stem for _ in range(60)}
    table = spark.createDataFrame([(w, 5 + len(w)) for w in sorted(words)], "word string, n long")
    got = spelling.near_words(table, most).collect()
    assert len(got) == len({(r.word, r.near) for r in got})
    assert {(r.word, r.near) for r in got} == brute_pairs(words)
    assert all(r.n == 5 + len(r.word) and r.near_n == 5 + len(r.near) for r in got)


def test_regions_are_bounded(spark):
    words = [f"anfang{a}{b}{c}ende" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    table = spark.createDataFrame([(w, 9) for w in words], "word string, n long")
    sizes = [r["count"] for r in spelling.regions(table, 20).groupBy("longest", "ahead", "behind", "shared").count().collect()]
    assert max(sizes) <= 64  # two free letters of eight


def test_counts_pass_on(spark, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED", 3)
    got = {r.word: r.n for r in spelling.vocabulary(docs(spark, [(i, "gleiches wort " * 3) for i in range(9)])).collect()}
    assert got == {"gleiches": 27}


def test_empty_tables(spark):
    assert spelling.variant_groups(spark.createDataFrame([], DOCS)).collect() == []
    assert spelling.variant_groups(docs(spark, [(1, None), (2, ""), (None, "kurz")])).columns == COLUMNS
