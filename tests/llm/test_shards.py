"""Sharding: a permutation and its inverse, laws of counts and slots, independence of files."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import DOCS, awkward, docs, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from pagetrail.llm import shards

NEW = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


@given(st.integers(1, 3000), st.integers(0, 2**63))
@settings(max_examples=60, deadline=None)
def test_permutation_and_inverse(total, seed):
    x = np.arange(total)
    place = shards.permuted(x, total, seed)
    assert sorted(place) == list(range(total))
    assert (shards.permuted(place, total, seed, back=True) == x).all()


def test_large_totals_walk_back():
    for total in (10**12 + 39, 2**40, 2**62 + 5):
        x = np.array([0, 1, total // 2, total - 1])
        place = shards.permuted(x, total, 5)
        assert ((place >= 0) & (place < total)).all() and len(set(place.tolist())) == 4
        assert (shards.permuted(place, total, 5, back=True) == x).all()


def test_neighbours_part():
    """Rows next to each other land in any shard about equally often."""
    shard, _ = shards.locate(np.arange(24_000), 24_000, 24, seed=1)
    steps = Counter((np.diff(shard) % 24).tolist())
    assert max(steps.values()) < 1.3 * 1000 and min(steps.values()) > 0.7 * 1000


def held(spark, given_rows, **options):
    found = shards.shard(docs(spark, given_rows), **options)
    return found.columns, found.collect()


@pytest.mark.parametrize("n", [0, 1, 5, 24, 25, 100])
def test_counts_and_slots(spark, n):
    columns, got = held(spark, [(i, prose(i, 3)) for i in range(n)], keep=["doc_id"])
    assert columns == ["doc_id", *NEW] and len(got) == n
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 24 and r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[i]) for i in range(24)]
    assert max(sizes) - min(sizes) <= 1


def test_brute_force_on_awkward_rows(spark):
    """Numbers by sorting, places by the network on plain integers."""
    given_rows = awkward()
    measured = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in given_rows]
    measured.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    n = len(measured)
    a, b = shards.sides(n)
    assert a * b >= n > 0

    def step(x):
        left, right = divmod(x, b)
        for i, key in enumerate(shards.round_keys(13)):
            half = left if i % 2 else right
            h = (half ^ key) * 0xBF58476D1CE4E5B9 % 2**64
            h = ((h ^ (h >> 32)) * 0x9E3779B97F4A7C15 % 2**64) >> 32
            if i % 2:
                right = (right + h) % b
            else:
                left = (left + h) % a
        return left * b + right

    expected = []
    for number, row in enumerate(measured):
        x = step(number)
        while x >= n:
            x = step(x)
        expected.append((*row, "rows", x % 24, x // 24, None))
    _, got = held(spark, given_rows, keep=["doc_id"])
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


def test_files_and_partitions_do_not_matter(spark):
    rows = [(i * 7 % 500, prose(i % 90, 4)) for i in range(500)]
    base = docs(spark, rows)
    one = shards.shard(base.repartition(1), keep=["doc_id"]).collect()
    many = shards.shard(base.repartition(17, "text"), keep=["doc_id"]).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, many))
    assert sorted(map(repr, one)) != sorted(map(repr, shards.shard(base, seed=14, keep=["doc_id"]).collect()))


def test_shard_and_slot_are_computable(spark):
    rows = [(i, prose(i, 2)) for i in range(101)]
    _, got = held(spark, rows, shards=7, seed=3)
    by_place = {(r.shard, r.slot): r.doc_id for r in got}  # ids are the row numbers here
    shard, slot = shards.locate(range(101), 101, 7, 3)
    for i in range(101):
        assert by_place[int(shard[i]), int(slot[i])] == i
        assert shards.number_at(int(shard[i]), int(slot[i]), 101, 7, 3) == i
    assert shards.number_at(0, 1000, 101, 7, 3) is None and shards.number_at(7, 0, 101, 7, 3) is None


def test_one_group_of_copies_is_spread(spark):
    """Two thirds of the rows are one row: all are there, each in a slot of its own."""
    rows = [(1, "same text")] * 400 + [(i, prose(i, 3)) for i in range(2, 202)]
    _, got = held(spark, rows, keep=["doc_id"])
    assert len({(r.shard, r.slot) for r in got}) == len(got) == 600
    assert sum(r.doc_id == 1 for r in got) == 400


def test_whole_rows_and_clashing_names(spark):
    df = docs(spark, awkward(), extra=True)
    for name in ("x_at", "x_key2", "x_part", "X_TOTAL", "x_first", "x_place", "x_hash", "x_spread"):
        df = df.selectExpr("*", f"'clash' AS {name}")
    df = df.withColumn("slot", df.doc_id)
    got = shards.shard(df)
    assert got.columns == [c for c in df.columns if c != "slot"] + NEW
    texts = lambda frame: sorted((r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "") for r in frame.collect())
    assert texts(got) == texts(df) and {r.x_at for r in got.collect()} == {"clash"}
    empty = shards.shard(spark.createDataFrame([], DOCS))
    assert empty.count() == 0 and empty.columns[-6:] == NEW


def test_written_shards(spark, tmp_path):
    placed = shards.shard(docs(spark, [(i, prose(i, 5)) for i in range(60)]), shards=4)
    path = str(tmp_path / "out")
    shards.write_shards(placed, path)
    back = spark.read.parquet(path)
    assert sorted(r.doc_id for r in back.collect()) == list(range(60))
    assert spark.read.parquet(f"{path}/shard=2").count() == 15
