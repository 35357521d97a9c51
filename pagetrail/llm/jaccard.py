"""Exact self-join of shingle sets by Jaccard similarity, in a metric space of pivots.

Jaccard distance is a metric, and all is stated in it: two sets link at distance <= 1/4.

*Pivots and regions.*  Unrelated texts are all at distance 1, so documents as first pivots
would separate nothing.  The first pivots are therefore the shingles themselves, as sets of one
element, in one fixed order (shingles that many texts share come last).  A set lies nearest to
the first of its own shingles and belongs to that Voronoi region.

*Windows.*  By the triangle inequality, a set within 1/4 of x misses at most a quarter of x,
so it holds one of the first ``n - ceil(3n/4) + 1`` shingles of x: x is replicated to the
regions of just these.  Only shingles that several distinct texts have in their windows make
a region at all.

*Recursion.*  A small region compares its members of similar size.  In a large one documents
become pivots: every member is measured against one pivot document, those within 1/4 fall into
its component, and the region goes on with new pivots for as long as it holds several components;
then its remaining members outside the largest component are measured against the members of other
components.  Within a component nothing more needs to be measured, so groups of copies cost
their size and not its square.  All pairs in different components are pruned by what their
windows share and then verified on the whole sets, which keeps the join exact.

Texts with equal sets are one class from the start and take part once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bits
from .common import cut_lineage, fresh, in_batches
from .components import components
from .shingles import shingle_sets

#: A shingle that so many distinct texts have in their windows goes last in the order (any order gives the same result).
COMMON = 16
#: Times the windows are counted to find such shingles; every time those found before have moved to the end.
ORDERS = 2
#: Regions of up to so many members compare them directly; larger ones take pivots.
SMALL = 24
#: Rounds of pivots in large regions before their other components are measured.
ROUNDS = 2
#: log2 of the bits of the filters: common shingles, shared shingles, sets to verify (at most 8 MB each).
COMMON_BITS, SHARED_BITS, VERIFY_BITS = 25, 26, 25
#: Shingles held by a task at once.
HELD = 1 << 19
#: Distance at which sets link at most, with room for rounding where distances are compared.
NEAR, ROOM = 0.25, 1e-9

_EMPTY = np.zeros(0, np.uint64)


def window(n: int) -> int:
    """So many first shingles of a set of ``n`` can't all be missing from a set within 1/4."""
    return n - (3 * n + 3) // 4 + 1 if n else 0


def _class_of(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("body"))


class _Seen:
    """Classes a task has met; forgets beyond a bound, which only repeats work."""

    def __init__(self) -> None:
        self.known: set[bytes] = set()

    def __call__(self, c: bytes) -> bool:
        if c in self.known:
            return True
        if len(self.known) > 500_000:
            self.known.clear()
        self.known.add(c)
        return False


class _Blobs:
    """Shingles of a task on their way to the buckets of the hash space, equal ones combined before."""

    def __init__(self, log2: int) -> None:
        self.log2, self.held, self.size = log2, [], 0

    def add(self, first: np.ndarray) -> None:
        self.held.append(first)
        self.size += len(first)

    def send(self, repeats: bool = False) -> pa.RecordBatch:
        """Everything held; with ``repeats`` only what is held more than once, to buckets of its own."""
        values, times = np.unique(np.concatenate([_EMPTY, *self.held]), return_counts=True)
        self.held, self.size = [], 0
        if repeats:
            values, times = values[times > 1], times[times > 1]
        bucket = (values >> np.uint64(64 - self.log2)).astype(np.int64) if self.log2 else np.zeros(len(values), np.int64)
        heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
        tails = np.r_[heads[1:], len(bucket)]
        times = np.minimum(times, 255).astype(np.uint8)
        bucket = bucket + (repeats << self.log2)
        n = len(heads)
        return pa.RecordBatch.from_arrays(
            [
                *(pa.nulls(n, kind) for kind in (pa.int64(), pa.int32(), pa.binary())),
                pa.array(bucket[heads]),
                pa.array([values[a:b].tobytes() for a, b in zip(heads, tails)], pa.binary()),
                pa.array([times[a:b].tobytes() for a, b in zip(heads, tails)], pa.binary()),
            ],
            ["id", "n", "c", "bucket", "found", "times"],
        )


def _ordered(found: np.ndarray, common: np.ndarray | None) -> np.ndarray:
    """The window of a set: its first shingles in the order of (common, hash)."""
    if common is None:
        return found[: window(len(found))]
    last = bits.test(common, found)
    return np.concatenate([found[~last], found[last]])[: window(len(found))]


def _windows(rows: DataFrame, common, with_texts: bool) -> DataFrame:
    """Blobs of the windows of all distinct sets, by bucket.

    Asked for texts, also (id, n, c) of each, and as further blobs the shingles that a task meets repeatedly in whole sets:
    large groups of near copies show there beyond their windows.
    There are 16 buckets or more for each shuffle partition, so that a bucket stays small where partitions are.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    log2 = (partitions * 16 - 1).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, blobs, whole = _Seen(), _Blobs(log2), _Blobs(log2)
        order = None if common is None else common.value
        for batch in batches:
            n, c = [], []
            for found in shingle_sets(batch.column(1)):
                name = _class_of(found)
                n.append(len(found))
                c.append(name)
                if len(found) and not seen(name):
                    blobs.add(_ordered(found, order))
                    if blobs.size >= HELD:
                        yield blobs.send()
                    if with_texts:
                        whole.add(found)
                        if whole.size >= 2 * HELD:
                            yield whole.send(repeats=True)
            if with_texts:
                k = len(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int32()), pa.array(c, pa.binary()), *(pa.nulls(k, t) for t in (pa.int64(), pa.binary(), pa.binary()))],
                    ["id", "n", "c", "bucket", "found", "times"],
                )
        yield blobs.send()
        yield whole.send(repeats=True)

    return in_batches(rows, run, "id long, n int, c binary, bucket long, found binary, times binary")


def _counts(blobs: DataFrame) -> DataFrame:
    """(s, times) of shingles that occur in several windows; times up to 255."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found, times = None, [], []

        def result() -> pa.RecordBatch:
            values, weight = np.concatenate([_EMPTY, *found]), np.concatenate([np.zeros(0, np.int64), *times])
            order = np.argsort(values, kind="stable")
            values, weight = values[order], weight[order]
            heads = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
            sums = np.add.reduceat(weight, heads) if len(heads) else weight
            many = sums > 1
            return pa.RecordBatch.from_arrays(
                [pa.array(values[heads][many].view(np.int64)), pa.array(np.minimum(sums[many], 255).astype(np.int32))], ["s", "times"]
            )

        for batch in batches:
            for bucket, a, b in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if bucket != now and now is not None:
                    yield result()
                    found, times = [], []
                now = bucket
                found.append(np.frombuffer(a, np.uint64))
                times.append(np.frombuffer(b, np.uint8).astype(np.int64))
        if now is not None:
            yield result()

    sent = blobs.where("bucket IS NOT NULL").select("bucket", "found", "times")
    return in_batches(sent.repartition("bucket").sortWithinPartitions("bucket"), run, "s long, times int")


def _regions(rows: DataFrame, common, shared) -> DataFrame:
    """(s, c, n, own, end, pos, rare): each class in the regions of its window; ``own``: shingles of the window that no other window
    has; ``end``: place of the window's last shingle in the order; ``pos``: rank of the shingle in the set, from 1; ``rare``: shingles of the whole set that are not marked as common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            s, c, n, own, end, pos, rare, times = [], [], [], [], [], [], [], []
            for found in shingle_sets(batch.column(1)):
                if not len(found) or seen(name := _class_of(found)):
                    continue
                whole = _ordered(found, common.value)
                met = bits.test(shared.value, whole)
                first = whole[met]
                if len(first):
                    s.append(first)
                    pos.append(np.flatnonzero(met) + 1)
                    end.append(int(bits.test(common.value, whole[-1:])[0]) << 62 | int(whole[-1]) >> 2)
                    c.append(name)
                    n.append(len(found))
                    own.append(window(len(found)) - len(first))
                    rare.append(int((~bits.test(common.value, found)).sum()))
                    times.append(len(first))
            if s:
                at = np.repeat(np.arange(len(s)), times)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(s).view(np.int64)),
                        pa.array(c, pa.binary()).take(pa.array(at)),
                        pa.array(np.array(n, np.int32)[at]),
                        pa.array(np.array(own, np.int32)[at]),
                        pa.array(np.array(end, np.int64)[at]),
                        pa.array(np.concatenate(pos).astype(np.int32)),
                        pa.array(np.array(rare, np.int32)[at]),
                    ],
                    ["s", "c", "n", "own", "end", "pos", "rare"],
                )

    return in_batches(rows, run, "s long, c binary, n int, own int, end long, pos int, rare int").distinct()


def _similar(a: Column, b: Column) -> Column:
    """Whether two members can link by their sizes and windows.

    Of two windows take the one that ends first in the order: what of it the other window lacks, the other set lacks.
    So that set has at most ``n - own`` shingles in common with the other.
    """
    sizes = F.least(a["n"], b["n"]) * 4 >= F.greatest(a["n"], b["n"]) * 3
    most = F.when(a["end"] <= b["end"], a["n"] - a["own"]).otherwise(b["n"] - b["own"])
    return sizes & (most * 7 >= (a["n"] + b["n"]) * 3)


def _rest(a: Column, b: Column) -> Column:
    """Shingles outside the window that ends first; only these can be shared besides those of both windows."""
    n = F.when(a["end"] <= b["end"], a["n"]).otherwise(b["n"])
    return F.floor(3 * n / 4 + 0.75) - 1


def _early(a: Column, b: Column) -> Column:
    """Whether two members of a region can link if its shingle is the first that they share; for some region it is."""
    return (F.least(a["n"] - a["pos"], b["n"] - b["pos"]) + 1) * 7 >= (a["n"] + b["n"]) * 3


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("x"), F.greatest(a, b).alias("y")]


class _Verifier:
    """Tells on the whole sets which pairs of classes link."""

    def __init__(self, rows: DataFrame, classes: DataFrame) -> None:
        self.rows, self.classes = rows, classes

    def sets(self, names: DataFrame) -> DataFrame:
        """(c, found) for the named classes, from the text that stands for each; written."""
        sc = names.sparkSession.sparkContext
        wanted = names.distinct().join(self.classes, "c").select("c", "id", F.xxhash64("id").alias("h"))
        wanted = cut_lineage(wanted, "wanted")
        keys = sc.broadcast(bits.build(wanted, "h", VERIFY_BITS))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = bits.test(keys.value, batch.column(2).to_numpy().view(np.uint64))
                chosen = batch.filter(pa.array(hit))
                c, blob = [], []
                for found in shingle_sets(chosen.column(1)):
                    c.append(_class_of(found))
                    blob.append(found.astype("<u8").tobytes())
                yield pa.RecordBatch.from_arrays([chosen.column(0), pa.array(c, pa.binary()), pa.array(blob, pa.binary())], ["id", "c", "found"])

        sets = in_batches(self.rows.withColumn("h", F.xxhash64("id")), run, "id long, c binary, found binary")
        named = wanted.select(F.col("c").alias("k"), F.col("id").alias("i"))
        sets = sets.join(named, (F.col("c") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")), "left_semi")
        written = cut_lineage(sets.select("c", "found").dropDuplicates(["c"]), "sets")
        keys.destroy()  # filters are given back as soon as what they served is written
        return written

    @staticmethod
    def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """(x, y, distance, link) of ``pairs``, by all 64 bits of their shingles."""

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = batch.column(2), batch.column(3)
                distance, link = np.zeros(len(batch)), np.zeros(len(batch), bool)
                for i in range(len(batch)):
                    a, b = (np.frombuffer(side[i].as_buffer(), "<u8") for side in (x, y))
                    both = np.sort(np.concatenate([a, b]))
                    common = int((both[1:] == both[:-1]).sum())
                    union = len(a) + len(b) - common
                    distance[i], link[i] = 1 - common / union, 100 * common >= 75 * union
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(distance), pa.array(link)], ["x", "y", "distance", "link"]
                )

        sides = [sets.select(F.col("c").alias(side), F.col("found").alias(f"set_{side}")) for side in "xy"]
        joined = pairs.join(sides[0], "x").join(sides[1], "y").select("x", "y", "set_x", "set_y")
        return in_batches(joined, compare, "x binary, y binary, distance double, link boolean")


def _links(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts (id, n, c), classes (c, id, n) and links between them: enough for every component, each true."""
    sc = rows.sparkSession.sparkContext
    first = cut_lineage(_windows(rows, None, True), "profile")
    texts = first.where("c IS NOT NULL").select("id", "n", "c")
    classes = cut_lineage(texts.where("n > 0").groupBy("c").agg(F.min("id").alias("id"), F.first("n").alias("n")), "classes")
    marks, common = None, None
    for turn in range(ORDERS):
        blobs = _windows(rows, common, False) if turn else first
        new = cut_lineage(_counts(blobs).where(F.col("times") >= COMMON).select("s"), "common")
        marks = new if marks is None else marks.union(new)
        if common is not None:
            common.destroy()
        common = sc.broadcast(bits.build(marks, "s", COMMON_BITS))
    shared = sc.broadcast(bits.build(_counts(_windows(rows, common, False)), "s", SHARED_BITS))
    regions = cut_lineage(_regions(rows, common, shared), "regions")
    common.destroy()
    shared.destroy()
    stats = regions.groupBy("s").agg(F.count("*").alias("members"), F.min(F.struct("rare", "c", "n", "own", "end", "pos")).alias("pivot")).where("members > 1")
    placed = cut_lineage(regions.join(stats, "s"), "placed")
    small, large = placed.where(F.col("members") <= SMALL), placed.where(F.col("members") > SMALL)
    verify = _Verifier(rows, classes)

    # large regions: pivots, round by round, while a region holds several components
    links, found, sets, distances = None, None, None, None
    waiting = large.select("s", "c", *_SHAPE, F.col("c").alias("comp"), "pivot")
    for turn in range(ROUNDS):
        if turn:
            # the next pivot comes from another component than the largest
            waiting = cut_lineage(_unresolved(large, found), "waiting")
            others = waiting.join(_largest(waiting), "s").where("comp <> main")
            pivots = others.groupBy("s").agg(F.min(F.struct("rare", "c", "n", "own", "end", "pos", "comp")).alias("pivot"))
            waiting = waiting.drop("pivot").join(pivots, "s").where("comp <> pivot.comp")
        can = _similar(F.struct(*_SHAPE), F.col("pivot"))
        star = waiting.where((F.col("c") != F.col("pivot.c")) & can).select(*_pair(F.col("c"), F.col("pivot.c"))).distinct()
        star = cut_lineage(star, "star")
        if star.isEmpty():
            break
        sets = verify.sets(large.select("c")) if sets is None else sets
        stars = cut_lineage(verify.measured(star, sets), "distances")
        distances = stars if distances is None else distances
        good = stars.where("link").select("x", "y")
        links = good if links is None else links.union(good)
        found = cut_lineage(components(links), "components")

    # whatever the pivots did, members of large regions that no component joins are compared
    pairs = _direct(small, large).union(_across(cut_lineage(_ranged(_unresolved(large, found), distances), "apart"))).distinct()
    if found is not None:
        for side in "xy":
            own = found.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
            pairs = pairs.join(own, side, "left")
        pairs = pairs.where("root_x IS NULL OR root_y IS NULL OR root_x <> root_y").select("x", "y")
    pairs = cut_lineage(pairs, "pairs")
    sets = verify.sets(pairs.select(F.explode(F.array("x", "y")).alias("c")))
    good = cut_lineage(verify.measured(pairs, sets).where("link").select("x", "y"), "links")
    return texts, classes, good if links is None else links.union(good)


_SHAPE = ("n", "own", "end", "pos", "rare")


def _direct(small: DataFrame, large: DataFrame) -> DataFrame:
    """(x, y) that can link and share a region of at most SMALL members, by all that their windows share.

    What two windows share in large regions isn't counted; it is no more than either has there.
    """
    elsewhere = large.groupBy("c").agg(F.count("*").cast("int").alias("more"))
    members = small.join(elsewhere, "c", "left").na.fill(0, ["more"])
    groups = members.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("c", *_SHAPE, "more"))).alias("m"))
    each = groups.select(F.posexplode("m").alias("i", "a"), "m").select("a", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("b"))
    a, b = F.col("a"), F.col("b")
    met = each.where(_similar(a, b)).select(
        a["c"].alias("x"),
        b["c"].alias("y"),
        _early(a, b).alias("early"),
        (_rest(a, b) + F.least(a["more"], b["more"])).alias("rest"),
        (a["n"] + b["n"]).alias("both"),
    )
    pairs = met.groupBy("x", "y").agg(
        F.count("*").alias("shared"), F.max("early").alias("early"), F.first("rest").alias("rest"), F.first("both").alias("both")
    )
    return pairs.where(F.col("early") & (7 * (F.col("shared") + F.col("rest")) >= 3 * F.col("both"))).select("x", "y")


def _unresolved(large: DataFrame, found: DataFrame | None) -> DataFrame:
    """(s, c, shape, comp, pivot) of large regions that hold several components; what nothing linked is its own."""
    if found is None:
        return large.select("s", "c", *_SHAPE, F.col("c").alias("comp"), "pivot")
    placed = large.join(found.select(F.col("node").alias("c"), "root"), "c", "left").select(
        "s", "c", *_SHAPE, F.coalesce("root", "c").alias("comp"), "pivot"
    )
    several = placed.groupBy("s").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("s")
    return placed.join(several, "s", "left_semi")


def _ranged(placed: DataFrame, distances: DataFrame | None) -> DataFrame:
    """Adds ``low`` and ``high``, between which the distance to the region's first pivot lies.

    Measured members have both alike.  The others were too unlike by size and window: what of a window no
    other has bounds what two sets can share, which is the low end.
    """
    a, b = F.struct(*_SHAPE), F.col("pivot")
    most = F.least(F.when(a["end"] <= b["end"], a["n"] - a["own"]).otherwise(b["n"] - b["own"]), a["n"], b["n"])
    least = 1 - most / (a["n"] + b["n"] - most)
    itself = F.col("c") == F.col("pivot.c")
    if distances is None:
        exact = F.when(itself, 0.0)
    else:
        x, y = _pair(F.col("c"), F.col("pivot.c"))
        placed = placed.select("*", x, y).join(distances.select("x", "y", "distance"), ["x", "y"], "left")
        exact = F.when(itself, 0.0).otherwise(F.col("distance"))
    return placed.select("s", "c", *_SHAPE, "comp", F.coalesce(exact, least).alias("low"), F.coalesce(exact, F.lit(1.0)).alias("high"))


def _largest(placed: DataFrame) -> DataFrame:
    """(s, main): the component with most members of each region."""
    sizes = placed.groupBy("s", "comp").agg(F.count("*").alias("k"))
    return sizes.groupBy("s").agg(F.max(F.struct("k", "comp"))["comp"].alias("main"))


def _across(apart: DataFrame) -> DataFrame:
    """(x, y) that can link and whose components differ: each member outside the largest component against the others.

    A pair is looked at in the region of the first shingle that both share, or in few besides, and only if by the
    triangle inequality their distances to the region's pivot allow it.
    """
    member = F.struct("c", *_SHAPE, "comp", "low", "high")
    few = apart.join(_largest(apart), "s").where("comp <> main").select("s", member.alias("a"))
    a, b = F.col("a"), F.col("b")
    window = F.greatest(a["low"] - b["high"], b["low"] - a["high"]) <= NEAR + ROOM
    can = (a["comp"] != b["comp"]) & window & _similar(a, b) & _early(a, b)
    met = few.join(apart.select("s", member.alias("b")), "s").where(can)
    return met.select(*_pair(a["c"], b["c"]))


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id (smallest key reachable by links).

    Words are runs of other characters than blank and tab to carriage return, A-Z lower-cased; a
    set holds the distinct runs of five words, or the whole sequence if it is shorter.  A null text, an
    empty one and one without words have an empty set and link with nothing.  Rows with a null
    key count, but never name a component that has other keys.  A key repeated with another text is
    another row; repeated rows give repeated rows.  No rows: no rows.  Extra columns play no part.
    """
    rows = _rows(docs, key, text)
    texts, classes, links = _links(rows)
    found = cut_lineage(components(links), "components")
    named = classes.join(found.select(F.col("node").alias("c"), "root"), "c", "left").select("c", "id", F.coalesce("root", "c").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("component"))
    of_class = named.join(least, "root").select("c", "component")
    return texts.join(of_class, "c", "left").select(
        F.col("id").alias(key),
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose key names its component.  Rows without a key stay; rows that repeat a key are judged together."""
    groups = near_groups(docs, key, text)
    name = fresh("x_key", docs.columns)
    kept = groups.where((F.col(key) == F.col("component_id"))).select(F.col(key).alias(name)).distinct()
    return docs.join(kept, docs[key].cast("long") == kept[name], "left_semi").unionByName(docs.where(docs[key].isNull()))
