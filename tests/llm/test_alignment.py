"""Alignment against byte sets written out, and the libraries on whole texts."""

from __future__ import annotations

import functools
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import DOCS, awkward, docs, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from pagetrail.llm import alignment
from pagetrail.llm.bpe import byte_alphabet
from pagetrail.llm.common import PIECES, TOKENIZER

A, B = public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES)
FILES = (A, B, public_tokenizers.PATTERN)
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def dense(m):
    out = np.zeros((m.height, m.width), int)
    for i in range(m.height):
        for c in m.columns[m.starts[i] : m.starts[i + 1]]:
            out[i, c] += 1
    return out


@st.composite
def matrices(draw):
    n, k, m = (draw(st.integers(1, 6)) for _ in range(3))
    out = []
    for rows, width in ((n, k), (k, m)):
        cells = [sorted(draw(st.lists(st.integers(0, width - 1), max_size=5))) for _ in range(rows)]
        starts = np.concatenate([[0], np.cumsum([len(c) for c in cells])]).astype(np.int64)
        out.append(alignment.Csr(starts, np.array([c for row in cells for c in row], np.int64), width))
    return out


@given(matrices(), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_product_of_sparse_rows(pair, block):
    left, right = pair
    got = np.zeros((left.height, right.width), int)
    last = (-1, -1)
    for rows, columns, values in left.times(right, block):
        for i, j, v in zip(rows.tolist(), columns.tolist(), values.tolist(), strict=True):
            assert (i, j) > last  # in order, each entry once
            got[i, j], last = v, (i, j)
    assert (got == dense(left) @ dense(right)).all()
    assert (dense(left.transposed()) == dense(left).T).all()


@st.composite
def cuts(draw):
    n = draw(st.integers(1, 60))
    sides = []
    for _ in range(2):
        inner = sorted(draw(st.sets(st.integers(1, n - 1), max_size=n))) if n > 1 else []
        sides.append(np.diff([0, *inner, n]).astype(np.int64))
    return sides


def spans(lengths):
    ends = np.cumsum(lengths).tolist()
    return [set(range(e - n, e)) for e, n in zip(ends, lengths.tolist(), strict=True)]


def brute_groups(a, b):
    both = sorted(set(np.cumsum(a).tolist()) & set(np.cumsum(b).tolist()))
    of = lambda sizes: [sum(c < e for c in both) for e in np.cumsum(sizes).tolist()]
    return of(a), of(b)


@given(cuts(), st.integers(1, 40))
@settings(max_examples=200, deadline=None)
def test_links_are_shared_bytes(sides, block):
    a, b = sides
    got = [t for part in alignment.overlaps(a, b, block) for t in zip(*(x.tolist() for x in part), strict=True)]
    expected = [(i, j, len(x & y)) for i, x in enumerate(spans(a)) for j, y in enumerate(spans(b)) if x & y]
    assert got == expected
    of_a, of_b = brute_groups(a, b)
    shared = [t for part in alignment.shared_groups(a, b, block) for t in zip(*(x.tolist() for x in part), strict=True)]
    assert shared == [(i, j, 1) for i, g in enumerate(of_a) for j, h in enumerate(of_b) if g == h]


@functools.cache
def libraries():
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    return tokenizer, SentencePieceProcessor(model_file=B)


def both_sides(text):
    """Ids and bytes by the libraries on the whole text, as the contract says."""
    tokenizer, model = libraries()
    back = byte_alphabet()
    a = tokenizer.encode(" " + text, add_special_tokens=False)
    b = model.encode(text)
    a_bytes = [bytes(back[c] for c in t) for t in a.tokens]
    pieces = [model.id_to_piece(i) for i in b]
    b_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
    return a.ids, a_bytes, b, b_bytes


def brute(rows):
    found = []
    for key, text in rows:
        a, a_bytes, b, b_bytes = both_sides(text or "")
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            found.append((key, [], [], [], []))
            continue
        a_size, b_size = (np.array([len(x) for x in side]) for side in (a_bytes, b_bytes))
        if len(text) < 3000:
            links = [(a[i], b[j]) for i, x in enumerate(spans(a_size)) for j, y in enumerate(spans(b_size)) if x & y]
        else:  # two pointers
            links, i, j, at, bt = [], 0, 0, a_size[0], b_size[0]
            while True:
                links.append((a[i], b[j]))
                if at == bt and i + 1 == len(a):
                    break
                step_a, step_b = at <= bt, bt <= at
                if step_a:
                    i += 1
                    at += a_size[i]
                if step_b:
                    j += 1
                    bt += b_size[j]
        both = sorted(set(np.cumsum(a_size).tolist()) & set(np.cumsum(b_size).tolist()))
        groups = []
        ends_a, ends_b = np.cumsum(a_size), np.cumsum(b_size)
        i = j = 0
        for hi in both:
            i_to, j_to = (next(k for k in range(lo, len(ends)) if ends[k] == hi) + 1 for lo, ends in ((i, ends_a), (j, ends_b)))
            groups.append(",".join(map(str, a[i:i_to])) + "|" + ",".join(map(str, b[j:j_to])))
            i, j = i_to, j_to
        found.append((key, a, b, links, groups))
    counts = Counter(link for *_, links, _ in found for link in links)
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return [
        (key, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for key, a, b, links, groups in found
    ]


def texts():
    rows = [(i, t) for i, t in awkward() if t is None or len(t) < 20_000]
    rows += [(20 + i, prose(i, 30) + ", 1" + " 23" * i + "!") for i in range(12)]
    return rows + [(40, "a  b"), (41, " a"), (42, "a "), (43, "ﬁ ½ é"), (44, "▁a"), (45, "<s> </s> <unk> <0x41>"), (46, " x"),
                   (47, "naïve façade über – “quoted” 日本語😀"), (48, "\n\nnew\r\nline\t"), (49, "\x00a")]


@pytest.mark.parametrize("frequent", [0, 40, 1 << 20])
def test_against_the_libraries(spark, frequent):
    got = alignment.align(docs(spark, texts(), extra=True).repartition(3), FILES, frequent)
    assert got.columns == COLUMNS
    expected = brute(texts())
    assert sum(r[1] > 0 for r in expected) > 20
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)


def test_long_texts_in_parts(spark, monkeypatch):
    text = prose(1, 9000) + " <|endoftext|> " + prose(2, 50)
    both = alignment.Pair(*FILES)
    monkeypatch.setattr(alignment, "LONG", 1000)
    assert len(list(alignment.parts_of(text))) > 10
    ((a, b),) = both.encode([text])
    ids_a, _, ids_b, _ = both_sides(text)
    assert [np.frombuffer(x, '<u4').tolist() for x in (a, b)] == [ids_a, ids_b]
    assert sorted(map(tuple, alignment.align(docs(spark, [(1, text), (2, text)]), FILES).collect())) == sorted(brute([(1, text), (2, text)]))


def test_small_blocks(spark, monkeypatch):
    """Links in blocks, texts in slices, counts passed on early: the numbers stay."""
    rows = texts()
    batch = alignment.encode(docs(spark, rows).coalesce(1), FILES).toArrow().combine_chunks().to_batches()[0]
    both = alignment.Pair(*FILES)
    whole = Counter(c for _, codes in alignment.Batch(batch, both).codes() for c in codes.tolist())
    monkeypatch.setattr(alignment, "BLOCK", 50)
    monkeypatch.setattr(alignment, "SLICE", 300)
    parts = Counter()
    n = 0
    for part in alignment._slices(iter([batch])):
        n += 1
        for _, codes in alignment.Batch(part, both).codes():
            parts.update(codes.tolist())
    assert n > 5 and whole == parts


def test_rows_of_links(spark):
    rows = [(1, "hello aligned world"), (2, "hello"), (3, None)]
    encoded = alignment.encode(docs(spark, rows), FILES)
    links = alignment.overlap_links(encoded, FILES).collect()
    per_doc = {r[0]: r[4] for r in brute(rows)}
    assert Counter(r.key for r in links) == {k: n for k, n in per_doc.items() if n}
    assert sum(r.n_bytes for r in links if r.key == 1) == len(" hello aligned world")
    assert all(r.a_at >= 0 and r.b_at >= 0 for r in links)
    groups = alignment.group_links(encoded, FILES).collect()
    assert {(r.key, r.a_at, r.b_at) for r in links} <= {(r.key, r.a_at, r.b_at) for r in groups}


def test_empty_table(spark):
    got = alignment.align(spark.createDataFrame([], DOCS), FILES)
    assert got.columns == COLUMNS and got.collect() == []


def test_ranks_equal_merges_only_where_proven():
    letters = {bytes([c]): c - 97 for c in b"abc"}
    assert alignment.ranks_suffice(letters | {b"ab": 3, b"abc": 4}, {(b"a", b"b"): 0, (b"ab", b"c"): 1})
    # "abc" becomes a, bc by the merges, but one token by joining what makes a token
    wrong = {(b"b", b"c"): 0, (b"a", b"b"): 1, (b"ab", b"c"): 2}
    assert not alignment.ranks_suffice(letters | {b"bc": 3, b"ab": 4, b"abc": 5}, wrong)
    assert not alignment.ranks_suffice(letters | {b"ab": 4, b"bc": 3}, {(b"a", b"b"): 0, (b"b", b"c"): 1})


def test_both_readers_split_alike():
    """Every code point between letters, digits and blanks: the library of the file and the faster one agree."""
    tokenizer, _ = libraries()
    mine = alignment.Bytewise(A, public_tokenizers.PATTERN)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 97 == 0)]
    lines = ["".join(f"a{p} {p}1{p}{p} " for p in points[i : i + 50]) for i in range(0, len(points), 50)]
    assert mine.encode(lines) == [e.ids for e in tokenizer.encode_batch(lines, add_special_tokens=False)]
