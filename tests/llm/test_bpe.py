import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from helpers import awkward, docs, rows
from tokenizers import Tokenizer

from pagetrail.llm import codec, common, tokens
from pagetrail.llm.bpe import merged, parts_of
from pagetrail.llm.common import TIKTOKEN, TOKENIZER
from pagetrail.llm.reader import Reader


@pytest.fixture(scope="module")
def machines():
    return codec.machines(P.path(TIKTOKEN), P.PATTERN)


@pytest.fixture(scope="module")
def library(machines):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=machines[0].ranks, special_tokens={})


def texts():
    rnd = random.Random(5)
    odd = ["".join(rnd.choice("ab \n\t  .,!<|endoftext|>éßñ日本😀0123-=_THE the") for _ in range(rnd.randint(0, 200))) for _ in range(300)]
    odd += [" " * 700, "a" * 3000, "-" * 1000 + "=" * 333, "日" * 300, "x " * 100_000, " " * 200_000 + "a", "\u0085  x", "it's they're  \n\n x"]
    return odd + [t for _, t in awkward() if t is not None]


def test_encoder_equals_the_library(machines, library):
    encoder, decoder = machines
    for t in texts():
        ids = encoder.encode(t)
        assert ids == library.encode_ordinary(t)
        assert decoder.decode(ids) == t


def test_transducer_forgets_and_goes_on(machines, monkeypatch):
    encoder, _ = machines
    words = [w for t in texts()[:50] for w in encoder.pattern.findall(t)]
    before = [list(encoder.transduce(w.encode())) for w in words]
    monkeypatch.setattr(codec, "TRANSITIONS", 20)
    monkeypatch.setattr(codec, "WORDS", 5)
    encoder.restart()
    assert [list(encoder.transduce(w.encode())) for w in words] == before


def test_decoder_is_an_incremental_utf8_machine(machines):
    _, decoder = machines
    one = {b: i for i, b in decoder.bytes_of.items() if len(b) == 1}
    for raw in ("é日😀a".encode(), b"\xc3", b"\xe6\x97a", b"\xf0\x9f\x98\xc3\xa9", b"\xff\xc0\xaf\xed\xa0\x80", b"\xf4\x90\x80\x80"):
        got = decoder.decode([one[raw[i : i + 1]] for i in range(len(raw))])
        assert got == raw.decode("utf-8", "replace")


def test_counts_equal_the_library(spark):
    library = Tokenizer.from_file(P.path(TOKENIZER))
    count = tokens.counter(P.path(TOKENIZER), P.PATTERN).count
    for t in texts():
        assert count(t) == len(library.encode(t, add_special_tokens=False).ids), t[:50]


def test_shortcut_is_proven():
    counter = tokens.Counter(P.path(TOKENIZER), P.PATTERN)
    for text in list(counter.whole)[::500]:
        assert len(merged(text.encode(), counter.rank_of)) == 1
    assert len(counter.whole) > 45_000


def test_parts_never_cut_a_match():
    import regex

    text = ("word  two\n\n" * 30_000) + "y" * 200_000 + " end"
    parts = list(parts_of(text))
    assert "".join(parts) == text and len(parts) > 2
    pattern = regex.compile(P.PATTERN)
    assert [m for p in parts for m in pattern.findall(p)] == pattern.findall(text)


def test_queries_on_awkward_rows(spark, machines, library):
    data = awkward()
    table = docs(spark, data, extra=True)
    got = rows(codec.digests(table, P.path(TIKTOKEN), P.PATTERN))
    want = []
    for i, t in data:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    encoded = codec.encode(table, P.path(TIKTOKEN), P.PATTERN)
    assert rows(codec.decode(encoded, P.path(TIKTOKEN), P.PATTERN)) == sorted(((i, t or "") for i, t in data), key=repr)
    counts = {r[:3] for r in rows(tokens.token_counts(table, P.path(TOKENIZER), P.PATTERN))}
    assert (1, 0, 0) in counts and (2, 0, 0) in counts and len(counts) == len({(i, t or "") for i, t in data})
    assert codec.digests(docs(spark, []), P.path(TIKTOKEN), P.PATTERN).count() == 0
    assert tokens.token_counts(docs(spark, []), P.path(TOKENIZER), P.PATTERN).count() == 0


def test_other_work_drops_the_machines():
    """A worker goes on with stages of other operators, which need its memory; the codec's own tasks find the machines again."""
    first = codec.machines(P.path(TIKTOKEN), P.PATTERN)
    common.make_room(codec.__name__)
    assert codec.machines(P.path(TIKTOKEN), P.PATTERN) is first
    common.make_room("pagetrail.llm.jaccard")
    assert not codec._machines
    assert codec.machines(P.path(TIKTOKEN), P.PATTERN)[0].encode("to be") == first[0].encode("to be")


def test_tasks_of_other_operators_drop_the_machines(spark):
    """In one worker, as pipelines use it: first the codec, then another operator."""

    def left(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(codec._machines)] * len(batch))], ["n"])

    left.__module__ = "another"
    encoded = codec.encode(docs(spark, [(1, "to be")]).coalesce(1), P.path(TIKTOKEN), P.PATTERN)
    assert encoded.count() == 1
    assert {r.n for r in common.in_batches(spark.range(0, 40, 1, 40).select("id"), left, "n long").collect()} == {0}


def around_blanks():
    rnd = random.Random(11)
    few = ["".join(rnd.choice("a \n.") for _ in range(rnd.randint(0, 9))) for _ in range(3000)]
    many = ["".join(rnd.choice("ab \n\t  .,!é日😀0\u3000\x1c'sd \x85\u2028") for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    return ["", " ", "  ", " a", "  a", "a  ", "a \n b", "\n \n", *few, *many, *texts(), *(t or "" for _, t in awkward())]


@pytest.mark.parametrize("pattern", [P.PATTERN, r"\S+\s*|\s+", r"\w{1,3}\W*|\W+"])
def test_batches_equal_the_library(machines, pattern, monkeypatch):
    monkeypatch.setattr(codec, "LONG", 50_000)
    encoder, decoder = codec.Encoder(machines[0].ranks, pattern), machines[1]
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=machines[0].ranks, special_tokens={})
    data = around_blanks()
    for at in range(0, len(data), 500):
        found = encoder.rows(pa.array(data[at : at + 500]))
        for text, ids in zip(data[at:], found):
            assert ids.tolist() == library.encode_ordinary(text), text[:50]
        assert decoder.rows(found) == [t.encode() for t in data[at : at + 500]]


def test_new_words_of_a_batch_are_read_side_by_side(machines, library, monkeypatch):
    """None of them goes through the transducer alone, and none is looked for by search."""

    def alone(self, *_):
        raise AssertionError("a word was read alone")

    encoder = codec.Encoder(machines[0].ranks, P.PATTERN)
    monkeypatch.setattr(codec.Encoder, "transduce", alone)
    monkeypatch.setattr(codec.Encoder, "_finish", alone)
    text = " ".join(f"{a}{b}" for a in ("un", "日本", "x", "over", "=") for b in range(300))
    assert [x.tolist() for x in encoder.rows(pa.array([text, "", text]))] == [library.encode_ordinary(t) for t in (text, "", text)]


def test_caches_of_batches_forget_and_go_on(machines, library, monkeypatch):
    for name, most in (("WORDS", 5), ("PIECES", 5)):
        monkeypatch.setattr(codec, name, most)
    encoder = codec.Encoder(machines[0].ranks, P.PATTERN)
    data = around_blanks()[:1500]
    for at in range(0, len(data), 100):
        assert [x.tolist() for x in encoder.rows(pa.array(data[at : at + 100]))] == [library.encode_ordinary(t) for t in data[at : at + 100]]


def test_neighbours_meet_as_the_merges_say(monkeypatch):
    """Any ranks, also those no training gives; few places to remember pairs in."""
    monkeypatch.setattr("pagetrail.llm.reader.REMEMBERED", 4)
    rnd = random.Random(2)
    for _ in range(20):
        strings = {bytes((x,)) for x in range(256)} | {bytes(rnd.choice(b"abc") for _ in range(rnd.randint(2, 5))) for _ in range(60)}
        order = rnd.sample(sorted(strings), len(strings))
        ranks = {s: i for i, s in enumerate(order)}
        rank_of = lambda a, b, get=ranks.get: get(a + b)
        tokens = {s: i for s, i in ranks.items() if len(merged(s, rank_of)) == 1}
        some = [s for s in tokens if set(s) <= set(b"abc")]
        pairs = [(a, b) for a in some for b in some]
        found = Reader(ranks, tokens).compatible(*(np.array([ranks[p[k]] for p in pairs], np.int64) for k in (0, 1)))
        assert found.tolist() == [merged(a + b, rank_of) == [a, b] for a, b in pairs]


def test_rows_of_ids_decode_as_the_machine_says(machines):
    _, decoder = machines
    rnd = random.Random(4)
    ids = lambda: [rnd.choice([rnd.randrange(256), rnd.randrange(50_000)]) for _ in range(rnd.randint(0, 12))]
    data = [ids() for _ in range(3000)]
    raw = [b"".join(decoder.bytes_of[i] for i in x) for x in data]
    assert decoder.rows([np.array(x, np.int32) for x in data]) == [x.decode("utf-8", "replace").encode() for x in raw]
    for wrong in (-1, len(decoder.bytes_of) + 5):
        with pytest.raises(KeyError):
            decoder.rows([np.array([wrong], np.int32)])


def test_null_ids_decode_as_none(spark, machines):
    encode = machines[0].encode
    table = spark.createDataFrame([(1, None), (2, encode("a 日")), (3, []), (4, encode("é"))], "doc_id long, ids array<int>")
    assert rows(codec.decode(table, P.path(TIKTOKEN), P.PATTERN)) == [(1, ""), (2, "a 日"), (3, ""), (4, "é")]
