"""Byte-level BPE encoding and decoding with finite-state machines.

Encoding.  Two neighbouring tokens are *compatible* if their joint bytes encode as just these two.
An encoding is a chain of compatible tokens, and every prefix of a word has exactly one such
chain.  So the merges act as a transducer that reads bytes: its state is the last token that is
certain and the bytes after it that are still open.  A later token can only begin where the
open bytes are a proper prefix of some token; what all chains to those places have in common is
certain and is emitted.  The lookahead is therefore bounded by the longest token.
A batch of texts is cut at blanks first and its distinct pieces are looked up, so a word that is
frequent is not handled at each of its places.  The batch's new words are read side by side
(``reader``).  Long words and single texts are read one by one, with states that are determinised
lazily: a transition is worked out when it is asked for again and kept.

Decoding.  An incremental UTF-8 machine whose states hold the bytes of an unfinished
character; its transitions over whole tokens are kept as well.  Tokens that are whole characters
leave the machine where it was, so it runs over the others only.
"""

from __future__ import annotations

import gc
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PART, merged, parts_of, read_ranks
from .common import in_batches, keep, text_or_empty
from .reader import Reader

#: Transitions and words a worker keeps; beyond it starts anew.
TRANSITIONS, WORDS = 250_000, 300_000

#: Pieces between blanks a task keeps, the first it meets; bytes from which a text is worked on in parts; bytes of texts and
#: ids worked on in one go.
PIECES, LONG, SLICE, AT_ONCE = 150_000, 4 << 20, 2 << 20, 1 << 18

#: Fixed value: the pattern for which it is known where a blank starts a match, and every character that any version of Unicode counts as white space.
_BLANK_STARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

#: log2 of the places that note which transitions were asked for.
_ASKED = 22

_NONE = np.empty(0, np.uint32)

_machines: dict[tuple[str, str], tuple[Encoder, Decoder]] = {}


class State:
    """``last``: the last certain token; ``open``: the bytes after it; ``ends``: for each place in ``open``
    the start and the id of the token that ends the chain there (None: no chain by ``last``);
    ``places``: where a later token may begin."""

    __slots__ = ("number", "last", "open", "ends", "places", "next", "rest")

    def __init__(self, number: int, last: int | None, open_: bytes, ends: list, places: list[int]) -> None:
        self.number = number
        self.last, self.open, self.ends, self.places = last, open_, ends, places
        self.next: dict[int, tuple[State, tuple[int, ...]]] | None = None
        self.rest: tuple[int, ...] | None = None


class Encoder(dict):
    """Packed ids by word; words not met before go through the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        super().__init__()
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        get = ranks.get
        self.rank_of = lambda a, b: get(a + b)
        # tokens that do not encode as themselves never occur
        self.tokens = {t: i for t, i in ranks.items() if len(merged(t, self.rank_of)) == 1}
        self.bytes_of = {i: t for t, i in self.tokens.items()}
        # for bytes that are a token, begin one, or both: id * 2 + (begins one); id -1 if they are none
        self.role = {t[:n]: -1 for t in self.tokens for n in range(1, len(t))}
        self.role |= {t: i * 2 + (t in self.role) for t, i in self.tokens.items()}
        self.pairs: dict[int, bool] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        # a vocabulary without all bytes has no chain for some words
        self.reader = Reader(ranks, self.tokens) if all(bytes((x,)) in self.tokens for x in range(256)) else None
        self.restart()

    def restart(self) -> None:
        self.known: dict[tuple[int | None, bytes], State] = {}
        if len(self.pairs) > 2 * TRANSITIONS:
            self.pairs.clear()
        self.made = 0
        self.asked = bytearray(1 << _ASKED)
        self.start = State(0, None, b"", [(-1, -1)], [0])

    def forget(self) -> None:
        """Drops words and transitions, for a worker goes on with other work; known pairs stay."""
        self.clear()
        self.older, self.pieces = {}, {}
        self.restart()

    def compatible(self, a: int | None, b: int) -> bool:
        if a is None:
            return True
        pair = a << 32 | b
        if pair not in self.pairs:
            x, y = self.bytes_of[a], self.bytes_of[b]
            self.pairs[pair] = merged(x + y, self.rank_of) == [x, y]
        return self.pairs[pair]

    def _advance(self, last: int | None, open_: bytes, ends: list, places: list[int]) -> list[int]:
        """Takes in the last byte of ``open_``: adds to ``ends`` and gives the places where a token may begin from here on."""
        role_of, pairs = self.role.get, self.pairs
        found, live = None, []
        for begin in places:
            tail = open_[begin:]
            role = role_of(tail)
            if role is None:
                continue
            if found is None and role != -1:
                before, token = ends[begin][1] if begin else last, role >> 1
                good = before is None or pairs.get(before << 32 | token)
                if good is None:
                    good = self.compatible(before, token)
                if good:
                    found = (begin, token)
            if role & 1:
                live.append(begin)
        if found is not None:
            live.append(len(open_))
        ends.append(found)
        return live

    def _step(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        open_, ends, last = state.open + bytes((byte,)), state.ends.copy(), state.last
        n = len(open_)
        live = self._advance(last, open_, ends, state.places)
        # where the chains to all places meet; what lies before is certain
        cut = live[0]
        for p in live:
            if not cut:
                break
            while p > cut:
                p = ends[p][0]
            while cut > p:
                cut = ends[cut][0]
                while p > cut:
                    p = ends[p][0]
        certain: tuple[int, ...] = ()
        if cut:
            chain, p = [], cut
            while p > 0:
                p, token = ends[p]
                chain.append(token)
            certain = tuple(chain[::-1])
            last, open_ = chain[0], open_[cut:]
        key = (last, open_)
        after = self.known.get(key)
        if after is None:
            if cut:
                moved: list[tuple[int, int] | None] = [(-1, -1)]
                for p in range(cut + 1, n + 1):
                    e = ends[p]
                    moved.append((e[0] - cut, e[1]) if e is not None and e[0] >= cut and moved[e[0] - cut] is not None else None)
                ends, live = moved, [p - cut for p in live]
            after = self.known[key] = State(len(self.known) + 1, last, open_, ends, live)
        return after, certain

    def transduce(self, word: bytes) -> list[int]:
        """Ids of one match of the pattern.

        A transition that is missing is made when it is asked for again; the first time, a short rest of the word is
        read without keeping its states.
        """
        if self.made > TRANSITIONS:
            self.restart()
            gc.collect()
        state, out = self.start, []
        for at, byte in enumerate(word):
            arrows = state.next
            arrow = arrows.get(byte) if arrows is not None else None
            if arrow is None:
                place = (state.number * 2654435761 + byte * 40503) & ((1 << _ASKED) - 1)
                if not self.asked[place] and len(word) - at <= 32:
                    self.asked[place] = 1
                    return out + self._finish(state, word[at:])
                if arrows is None:
                    arrows = state.next = {}
                arrow = arrows[byte] = self._step(state, byte)
                self.made += 1
            state, emitted = arrow
            if emitted:
                out += emitted
        if state.rest is None:
            state.rest = tuple(self._finish(state, b""))
        out += state.rest
        return out

    def _ahead(self, word: bytes, begin: int) -> list[tuple[int, int]]:
        """(end, id) of the tokens that begin at a place, short to long."""
        role_of, out = self.role.get, []
        for end in range(begin + 1, len(word) + 1):
            role = role_of(word[begin:end])
            if role is None:
                break
            if role != -1:
                out.append((end, role >> 1))
            if not role & 1:
                break
        return out

    def _finish(self, state: State, rest: bytes) -> list[int]:
        """What a word that ends with ``rest`` after this state still emits.

        Looks for the chain from the front, long tokens first.  A place that can't be left again is left out from then on:
        the chain to it is the only one, so no other way there needs to be tried.
        """
        word, last, pairs = state.open + rest, state.last, self.pairs
        n, at, chain, ways, closed = len(word), 0, [], [], set()
        ahead = self._ahead(word, 0)
        while at < n:
            while ahead:
                end, token = ahead.pop()
                if end in closed:
                    continue
                good = last is None or pairs.get(last << 32 | token)
                if good is None:
                    good = self.compatible(last, token)
                if good:
                    ways.append((at, last, ahead))
                    chain.append(token)
                    at, last = end, token
                    ahead = self._ahead(word, at)
                    break
            else:
                closed.add(at)
                at, last, ahead = ways.pop()
                chain.pop()
        return chain

    def __missing__(self, word: str) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            packed = array("I", self.transduce(word.encode())).tobytes()
        if len(word) <= 64:
            if len(self) >= WORDS:  # what is used again comes back from the older half
                self.older = dict(self)
                self.clear()
            self[word] = packed
        return packed

    def packed(self, text: str) -> bytes:
        """Ids as native unsigned 32-bit integers."""
        words = self.pattern.findall
        return b"".join([b"".join(map(self.__getitem__, words(part))) for part in parts_of(text)])

    def encode(self, text: str) -> list[int]:
        return array("I", self.packed(text)).tolist()

    def _learn(self, words: set[str]) -> None:
        """Lets the words not met before go through the transducer side by side; long ones go one by one when asked for."""
        new = [w for w in words if w not in self and w not in self.older and 0 < len(w) <= 64]
        if self.reader is None or not new:
            return
        if len(self) >= WORDS:
            self.older = dict(self)
            self.clear()
        self.update(zip(new, self.reader.read([w.encode() for w in new])))

    def _after_blank(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of a blank and a piece, for each piece."""
        kept = self.pieces
        out = list(map(kept.get, pieces))
        new = [i for i, packed in enumerate(out) if packed is None]
        for i, packed in zip(new, self._matched([" " + pieces[i] for i in new])):
            out[i] = packed
            if len(pieces[i]) <= 64 and len(kept) < PIECES:
                kept[pieces[i]] = packed
        return out

    def _matched(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts that the pattern is matched on; long ones part by part."""
        out = [b""] * len(texts)
        cut: dict[int, list[bytes]] = {}
        found: list[tuple[int, list[str]]] = []
        size, words, get = 0, self.pattern.findall, self.__getitem__

        def join() -> None:
            self._learn({w for _, x in found for w in x})
            for row, x in found:
                packed = b"".join(map(get, x))
                if row in cut:
                    cut[row].append(packed)
                else:
                    out[row] = packed
            found.clear()

        for row, text in enumerate(texts):
            if len(text) > 2 * PART:
                cut[row] = []
            for part in parts_of(text) if row in cut else (text,):
                found.append((row, words(part)))
                size += len(part)
                if size >= 8 * PART:
                    join()
                    size = 0
        join()
        for row, packed in cut.items():
            out[row] = b"".join(packed)
        return out

    def rows(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        return [ids for a, z in zip(cuts, cuts[1:]) for ids in self._slice(texts.slice(a, z - a))]

    def _slice(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of a few MB of texts.

        Matches of the pattern never go on over a blank next to something else, on either side of it.  Texts that have a blank
        between white space, very long ones and other patterns are matched as a whole.
        """
        alone = pc.greater(pc.binary_length(texts), LONG).to_numpy(zero_copy_only=False)
        if self.pattern.pattern != _BLANK_STARTS:
            alone[:] = True
        if alone.all():
            return [np.frombuffer(x, np.uint32) for x in self._matched(texts.to_pylist())]
        split = pc.split_pattern(pc.if_else(pa.array(alone), "", texts), " ")
        begins = split.offsets.to_numpy().astype(np.int64)
        found = split.values.dictionary_encode()
        codes, pieces = found.indices.to_numpy(), found.dictionary
        opens = pc.match_substring_regex(pieces, rf"^(?:{_SPACE}|\z)").to_numpy(zero_copy_only=False)
        closes = pc.match_substring_regex(pieces, rf"(?:^|{_SPACE})\z").to_numpy(zero_copy_only=False)
        within = closes[codes[:-1]] & opens[codes[1:]]
        within[begins[1:-1] - 1] = False  # neighbours in two texts
        alone[np.searchsorted(begins, np.flatnonzero(within), "right") - 1] = True

        # the first piece of a text has no blank before it: an entry of its own, behind those of the others
        row_of = np.repeat(np.arange(len(texts)), np.diff(begins))
        used = np.zeros(len(pieces), bool)
        follows = ~alone[row_of]
        follows[begins[:-1]] = False
        used[codes[follows]] = True
        number = np.cumsum(used) - 1
        packed = self._after_blank(pieces.filter(pa.array(used)).to_pylist())
        entries = np.where(follows, number[codes], 0)
        entries[begins[:-1]] = len(packed) + np.arange(len(texts))
        firsts = pieces.take(pa.array(codes[begins[:-1]])).to_pylist()
        others = np.flatnonzero(alone).tolist()
        matched = self._matched(["" if x else t for x, t in zip(alone.tolist(), firsts)] + [texts[i].as_py() for i in others])
        packed += matched[: len(texts)]
        lengths = np.fromiter(map(len, packed), np.int64, len(packed)) >> 2
        ends = np.concatenate(([0], np.cumsum(lengths)))
        table = np.frombuffer(b"".join(packed), np.uint32)
        keeps = ~alone[row_of]
        entries = entries[keeps]
        sizes = lengths[entries]
        after = np.concatenate(([0], np.cumsum(sizes)))
        ids = table[np.repeat(ends[entries] - after[:-1], sizes) + np.arange(after[-1])]
        at = after[np.concatenate(([0], np.cumsum(np.bincount(row_of[keeps], minlength=len(texts)))))]
        rows = [ids[a:z] for a, z in zip(at[:-1], at[1:])]
        for i, x in zip(others, matched[len(texts) :]):
            rows[i] = np.frombuffer(x, np.uint32)
        return rows


def _utf8_step(held: bytes, byte: int) -> tuple[bytes, str]:
    """One byte of the UTF-8 machine: the unfinished character after it, and finished text."""
    if held:
        first, n = held[0], len(held)
        need = 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        low, high = 0x80, 0xBF
        if n == 1:  # no overlong forms, no surrogates, nothing above U+10FFFF
            low = {0xE0: 0xA0, 0xF0: 0x90}.get(first, low)
            high = {0xED: 0x9F, 0xF4: 0x8F}.get(first, high)
        if low <= byte <= high:
            held += bytes((byte,))
            return (b"", held.decode()) if len(held) == need else (held, "")
        after, text = _utf8_step(b"", byte)
        return after, "�" + text
    if byte < 0x80:
        return b"", chr(byte)
    if 0xC2 <= byte <= 0xF4:
        return bytes((byte,)), ""
    return b"", "�"


class Decoder:
    """Ids to text, token by token; bytes that are no UTF-8 give U+FFFD."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.next: dict[bytes, dict[int, tuple[bytes, str]]] = {b"": {i: self._over(b"", i) for i in self.bytes_of}}
        self.whole = {i: text for i, (held, text) in self.next[b""].items() if not held}
        # by id: bytes, their number, and whether they are no whole characters
        top = max(self.bytes_of, default=-1) + 1
        self.table = pa.array([self.bytes_of.get(i, b"") for i in range(top)], pa.binary())
        self.size = np.array([len(self.bytes_of.get(i, b"")) for i in range(top)], np.int64)
        self.broken = np.array([i not in self.whole or self.whole[i].encode() != self.bytes_of[i] for i in range(top)], bool)

    def _over(self, held: bytes, token: int) -> tuple[bytes, str]:
        text = ""
        for byte in self.bytes_of[token]:
            held, more = _utf8_step(held, byte)
            text += more
        return held, text

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        held = b""
        arrows = self.next[held]
        for token in ids:
            arrow = arrows.get(token)
            if arrow is None:
                arrow = arrows[token] = self._over(held, token)
            if arrow[0] is not held:
                held = arrow[0]
                arrows = self.next.setdefault(held, {})
            if arrow[1]:
                yield arrow[1]
        if held:
            yield "�"

    def decode(self, ids: Iterable[int]) -> str:
        """The machine, with the transitions that begin and end between characters taken in one go."""
        texts = list(map(self.whole.get, ids))
        if None not in texts:
            return "".join(texts)
        return "".join(self.stream(ids))

    def rows(self, rows: list[np.ndarray]) -> list[bytes]:
        """Text of each row of ids, in UTF-8.

        Whole characters begin and end the machine's run, so only the runs of other tokens go through it.
        """
        out, part, room = [], [], AT_ONCE
        for ids in rows:
            if part and len(ids) > room:
                out += self._together(part)
                part, room = [], AT_ONCE
            part.append(ids)
            room -= len(ids)
        return out + (self._together(part) if part else [])

    def _bytes(self, ids: np.ndarray) -> memoryview:
        return memoryview(self.table.take(pa.array(ids)).buffers()[2])[: int(self.size[ids].sum())]

    def _together(self, rows: list[np.ndarray]) -> list[bytes]:
        ids = np.concatenate(rows)
        if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < len(self.size):
            raise KeyError(f"ids outside the vocabulary: {ids.min()} to {ids.max()}")
        ends = np.concatenate(([0], np.cumsum(self.size[ids])))
        raw = b"".join(self._bytes(ids[i : i + AT_ONCE]) for i in range(0, len(ids), AT_ONCE))
        first = np.concatenate(([0], np.cumsum([len(x) for x in rows])))
        # runs of tokens that are no whole characters, within a row
        broken = self.broken[ids]
        before, behind = np.roll(broken, 1), np.roll(broken, -1)
        full = first[:-1][np.diff(first) > 0]
        before[full] = False
        behind[full - 1] = False  # the last of the row before; -1 is the last of all
        texts: dict[bytes, bytes] = {}
        other: dict[int, list[tuple[int, int, bytes]]] = {}
        begins, stops = np.flatnonzero(broken & ~before), np.flatnonzero(broken & ~behind) + 1
        for begin, stop, a, z in zip(begins.tolist(), stops.tolist(), ends[begins].tolist(), ends[stops].tolist()):
            run = ids[begin:stop]
            text = texts.get(packed := run.tobytes())
            if text is None:
                text = texts[packed] = "".join(self.stream(run.tolist())).encode()
            if text != raw[a:z]:
                other.setdefault(int(np.searchsorted(first, begin, "right")) - 1, []).append((a, z, text))
        at = ends[first].tolist()
        out = [raw[a:z] for a, z in zip(at, at[1:])]
        for row, changes in other.items():
            done, parts = at[row], []
            for a, z, text in changes:
                parts += raw[done:a], text
                done = z
            out[row] = b"".join([*parts, raw[done : at[row + 1]]])
        return out


def machines(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    """One pair per worker process, until it does other work: its tables take about 80 MB."""
    if (path, pattern) not in _machines:
        ranks = read_ranks(path)
        _machines[path, pattern] = Encoder(ranks, pattern), Decoder(ranks)
        gc.freeze()  # not searched for cycles in every task
        keep(__name__, _drop_machines)
    return _machines[path, pattern]


def _drop_machines() -> None:
    _machines.clear()
    gc.unfreeze()


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, ids (array of int).

    ``path`` is a rank file every executor has; each match of ``pattern`` is encoded separately.  A null
    text counts as empty and has no ids.  Null keys and repeated rows stay; very long texts are
    worked on in parts; an empty table gives an empty one; extra columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = machines(path, pattern)
        for batch in batches:
            rows = encoder.rows(batch.column(1))
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, _NONE]).view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["key", "ids"])
        encoder.forget()

    rows = docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("body"))
    return in_batches(rows, run, "key long, ids array<int>").select(F.col("key").alias(key), "ids")


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per row of ``encoded``: key, text.  Null ids decode as none; ids outside the vocabulary are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = machines(path, pattern)
        for batch in batches:
            lists = batch.column(1)
            ids = lists.flatten()
            if ids.null_count:
                raise KeyError("ids outside the vocabulary: null")
            ids, lengths = ids.to_numpy(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            texts = decoder.rows([ids[z - n : z] for n, z in zip(lengths, np.cumsum(lengths))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["key", "text"])

    rows = encoded.select(F.col(key).cast("long").alias("key"), F.col(ids).cast("array<int>").alias("ids"))
    return in_batches(rows, run, "key long, text string").select(F.col("key").alias(key), "text")


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes in one pass: key, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit
    integers), decoded_sha256 (the decoded bytes).  Defined results as for ``encode``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = machines(path, pattern)
        for batch in batches:
            rows = encoder.rows(batch.column(1))
            n = [len(ids) for ids in rows]
            a = [hashlib.sha256(ids.astype("<u4", copy=False).tobytes()).hexdigest() for ids in rows]
            b = [hashlib.sha256(text).hexdigest() for text in decoder.rows(rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        encoder.forget()

    rows = docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("body"))
    schema = "key long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return in_batches(rows, run, schema).withColumnRenamed("key", key)
