"""The transducer of ``codec`` over many words at once, in arrays.

All words are read side by side, a byte of each in a step.  What a word's state holds is the same: the token that ends
the chain at each place, and the places where a later token may have begun.  Nothing is searched and nothing is taken back; at
the end of a word its chain is followed from the last place.
"""

from __future__ import annotations

from array import array

import numpy as np

#: Bytes of words that are read at once; log2 of the places for pairs whose compatibility is remembered.
AT_ONCE, REMEMBERED = 1 << 18, 20

#: Fixed value: the rank of a merge that never comes.
_NEVER = 1 << 40


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class Numbers:
    """A fixed map from distinct numbers to numbers, -1 where there is none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, (3 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        at = _slots(keys, self.bits)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]
            placed = self.keys[at] == keys  # of several that want a place, one has it
            self.values[at[placed]] = values[placed]
            keys, values, at = keys[~placed], values[~placed], (at[~placed] + 1) & (len(self.keys) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = _slots(keys, self.bits)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        left = np.flatnonzero((there != keys) & (there != -1))
        while len(left):
            at[left] = place = (at[left] + 1) & (len(self.keys) - 1)
            there, wanted = self.keys[place], keys[left]
            hit = there == wanted
            out[left[hit]] = self.values[place[hit]]
            left = left[~hit & (there != -1)]
        return out


def _history(token: bytes, ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """Before each merge of a token's own bytes, and after the last: rank of the next merge, first and last piece."""
    pieces, out = [token[i : i + 1] for i in range(len(token))], []
    while True:
        best, at = _NEVER, -1
        for i, (a, b) in enumerate(zip(pieces, pieces[1:])):
            rank = ranks.get(a + b, _NEVER)
            if rank < best:
                best, at = rank, i
        out.append((best, ranks[pieces[0]], ranks[pieces[-1]]))
        if at < 0:
            return out
        pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]


class Reader:
    """``tokens``: the ids of all strings that encode as themselves, among them every byte."""

    def __init__(self, ranks: dict[bytes, int], tokens: dict[bytes, int]) -> None:
        number = {b"": 0}
        for token in tokens:
            for n in range(1, len(token) + 1):
                number.setdefault(token[:n], len(number))
        self.token = np.array([tokens.get(x, -1) for x in number], np.int64)
        self.first = np.array([number[bytes((x,))] for x in range(256)], np.int64)
        nodes = [x for x in number if x]
        self.child = Numbers(np.array([number[x[:-1]] << 8 | x[-1] for x in nodes], np.int64), np.array([number[x] for x in nodes]))
        # two pieces that a merge joins, and its rank
        joins = array("q")
        for token, i in ranks.items():
            for n in range(1, len(token)):
                if (a := ranks.get(token[:n])) is not None and (b := ranks.get(token[n:])) is not None:
                    joins.extend((a << 32 | b, i))
        self.joins = Numbers(*np.array(joins).reshape(-1, 2).T)
        self.begin = np.zeros(max(tokens.values()) + 1, np.int64)
        stages = array("q")
        for token, i in tokens.items():
            self.begin[i] = len(stages) // 3
            for stage in _history(token, ranks):
                stages.extend(stage)
        self.rank, self.left, self.right = np.array(stages).reshape(-1, 3).T.copy()
        self.kept = np.full(1 << REMEMBERED, -1, np.int64)

    def _meet(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges of two neighbours, in the order of their ranks, end before one joins a piece of each.

        Of equal ranks the leftmost comes first: those within ``a``, then the one across, then those within ``b``.
        """
        good = np.zeros(len(a), bool)
        left, i, j = np.arange(len(a)), self.begin[a], self.begin[b]
        while len(left):
            across = self.joins.get(self.right[i] << 32 | self.left[j]).astype(np.int64)
            across[across < 0] = _NEVER
            mine, other = self.rank[i], self.rank[j]
            joined = (across < mine) & (across <= other)
            over = ~joined & (mine == _NEVER) & (other == _NEVER)
            good[left[over]] = True
            go = ~(joined | over)
            within = mine <= other
            left, i, j = left[go], (i + within)[go], (j + ~within)[go]
        return good

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 32 | b
        there = self.kept[_slots(keys, REMEMBERED)]
        good = (there & 1).astype(bool)
        new = np.flatnonzero(there >> 1 != keys)
        if len(new):
            pairs, back = np.unique(keys[new], return_inverse=True)
            found = self._meet(pairs >> 32, pairs & 0xFFFFFFFF)
            good[new] = found[back]
            self.kept[_slots(pairs, REMEMBERED)] = pairs << 1 | found
        return good

    def _tokens(self, text: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every token in the words: begin, last byte, id; ``limit``: where the word of a byte ends."""
        begin, node, found, last = np.arange(len(text)), self.first[text], [], np.arange(len(text))
        while len(begin):
            token = self.token[node]
            full = token >= 0
            found.append((begin[full], last[full], token[full]))
            more = last + 1 < limit[begin]
            begin, node, last = begin[more], node[more], last[more] + 1
            node = self.child.get(node << 8 | text[last]).astype(np.int64)
            more = node >= 0
            begin, node, last = begin[more], node[more], last[more]
        return tuple(map(np.concatenate, zip(*found)))

    def _read(self, words: list[bytes]) -> list[bytes]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate(([0], np.cumsum(sizes)))
        text = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        start = np.repeat(starts[:-1], sizes)
        begin, last, token = self._tokens(text, np.repeat(starts[1:], sizes))
        place = last - start[last]
        order = np.argsort(place.astype(np.uint16), kind="stable")
        begin, last, token = begin[order], last[order], token[order]
        steps = np.concatenate(([0], np.cumsum(np.bincount(place))))
        whole = begin == start[last]
        # by last byte: the token that ends the chain there, and its first byte
        ends, since = np.full(len(text), -1, np.int64), np.zeros(len(text), np.int64)
        for a, z in zip(steps[:-1].tolist(), steps[1:].tolist()):
            good = whole[a:z].copy()
            rest = np.flatnonzero(~good)
            good[rest] = self.compatible(ends[begin[a:z][rest] - 1], token[a:z][rest])
            at = last[a:z][good]
            ends[at], since[at] = token[a:z][good], begin[a:z][good]
        chain = np.zeros(len(text), bool)
        at = starts[1:] - 1
        while len(at):
            chain[at] = True
            before = since[at]
            at = before[before != start[at]] - 1
        counts = np.add.reduceat(chain.astype(np.int64), starts[:-1])
        packed, cuts = ends[chain].astype(np.uint32).tobytes(), [0, *(4 * np.cumsum(counts)).tolist()]
        return [packed[a:z] for a, z in zip(cuts, cuts[1:])]

    def read(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as native unsigned 32-bit integers; no word is empty or longer than 2^16 bytes."""
        out, part, size = [], [], 0
        for word in words:
            part.append(word)
            size += len(word)
            if size >= AT_ONCE:
                out += self._read(part)
                part, size = [], 0
        return out + (self._read(part) if part else [])
