"""Byte-level BPE vocabularies: files, byte alphabet, merges by rank."""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator

import regex

#: A text is cut into parts of about so many characters before the pattern runs over it.
PART = 1 << 16

#: Fixed value: a blank that follows something else always starts a match of the pattern.
_SAFE = regex.compile(r"(?<=\S)(?=\s)")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, by rule:
    printable Latin-1 bytes stand for themselves, the others follow from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_json(path: str) -> tuple[dict[bytes, int], dict[tuple[bytes, bytes], int], dict[str, int]]:
    """Ids by bytes, merge ranks by pair, special strings of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    back = byte_alphabet()
    special = {x["content"]: x["id"] for x in file["added_tokens"]}
    raw = lambda s: bytes(back[c] for c in s)
    ids = {raw(s): i for s, i in file["model"]["vocab"].items() if s not in special}
    merges = {}
    for rank, pair in enumerate(file["model"]["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges[raw(a), raw(b)] = rank
    return ids, merges, special


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def parts_of(text: str) -> Iterator[str]:
    """The text in parts no match of the pattern crosses; one part if there is no place to cut."""
    at = 0
    while len(text) - at > 2 * PART:
        cut = _SAFE.search(text, at + PART)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def merged(word: bytes, rank_of) -> list[bytes]:
    """The pieces of a word after all merges, lowest rank first, leftmost of equals.

    ``rank_of(a, b)`` is the rank of joining two pieces, or None.
    """
    pieces = [word[i : i + 1] for i in range(len(word))]
    if len(pieces) > 64:
        return _merged_long(pieces, rank_of)
    ranks = [rank_of(a, b) for a, b in zip(pieces, pieces[1:])]
    while True:
        best, at = None, -1
        for i, r in enumerate(ranks):
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            return pieces
        pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        del ranks[at]
        if at < len(ranks):
            ranks[at] = rank_of(pieces[at], pieces[at + 1])
        if at:
            ranks[at - 1] = rank_of(pieces[at - 1], pieces[at])


def _merged_long(pieces: list[bytes], rank_of) -> list[bytes]:
    """The same with a heap over a linked list: n log n for very long words."""
    n = len(pieces)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(r, i, pieces[i], pieces[i + 1]) for i in range(n - 1) if (r := rank_of(pieces[i], pieces[i + 1])) is not None]
    heapq.heapify(heap)
    held: list[bytes | None] = list(pieces)

    def push(i: int) -> None:
        if i >= 0 and after[i] >= 0 and (r := rank_of(held[i], held[after[i]])) is not None:
            heapq.heappush(heap, (r, i, held[i], held[after[i]]))

    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if held[i] != a or held[i] is None or j < 0 or held[j] != b:
            continue
        held[i], held[j] = a + b, None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        after[j] = -1
        push(before[i])
        push(i)
    return [x for x in held if x is not None]
