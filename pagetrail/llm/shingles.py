"""Five-word shingle sets as sorted 64-bit hashes, computed with numpy over whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5

#: Bytes of text worked on at once (a longer text is worked on alone).
SLICE = 1 << 18

_rng = np.random.default_rng(20_240_501)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_PLACE = _rng.integers(0, 1 << 63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _letters(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each byte with its place in the word.  Words are sums of these: unlike a polynomial
    of the bytes, no arrangement of letters is known to make two sums equal."""
    return mixed(_BYTE[data] + at.astype(np.uint64) * _STEP)


#: The same by table, for the first places of a word.
_NEAR = 64
_TABLE = _letters(np.tile(np.arange(256, dtype=np.uint8), _NEAR), np.repeat(np.arange(_NEAR), 256))


def _sets(data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The set of each text; ``ends`` has where each ends in ``data``."""
    n = len(data)
    empty = np.zeros(0, np.uint64)
    if n == 0:
        return [empty] * len(ends)
    inside = _IN_WORD[data]
    edge = np.ones(n + 1, bool)
    edge[1:n] = inside[1:] != inside[:-1]
    edge[ends] = True
    starts = np.flatnonzero(edge[:n])
    stops = np.append(starts[1:], n)
    at = np.arange(n, dtype=np.int32) - np.repeat(starts.astype(np.int32), stops - starts)
    hashed = _TABLE[(np.minimum(at, _NEAR - 1) << 8) | data]
    far = np.flatnonzero(at >= _NEAR)
    if len(far):
        hashed[far] = _letters(data[far], at[far])
    keep = inside[starts]
    starts, stops = starts[keep], stops[keep]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashed, out=total[1:])
    words = mixed(total[stops] - total[starts])
    owner = np.searchsorted(ends, starts, side="right")
    bounds = np.searchsorted(owner, np.arange(len(ends) + 1))
    if len(words) >= WORDS:
        m = len(words) - WORDS + 1
        full = words[:m] * _PLACE[0]
        for k in range(1, WORDS):
            full = full + words[k : k + m] * _PLACE[k]
        full = mixed(full)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= WORDS:
            found = np.sort(full[a : b - WORDS + 1])
            fresh = np.ones(len(found), bool)
            np.not_equal(found[1:], found[:-1], out=fresh[1:])
            out.append(found[fresh])
        elif b > a:
            short = (words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mixed(short + _PLACE[WORDS:] * np.uint64(b - a)))
        else:
            out.append(empty)
    return out


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct hashes for each text; a null or one without words has none."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else ()
    if len(texts) == 0:
        return
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        begin = int(offsets[at])
        to = int(np.searchsorted(offsets, begin + SLICE, side="right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield from _sets(data[begin : int(offsets[to])], offsets[at + 1 : to + 1].astype(np.int64) - begin)
        at = to


def words_of(text: str) -> list[bytes]:
    """The words as the sets see them; for tests."""
    low = bytes(c | 0x20 if 65 <= c <= 90 else c for c in text.encode())
    return low.translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ")
