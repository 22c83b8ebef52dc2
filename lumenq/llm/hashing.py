"""Words and word windows of many texts at once, as NumPy arrays.

Texts are handled as UTF-8. Words are runs of bytes other than space and
09-0D, which is the same as `[^\\x20\\x09-\\x0D]+` over code points, as all
separators are ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 19

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
_BASES = (0x2545F4914F6CDD1D, 0xD1342543DE82EF95, 0xAEF17502108EF2D9)
_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | U(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.ones(1, U)
        step = b
        while len(p) < size:
            p = np.concatenate([p, p * U(step)])
            step = step * step % (1 << 64)
        out.append(p[:size])
    return out[0], out[1]


def _room(n: int) -> int:
    return max(CHUNK_BYTES * 2, 1 << int(n).bit_length())


def ranges_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each pair, in time O(1) each."""
    power, inverse = _powers(_BASES[which], _room(len(values) + 1))
    total = np.empty(len(values) + 1, U)
    total[0] = 0
    np.cumsum(values * power[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U) * _ODD)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUE[data]


class Chunk:
    """Some whole texts, joined by newlines: data, and where each begins and ends."""

    def __init__(self, rows: np.ndarray, texts: list[bytes], lower: bool = False):
        self.rows, self.texts = rows, texts
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if lower:
            self.data = LOWER[self.data]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.size = size
        self.end = np.cumsum(size + 1) - 1
        self.begin = self.end - size

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, byte after the last, and text of each word."""
        word = np.concatenate([[False], ~SEPARATOR[self.data]])
        edge = np.flatnonzero(word[1:] != word[:-1])
        start, end = edge[::2], edge[1::2]
        return start, end, np.searchsorted(self.end, start)

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[self.end] - total[self.begin]

    def first(self, owner: np.ndarray) -> np.ndarray:
        """Where each text's entries begin in a sorted array of owners, and the end."""
        return np.searchsorted(owner, np.arange(len(self.texts) + 1))


def word_hashes(chunk: Chunk, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return ranges_hash(byte_values(chunk.data), start, end)


def windows(hashes: np.ndarray, owner: np.ndarray, length: int, which: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every window of so many words of one text."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, U)
    at = np.flatnonzero(owner[:n] == owner[length - 1 :])
    return at, ranges_hash(hashes, at, at + length, which)


def covered(at: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n words are in a window of that length that begins in at."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + length, -1)
    return np.cumsum(change[:n]) > 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[place] == keys


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def chunks(texts: list[bytes | None], lower: bool = False) -> Iterator[Chunk]:
    """Texts in turn (null: empty), a bounded number of bytes at once."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text is not None else 0
        if i > first and size + n > CHUNK_BYTES:
            yield Chunk(np.arange(first, i), [t or b"" for t in texts[first:i]], lower)
            first, size = i, 0
        size += n + 1
    if len(texts) > first:
        yield Chunk(np.arange(first, len(texts)), [t or b"" for t in texts[first:]], lower)
