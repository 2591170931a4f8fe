"""Vectorised word splitting and window hashing over a column of texts.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  Those bytes never occur inside a
multi-byte UTF-8 character, so splitting bytes equals splitting the text.  Hashes are polynomial
sums modulo 2**64 over mixed symbols; every array operation runs over a block of many texts.
"""

from __future__ import annotations

import numpy as np

BLOCK_BYTES = 2 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finaliser of splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SYMBOL = mix(np.arange(256, dtype=np.uint64))


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k modulo 2**64 for k below n; kept for later blocks."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(int(base), -1, 1 << 64)
        step = np.full(size, base, dtype=np.uint64)
        step[0] = 1
        back = np.full(size, np.uint64(inverse), dtype=np.uint64)
        back[0] = 1
        have = (np.multiply.accumulate(step), np.multiply.accumulate(back))
        _powers[int(base)] = have
    return have


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words in a byte array."""
    word = np.zeros(len(data) + 2, dtype=np.int8)
    word[1:-1] = ~_SPACE[data]
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, forward: np.ndarray) -> np.ndarray:
    """Hash of symbols start..end from prefix sums of symbol * base**-k."""
    return (prefix[end] - prefix[start]) * forward[start]


def prefix_sums(symbols: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    forward, back = powers(base, len(symbols) + 1)
    prefix = np.zeros(len(symbols) + 1, dtype=np.uint64)
    np.cumsum(symbols * back[: len(symbols)], out=prefix[1:])
    return prefix, forward


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    prefix, forward = prefix_sums(_SYMBOL[data], _BASES[0])
    return mix(range_hash(prefix, start, end, forward) + (end - start).astype(np.uint64))


def window_hashes(words: np.ndarray, start: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Hashes of `length` consecutive words from each start."""
    prefix, forward = prefix_sums(words, _BASES[salt])
    return mix(range_hash(prefix, start, start + length, forward))


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES):
    """Slices (from, to) of texts of about `limit` bytes; a longer text is a block of its own."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield first, i
            first = i
            size = 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


class Words:
    """The words of a block of texts: hash per word, text of each word, first word of each text."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        if lower:
            data = _LOWER[data]
        self.data = data
        self.start, self.end = spans(data)
        at = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=at[1:])
        self.first = np.searchsorted(self.start, at)  # word range of text i: first[i]..first[i + 1]
        self.count = np.diff(self.first)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        """In pieces, so that a very long text takes bounded scratch memory."""
        step = BLOCK_BYTES
        if len(self.data) <= 2 * step:
            return word_hashes(self.data, self.start, self.end)
        out = np.empty(len(self.start), dtype=np.uint64)
        i = 0
        while i < len(self.start):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + step)))
            a, b = self.start[i], self.end[j - 1]
            out[i:j] = word_hashes(self.data[a:b], self.start[i:j] - a, self.end[i:j] - a)
            i = j
        return out

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def place(self) -> np.ndarray:
        """The position of each word in its text."""
        return np.arange(len(self.start)) - np.repeat(self.first[:-1], self.count)
