"""Words of many texts at once, as NumPy arrays over their UTF-8 bytes.

Separators of all contracts are ASCII, so a word is a run of bytes that a 256-entry table marks; bytes of
longer code points are always word bytes. Words get 64-bit hashes, windows of n words get hashes that are
composed from doubled windows. Hashes only select candidates or stand for set elements.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from lumenfield.llm.batches import text_bytes

SPACES = np.ones(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = False
#: word bytes where only digits, small letters and everything beyond ASCII count
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_STEP, _LEFT = _U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the public SplitMix64 finaliser)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ordered combination of two hashes."""
    return mix(a * _LEFT + b)


@dataclass
class Words:
    """Words of a block of texts: byte range and hash of each, and the first word of each text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # n texts + 1
    hash: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def split(texts: pa.Array, is_word: np.ndarray = SPACES, fold: bool = False) -> Words:
    return split_bytes(*text_bytes(texts), is_word, fold)


def split_bytes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = SPACES, fold: bool = False) -> Words:
    """Words of texts given as one array of bytes and n + 1 offsets."""
    if fold:
        data = FOLD[data]
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(data, z, z, np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64))
    w = is_word[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, w[:-1]
    after[-1], after[:-1] = False, w[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start, end = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    first = np.searchsorted(start, offsets)
    return Words(data, start, end, first, _hashes(data[w], end - start))


def split_pieces(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges, which are in order and do not overlap."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    return _hashes(data[np.cumsum(edge[:-1], dtype=np.int8) > 0], end - start)


def _hashes(letters: np.ndarray, size: np.ndarray) -> np.ndarray:
    if not len(size):
        return np.zeros(0, np.uint64)
    first = np.cumsum(size) - size
    at = np.arange(len(letters)) - np.repeat(first, size)
    power = np.cumprod(np.full(int(size.max()), _STEP))
    return mix(np.add.reduceat(_BYTE[letters] * power[at], first) + size.astype(np.uint64))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of n consecutive entries (``len(h) - n + 1`` of them), blind to text ends."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    done, out, power, size = 0, None, h, 1
    while True:
        if n & size:
            out = power if out is None else pair(out[: len(h) - done - size + 1], power[done : done + len(h) - done - size + 1])
            done += size
        if done == n:
            return out[: len(h) - n + 1]
        power = pair(power[:-size], power[size:])
        size *= 2


def inside(words: Words, n: int) -> np.ndarray:
    """Word positions at which a window of n words of one text starts."""
    last = np.repeat(words.first[1:] - n, words.count)
    return np.flatnonzero(np.arange(len(words.hash)) <= last)
