"""Words and n-grams of whole texts as numpy arrays: the shared inner loop of operators on words and shingles.

A word is a run of bytes other than space and tab to carriage return. Words of a block are numbered exactly (equal bytes,
equal number); across blocks they go by two independent 64-bit names, each a sum of bytes times random keys of their places. Texts are taken in blocks of bounded bytes, so a task's memory does not follow its batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_IS_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Keys of places in words, by number of places.
_KEYS: dict[int, np.ndarray] = {}


def _keys(n: int) -> np.ndarray:
    """Two independent random 64-bit keys for each of the first ``n`` places of a word."""
    size = 1 << max(10, (n - 1).bit_length())
    if size not in _KEYS:
        draws = [np.random.default_rng([20240229, which, block]).integers(0, 2**64, 1024, dtype=np.uint64) for which in (0, 1) for block in range(size >> 10)]
        _KEYS[size] = np.concatenate(draws).reshape(2, size)
    return _KEYS[size]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def names_of(words: pa.Array) -> np.ndarray:
    """Two independent 64-bit names of each word (rows of a large binary array).

    A name is the sum of the word's bytes, each times the random key of its place, and of its length's key.
    """
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    length = np.diff(offsets)
    keys = _keys(int(length.max(initial=0)) + 1)
    out = np.empty((len(length), 2), np.uint64)
    a = 0
    while a < len(length):  # pieces of bounded bytes, whole words
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK, side="right")) - 1)
        value = np.frombuffer(data, np.uint8)[offsets[a] : offsets[b]].astype(np.uint64)
        place = np.arange(offsets[a], offsets[b]) - np.repeat(offsets[a:b], length[a:b])
        filled = np.flatnonzero(length[a:b])
        for i in (0, 1):
            out[a:b, i] = keys[i][length[a:b]] * np.uint64(256)
            if len(filled):
                out[a + filled, i] += np.add.reduceat(value * keys[i][place], offsets[a + filled] - offsets[a])
        a = b
    return mixed(out)


@dataclass
class Words:
    """Words of some texts: byte range of each in ``data``, and where each text's words begin (one entry more)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @cached_property
    def _encoded(self) -> pa.DictionaryArray:
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[self.start] += 1
        inside[self.end] -= 1
        packed = self.data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
        offsets = np.zeros(len(self.start) + 1, np.int64)
        np.cumsum(self.end - self.start, out=offsets[1:])
        column = pa.Array.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
        return column.dictionary_encode()

    @cached_property
    def ids(self) -> np.ndarray:
        """Number of each word among the distinct words of the block."""
        return self._encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    @property
    def distinct(self) -> pa.Array:
        """The distinct words of the block, by number."""
        return self._encoded.dictionary

    @cached_property
    def names(self) -> np.ndarray:
        """Two independent 64-bit names of each distinct word."""
        return names_of(self.distinct)

    @cached_property
    def hash(self) -> np.ndarray:
        return self.names[self.ids, 0]

    @cached_property
    def hash2(self) -> np.ndarray:
        return self.names[self.ids, 1]

    def part(self, a: int, b: int) -> Words:
        """Texts ``a`` to ``b``, with the same numbers of words."""
        lo, hi = int(self.first[a]), int(self.first[b])
        out = Words(self.data, self.start[lo:hi], self.end[lo:hi], self.first[a : b + 1] - lo)
        out.__dict__ |= {"_encoded": self._encoded, "ids": self.ids[lo:hi], "hash": self.hash[lo:hi]}
        return out


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``most`` bytes, or one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False, separators: np.ndarray = _IS_SPACE) -> Words:
    """Words of the rows that ``offsets`` cut out of ``data``; ``lower`` maps A-Z to a-z."""
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    inside = ~separators[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    begins[edge] = inside[edge]
    edge = offsets[1:][offsets[1:] > 0] - 1
    ends[edge] = inside[edge]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def ngrams(words: Words, n: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``n`` consecutive words of one text, and the index of its first word."""
    h = words.hash if hashes is None else hashes
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[j : len(h) - n + 1 + j]
    last = np.repeat(words.first[1:], words.counts)[: len(out)]  # end of the text a word is in
    at = np.flatnonzero(np.arange(len(out)) + n <= last)
    return mixed(out[at]), at
