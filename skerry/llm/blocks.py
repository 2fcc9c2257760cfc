"""Whole texts as flat byte arrays: words, lines and rolling hashes by numpy, a block of about a megabyte at a time.

A word is a run of bytes other than 0x20 and 0x09-0x0D. UTF-8 keeps every one of those below 0x80, so
bytes and code points give the same words. A hash of any byte range comes from one prefix sum:
``P[i] = sum(T[b] * B**j)`` modulo 2**64, with a random 64-bit table T, so ``(P[e] - P[s]) * B**-s``
does not depend on where the range stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_RNG = np.random.default_rng(20240607)
TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i for i up to n at least; kept and grown by doubling."""
    if len(_powers[0]) <= n:
        size = max(BLOCK_BYTES + 4096, n + 1)
        for k, base in enumerate((BASE, BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more: values are sorted (no argsort), then looked up."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = twice[np.r_[True, twice[1:] != twice[:-1]]]
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys


def first_of_each(keys: np.ndarray) -> np.ndarray:
    """A mask with one True for each different key."""
    out = np.ones(len(keys), bool)
    again = np.flatnonzero(repeated(keys))
    if len(again):
        out[again] = False
        out[again[np.unique(keys[again], return_index=True)[1]]] = True
    return out


@dataclass
class Block:
    """Rows ``first`` to ``first + docs`` of a batch; ``offset`` has docs + 1 entries."""

    first: int
    data: np.ndarray
    offset: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.offset) - 1

    @cached_property
    def in_word(self) -> np.ndarray:
        return ~SEPARATOR[self.data]

    @cached_property
    def _bounds(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.data)
        cut = np.zeros(n + 1, bool)
        cut[self.offset] = True
        before, after = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        before[1:], after[:n] = self.in_word, self.in_word
        return np.flatnonzero(after & (~before | cut)), np.flatnonzero(before & (~after | cut))

    @property
    def start(self) -> np.ndarray:
        return self._bounds[0]

    @property
    def end(self) -> np.ndarray:
        return self._bounds[1]

    @cached_property
    def first_word(self) -> np.ndarray:
        """Index of each text's first word, and the number of words at the end."""
        return np.searchsorted(self.start, self.offset)

    @cached_property
    def word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), np.diff(self.first_word))

    def prefix(self, lower: bool) -> np.ndarray:
        p, _ = powers(len(self.data))
        out = np.zeros(len(self.data) + 1, np.uint64)
        table = TABLE[LOWER] if lower else TABLE
        np.cumsum(table[self.data] * p[: len(self.data)], out=out[1:])
        return out

    @staticmethod
    def span(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(np.uint64))

    def words(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word (A-Z taken as a-z if lower)."""
        return self.span(self.prefix(lower), self.start, self.end)

    def word_text(self, which: np.ndarray) -> list[str]:
        raw = self.data.tobytes()
        return [raw[s:e].decode("utf-8", "replace") for s, e in zip(self.start[which].tolist(), self.end[which].tolist(), strict=True)]


def windows(words: np.ndarray, word_doc: np.ndarray, first_word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of n words that stay within a text, and the word at which each begins."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(words) - n + 1
    h = words[:m].copy()
    for k in range(1, n):
        h *= BASE
        h += words[k : k + m]
    at = np.flatnonzero(first_word[1:][word_doc[:m]] - np.arange(m) >= n)
    return mix(h[at] + np.uint64(n)), at


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """All rows of a string column in order; null counts as empty. A text longer than limit is a block by itself."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offset = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    r = 0
    while r < n:
        e = max(r + 1, int(np.searchsorted(offset, offset[r] + limit, "right")) - 1)
        e = min(e, n, r + 65536)
        yield Block(r, data[offset[r] : offset[e]], offset[r : e + 1] - offset[r])
        r = e
