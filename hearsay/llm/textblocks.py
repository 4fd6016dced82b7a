"""Words and n-grams of whole Arrow batches, found and hashed with numpy.

A batch is handled in blocks of consecutive texts of about ``BLOCK_BYTES``
together (a longer text is a block of its own), so memory follows the longest
text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
BLOCK_ROWS = 4096

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = np.ones((2, 1), dtype=np.uint64)


def _seeded(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE_VALUE = _seeded(7, 256)
_FOLDED_VALUE = _BYTE_VALUE.copy()
_FOLDED_VALUE[ord("A") : ord("Z") + 1] = _BYTE_VALUE[ord("a") : ord("z") + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's last step)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers.shape[1] < n:
        out = np.empty((2, max(n, BLOCK_BYTES + 1)), dtype=np.uint64)
        out[:, 0] = 1
        out[0, 1:], out[1, 1:] = _BASE, _BASE_INVERSE
        _powers = np.cumprod(out, axis=1, dtype=np.uint64)
    return _powers[0], _powers[1]


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash modulo 2**64 of each ``values[start:end]``, from one running sum."""
    power, inverse = _power_tables(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` between consecutive offsets."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def repeated(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Marks the entries whose hash occurs twice or more in their row."""
    keys = mix(hashes ^ mix(rows.astype(np.uint64) + np.uint64(1)))
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    marks = np.zeros(1 << 16, dtype=bool)
    marks[twice & np.uint64(0xFFFF)] = True
    out = marks[keys & np.uint64(0xFFFF)]
    at = np.flatnonzero(out)
    if len(at):
        twice = np.unique(twice)
        found = np.minimum(np.searchsorted(twice, keys[at]), len(twice) - 1)
        out[at] = twice[found] == keys[at]
    return out


@dataclass
class Block:
    """Consecutive texts: their UTF-8 bytes and where each begins and ends."""

    first: int  # row of the batch
    data: np.ndarray
    offsets: np.ndarray
    fold: bool = False  # A-Z count as a-z

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @cached_property
    def space(self) -> np.ndarray:
        return _SPACE[self.data]

    @cached_property
    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Byte positions where words start and end."""
        inside = ~self.space
        edge = np.zeros(len(self.data) + 1, dtype=bool)
        edge[self.offsets] = True
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= self.space[:-1] | edge[1:-1]
        ends[:-1] &= self.space[1:] | edge[1:-1]
        return np.flatnonzero(starts), np.flatnonzero(ends) + 1

    @cached_property
    def word_rows(self) -> np.ndarray:
        return np.searchsorted(self.offsets, self.bounds[0], side="right") - 1

    @cached_property
    def words_before(self) -> np.ndarray:
        """Number of words before each text, and of all."""
        return np.searchsorted(self.bounds[0], self.offsets)

    @cached_property
    def values(self) -> np.ndarray:
        return (_FOLDED_VALUE if self.fold else _BYTE_VALUE)[self.data]

    @cached_property
    def words(self) -> np.ndarray:
        """A hash of each word."""
        return rolling(self.values, *self.bounds)

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word, and hash, of every n words in one text."""
        last = len(self.words) - n
        if last < 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        at = np.flatnonzero(self.word_rows[: last + 1] == self.word_rows[n - 1 :])
        return at, rolling(self.words, at, at + n)


def blocks(texts: pa.Array, fold: bool = False) -> Iterator[Block]:
    """The texts of a batch, null as empty, in blocks."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    buffers = texts.buffers()
    ends = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2] or b"", dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(ends, ends[first] + BLOCK_BYTES, side="right")) - 1
        last = min(max(last, first + 1), first + BLOCK_ROWS, len(texts))
        yield Block(first, data[ends[first] : ends[last]], ends[first : last + 1] - ends[first], fold)
        first = last
