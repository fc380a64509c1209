"""Words and word shingles of Arrow string columns as numpy arrays, without a Python object per word.

A word is a run of bytes other than space and 0x09 to 0x0D; texts are UTF-8, so that equals the same rule on
code points. A word's hash is a polynomial over its bytes modulo 2**64, taken from prefix sums and mixed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that are hashed at a time; also the size of the tables of powers.
BLOCK = 1 << 17
#: Texts are taken this many bytes at a time, a longer one alone.
CHUNK = 1 << 19
#: A row number and a shingle's hash share 64 bits, so that one sort orders both.
HASH_BITS = 48
MOST_ROWS = 1 << 15

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _powers(base: int) -> np.ndarray:
    factors = np.full(BLOCK, base, dtype=np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


_POWER = _powers(_BASE)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit (in place)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def give_back() -> None:
    """Return freed memory of a task to the system, so that idle Python workers stay small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mixed_int(x: int) -> int:
    return int(mixed(np.array([x & _MASK], dtype=np.uint64))[0])


class Texts:
    """Some rows of a string column: their bytes, row bounds and words. A null counts as an empty text.

    starts, ends: bytes of each word within data; bounds: of each row's words within starts.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        solid = ~SEPARATOR[data]
        begin, end = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        cuts = offsets[(offsets > 0) & (offsets < len(data))]
        begin[cuts] = solid[cuts]
        end[cuts - 1] = solid[cuts - 1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def row_of(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(self.rows), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        out = np.empty(len(self.starts), dtype=np.uint64)
        i = 0
        while i < len(out):
            first = int(self.starts[i])
            j = int(np.searchsorted(self.ends, first + BLOCK, side="right"))
            if j <= i:
                out[i] = self._long(first, int(self.ends[i]), lower)
                i += 1
                continue
            part = self.data[first : int(self.ends[j - 1])]
            part = LOWER[part] if lower else part
            sums = np.empty(len(part) + 1, dtype=np.uint64)
            sums[0] = 0
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _POWER[: len(part)], out=sums[1:])
            start = self.starts[i:j] - first
            out[i:j] = (sums[self.ends[i:j] - first] - sums[start]) * _INVERSE[start]
            i = j
        return mixed(out)

    def _long(self, start: int, end: int, lower: bool) -> int:
        total = 0
        for at in range(start, end, BLOCK):
            part = self.data[at : min(end, at + BLOCK)]
            part = (LOWER[part] if lower else part).astype(np.uint64) + np.uint64(1)
            total += int((part * _POWER[: len(part)]).sum()) * pow(_BASE, at - start, 1 << 64)
        return total & _MASK

    def shingles(self, k: int, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles of k words (hashes of HASH_BITS) by row and value, and each row's bounds in them.

        A row with fewer words, but at least one, has one shingle: all of them.
        """
        words, counts = self.hashes(lower), self.counts
        rows = self.row_of()
        full = max(0, len(words) - k + 1)
        value = np.zeros(full, dtype=np.uint64)
        for j in range(k):
            value += words[j : j + full] * np.uint64(mixed_int(j + 1) | 1)
        inside = rows[:full] == rows[k - 1 : k - 1 + full] if full else np.zeros(0, dtype=bool)
        value, owner = mixed(value[inside]), rows[:full][inside]
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            whole = np.zeros(len(short), dtype=np.uint64)
            for j in range(k - 1):
                has = counts[short] > j
                whole[has] += words[self.bounds[short[has]] + j] * np.uint64(mixed_int(j + 1) | 1)
            whole = mixed(whole + counts[short].astype(np.uint64) * np.uint64(mixed_int(k + 101)))
            value, owner = np.concatenate([value, whole]), np.concatenate([owner, short])
        key = np.sort((owner.astype(np.uint64) << np.uint64(HASH_BITS)) | (value >> np.uint64(64 - HASH_BITS)))
        if len(key):
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        bounds = np.searchsorted(key >> np.uint64(HASH_BITS), np.arange(self.rows + 1, dtype=np.uint64))
        return key & np.uint64((1 << HASH_BITS) - 1), bounds


def pieces(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, Texts]]:
    """The column as runs of rows (first, end, texts) of about `limit` bytes each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        end = min(end, first + MOST_ROWS)
        yield first, end, Texts(data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first])
        first = end
