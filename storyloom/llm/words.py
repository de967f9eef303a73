"""Words of whole Arrow text columns, found and hashed as byte arrays in numpy.

No Python object is made per word.  A 64-bit hash stands for a word: a sum of
random byte values times powers of an odd number, then mixed; two different words
share one with a chance of about 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
SLICE = 1 << 19

def release() -> None:
    """Gives memory that is free in this worker back to the system, as workers stay between tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    """Table of the bytes that make words: all but those in the given inclusive spans."""
    table = np.ones(256, dtype=bool)
    for a, b in spans:
        table[a : b + 1] = False
    return table


_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = 1 << int(n + 1).bit_length()
        for k, base in enumerate((_ODD, _INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of runs of rows with at most ``size`` bytes, or one row; null texts are empty."""
    col = batch.column(batch.schema.get_field_index(column))
    col = col.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, side="right")) - 1)
        to = min(to, len(col))
        yield batch.slice(at, to - at), data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


def find(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lowered bytes, word starts, word ends, index of each text's first word, with one more at the end)."""
    low = LOWER[data]
    if not len(low):
        none = np.zeros(0, np.int64)
        return low, none, none, np.zeros(len(offsets), np.int64)
    word = table[low]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    before[offsets[:-1][offsets[:-1] < len(low)]] = False
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    ends = offsets[1:] - 1
    after[ends[ends >= 0]] = False
    starts = np.flatnonzero(word & ~before)
    stops = np.flatnonzero(word & ~after) + 1
    return low, starts, stops, np.searchsorted(starts, offsets)


def hashes(low: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power(len(low))
    total = np.empty(len(low) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_VALUE[low] * power[: len(low)], out=total[1:])
    return mix((total[stops] - total[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of a sequence from its members' hashes."""
    out = np.full(len(parts[0]), len(parts), dtype=np.uint64)
    for p in parts:
        out = mix(out * _U(_ODD) + p)
    return out


def shingles(word: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, index of each text's first shingle): runs of ``n`` words; a shorter text is one run, none has none."""
    counts = np.diff(first)
    have = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(have)])
    out = np.empty(int(at[-1]), dtype=np.uint64)
    if len(word) >= n:
        every = combine([word[k : len(word) - n + 1 + k] for k in range(n)])
        begin = np.repeat(first[:-1] - at[:-1], have) + np.arange(len(out))
        full = np.repeat(counts >= n, have)
        out[full] = every[begin[full]]
    for d in np.flatnonzero((counts > 0) & (counts < n)):
        out[at[d]] = combine([word[k : k + 1] for k in range(first[d], first[d + 1])])[0]
    return out, at
