"""Words, lines and hashes of whole Arrow batches of texts, computed on their UTF-8 bytes.

A word is a run of bytes other than space, tab, newline, vertical tab, form feed and carriage return; these bytes never
occur inside a longer UTF-8 character.  Hashes of words are differences of one running polynomial over all bytes, so no
text is cut into Python strings.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

# Texts are worked on in runs of about this many bytes, whatever the size of the batch.  A longer text is its own run.
RUN_BYTES = 1 << 18
# Longer stretches of bytes are hashed by BLAKE2: a polynomial modulo 2**64 has equal values for some long regular ones.
LONG_BYTES = 256

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SAME = np.arange(256, dtype=np.uint64) + np.uint64(1)
LOWER = SAME.copy()
LOWER[65:91] += np.uint64(32)

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for n positions at least.  Only tables of one run's size are kept."""
    if _powers and len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    size = max(n, RUN_BYTES + 1)
    steps = [np.full(size, b, np.uint64) for b in (_BASE, _INVERSE)]
    for step in steps:
        step[0] = 1
        np.cumprod(step, out=step)
    if size == RUN_BYTES + 1:
        _powers[:] = steps
    return steps[0], steps[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def give_back() -> None:
    """Return freed memory to the system: workers live on between stages and would keep what the largest batch took."""
    pa.default_memory_pool().release_unused()
    trim = _c_library()
    if trim:
        trim(0)


@lru_cache(maxsize=1)
def _c_library():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return None


def runs(column: pa.Array, most: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows: (first row, end row, bytes, offsets).  NULL is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        end = min(end, n)
        yield first, end, bytes_[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end
    give_back()


class Words:
    """Words of one run: ``start`` and ``end`` (byte positions), and ``bounds``: text i has the words
    ``bounds[i]:bounds[i + 1]``.  ``gap`` tells which bytes lie between words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE):
        inside = np.concatenate(([False], ~gap[data], [False]))
        # A text begins anew even if the one before ends in the middle of a word.
        edge = inside[1:] != inside[:-1]
        starts = np.zeros(len(data) + 1, bool)
        starts[offsets] = True
        begins = (edge | starts) & inside[1:]
        ends = (edge | starts) & inside[:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends)
        self.bounds = np.searchsorted(self.start, offsets)
        self.data = data
        self.offsets = offsets

    def prefix_sums(self, table: np.ndarray = SAME) -> np.ndarray:
        """Running polynomial over the bytes mapped by ``table``."""
        power, _ = _power_tables(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(table[self.data] * power[:len(self.data)], out=out[1:])
        return out

    def hashes(self, table: np.ndarray = SAME, sums: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of every word (or of its bytes up to ``end``)."""
        sums = self.prefix_sums(table) if sums is None else sums
        _, inverse = _power_tables(len(self.data) + 1)
        end = self.end if end is None else end
        size = end - self.start
        out = mix((sums[end] - sums[self.start]) * inverse[self.start] + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        for i in np.flatnonzero(size > LONG_BYTES).tolist():
            mapped = table[self.data[self.start[i]:end[i]]].astype(np.uint8)
            out[i] = int.from_bytes(hashlib.blake2b(mapped, digest_size=8).digest(), "little")
        return out


def windows(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows of each text, and their bounds.  A text with 1 to k - 1 words has one window, the
    whole sequence; without words it has none."""
    n = np.diff(bounds)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_bounds = np.concatenate(([0], np.cumsum(count)))
    first = np.repeat(bounds[:-1] - out_bounds[:-1], count) + np.arange(out_bounds[-1])
    size = np.minimum(np.repeat(n, count), k)
    out = np.empty(len(first), np.uint64)
    step = np.uint64(0x9FB21C651E98DF25)
    whole = size == k
    at = first[whole]
    value = words[at].copy()
    for j in range(1, k):
        value *= step
        value += words[at + j]
    out[whole] = value
    short = np.flatnonzero(~whole)
    value = words[first[short]]
    for j in range(1, k - 1):
        longer = size[short] > j
        value[longer] = value[longer] * step + words[first[short][longer] + j]
    out[short] = value
    return mix(out + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), out_bounds


def digest(values: np.ndarray) -> bytes:
    """16 bytes that stand for a sorted set of hashes."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()
