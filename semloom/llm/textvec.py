"""Words, word hashes and shingles of many texts at once, on the bytes of an Arrow string column.

All functions work on UTF-8 bytes with numpy and never loop over words in Python. Hashes depend on
nothing but the bytes: the same on every executor and in every run.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finalizer of splitmix64)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def byte_class(allowed) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(allowed)] = True
    return table


#: Bytes of words that white space parts, and of words of letters, digits and all beyond ASCII.
NOT_SPACE = byte_class(b for b in range(256) if b not in (32, 9, 10, 11, 12, 13))
ALNUM = byte_class([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_CODES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_powers = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16, 2 * len(_powers[0]) if len(_powers[0]) < 1 << 22 else 0)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of consecutive texts: of text i those from first[i] to first[i + 1]."""

    data: np.ndarray  # the bytes, A-Z lower-cased where asked for
    bounds: np.ndarray  # of the texts in data
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    sums: np.ndarray | None  # running polynomial hash, of length len(data) + 1

    def hash_spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * _power(len(self.data) + 1)[1][start]
        return mix(h ^ (end - start).astype(U))

    def hashes(self) -> np.ndarray:
        return self.hash_spans(self.start, self.end)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.first))


def words(column: pa.Array, table: np.ndarray = NOT_SPACE, fold: bool = True, hashed: bool = True) -> Words:
    """Words of a string column without nulls: maximal runs of bytes of the class, never across texts."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    if fold:
        data = _FOLD[data]
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = table[data]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    inner = bounds[(bounds > 0) & (bounds < n)]
    begins[inner] = inside[1:-1][inner]  # a word ends with its text
    ends[inner - 1] = inside[1:-1][inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = None
    if hashed:
        sums = np.zeros(n + 1, U)
        np.cumsum(_CODES[data] * _power(n + 1)[0][:n], out=sums[1:])
    return Words(data, bounds, start, end, np.searchsorted(start, bounds), sums)


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k successive words, and where each text's begin; a text of fewer words has one of them all, one without words none."""
    h, count = w.hashes(), np.diff(w.first)
    n = len(h)
    rolled = np.zeros(n, U)
    for j in range(min(k, n)):
        rolled[: n - j] += h[j:] * _CODES[j]
    rolled = mix(rolled)
    own = np.arange(n) - np.repeat(w.first[:-1], count)
    left = np.repeat(count, count) - own
    for i in np.flatnonzero((count > 0) & (count < k)):
        part = h[w.first[i] : w.first[i + 1]]
        rolled[w.first[i]] = mix(np.array([(part * _CODES[: len(part)]).sum() ^ _CODES[100 + len(part)]], U))[0]
    keep = (left >= k) | ((own == 0) & (left < k))
    bounds = np.concatenate([[0], np.cumsum(keep)])[w.first]
    return rolled[keep], bounds


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values of a short array."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def shingle_sets(column: pa.Array, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    values, bounds = shingles(words(column), k)
    return [distinct(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def texts(column: pa.Array) -> pa.Array:
    """The column as plain strings, nulls as empty ones."""
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column
