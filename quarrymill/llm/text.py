"""Word and shingle hashing over whole Arrow batches, in numpy.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. These bytes never occur inside a multi-byte UTF-8
sequence, so working on bytes splits exactly where the pattern ``[^\\x20\\x09-\\x0D]+`` does on code points.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = U64(0xD1342543DE82EF95)
_BREAK = np.zeros(256, bool)
_BREAK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]

#: Bytes of text that one pass handles: the working arrays are about 60 times that.
SLICE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            grown = np.full(max(n, SLICE + 1), base, U64)
            grown[0] = 1
            _powers[i] = np.cumprod(grown, dtype=U64)
    return _powers


class Slice:
    """Some rows of a batch: their text bytes, and where words start and end."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray, lower: bool):
        self.lo, self.hi, self.offsets = lo, hi, offsets
        self.data = data = _LOWER[data] if lower else data
        n = len(data)
        inside = ~_BREAK[data]
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            edges = offsets[(offsets > 0) & (offsets < n)]
            first[edges] = inside[edges]
            last[edges - 1] = inside[edges - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: index of each document's first word, and the number of all words at the end
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        n = len(self.data)
        up, down = _power_tables(n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum((self.data.astype(U64) + U64(1)) * up[:n], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(U64) * _STEP)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def slices(column: pa.Array, lower: bool = False, limit: int = SLICE, rows: int = 1 << 14) -> Iterator[Slice]:
    """Cut a string column into runs of at most ``rows`` rows and about ``limit`` bytes; one longer text is a run of its own."""
    column = pc.fill_null(column, "")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, lo + rows, len(column))
        yield Slice(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower)
        lo = hi


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` consecutive words, ignoring document ends."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _STEP
        out += hashes[j : n + j]
    return mix(out)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word shingles by document, and offsets of documents; fewer words make one shingle."""
    words = np.diff(first)
    count = np.where(words >= k, words - k + 1, (words > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(at[-1], U64)
    every = runs(hashes, k)
    doc = np.repeat(np.arange(len(words)), words)[: len(every)]
    pos = np.arange(len(every))
    whole = pos + k <= first[doc + 1] if len(every) else np.zeros(0, bool)
    doc, pos = doc[whole], pos[whole]
    out[at[doc] + pos - first[doc]] = every[whole]
    for d in np.flatnonzero((words > 0) & (words < k)):
        value = int(words[d])
        for h in hashes[first[d] : first[d + 1]].tolist():
            value = (value * int(_STEP) + h) & 0xFFFFFFFFFFFFFFFF
        out[at[d]] = mix(np.array([value], U64))[0]
    return out, at


def shingle_sets(column: pa.Array, k: int, lower: bool) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For runs of rows: the first row, and each row's sorted distinct shingle hashes."""
    for s in slices(column, lower):
        values, at = shingles(s.hashes(), s.first, k)
        yield s.lo, [np.unique(values[at[i] : at[i + 1]]) for i in range(s.hi - s.lo)]
