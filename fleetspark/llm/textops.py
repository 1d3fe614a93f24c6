"""Words and hashes of whole Arrow text columns, in numpy, straight from the UTF-8 buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# An odd multiplier has an inverse modulo 2^64, which turns prefix sums into hashes of any span.
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Text bytes handled at once; a longer document is handled alone.
SLICE_BYTES = 1 << 20


def byte_classes(lower: bool, punctuation: bool) -> tuple[np.ndarray, np.ndarray]:
    """(class, folded byte) per byte: 0 splits; letters, digits and bytes past ASCII are one
    class; with ``punctuation`` each punctuation mark is a class of its own, else it splits."""
    kind = np.zeros(256, np.uint8)
    folded = np.arange(256, dtype=np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 128 or c.isalnum():
            kind[b] = 1
        elif punctuation and b > 32 and b != 127:
            kind[b] = b
    if lower:
        for b in range(65, 91):
            folded[b] = b + 32
    return kind, folded


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that any bits of a hash can be used."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8_slices(column: pa.Array, size: int = SLICE_BYTES):
    """Yields (first row, bytes, offsets) for runs of rows of ``size`` bytes, a longer text alone; nulls are empty texts."""
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        end = min(end, n)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """Words of one slice: ``start``, ``end`` (bytes), ``row``, and span hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, classes: tuple[np.ndarray, np.ndarray]):
        kind, folded = classes
        n = len(data)
        k = kind[data]
        begins = np.empty(n, bool)
        if n:
            begins[0] = True
            np.not_equal(k[1:], k[:-1], out=begins[1:])
            begins[offsets[:-1][offsets[:-1] < n]] = True
        cuts = np.append(np.flatnonzero(begins), n)
        words = k[cuts[:-1]] != 0 if n else np.zeros(0, bool)
        self.start, self.end = cuts[:-1][words], cuts[1:][words]
        self.rows = len(offsets) - 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        powers = np.full(n + 1, _BASE, np.uint64)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum((folded[data].astype(np.uint64) + np.uint64(1)) * powers[:n], out=self._sums[1:])
        inverse = np.full(n + 1, _BASE_INVERSE, np.uint64)
        inverse[0] = 1
        self._inverse = np.cumprod(inverse, out=inverse)
        self.counts = np.bincount(self.row, minlength=self.rows)

    def hashes(self, end: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of each word, or of its part before ``end``."""
        end = self.end if end is None else end
        return mix((self._sums[end] - self._sums[self.start]) * self._inverse[self.start])


def sums_by_row(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of the given sizes; empty groups give 0."""
    ends = np.cumsum(counts)
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[ends] - total[ends - counts]


def shingles(words: np.ndarray, row: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``size`` words; a shorter text is one run of all its words."""
    n = len(words)
    out, at = [], []
    if n >= size:
        h = words[: n - size + 1].copy()
        for i in range(1, size):
            h = h * np.uint64(_BASE) + words[i : n - size + 1 + i]
        whole = row[: n - size + 1] == row[size - 1 :]
        out.append(mix(h[whole]))
        at.append(row[: n - size + 1][whole])
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.cumsum(counts) - counts
        hs = []
        for r in short:
            h = np.uint64(counts[r])
            for w in words[first[r] : first[r] + counts[r]]:
                h = (int(h) * _BASE + int(w)) & 0xFFFFFFFFFFFFFFFF
            hs.append(h)
        out.append(mix(np.array(hs, np.uint64)))
        at.append(short)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, r = np.concatenate(out), np.concatenate(at)
    if len(short) and n >= size:
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    return h, r
