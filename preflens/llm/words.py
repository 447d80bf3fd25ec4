"""Words, word hashes and shingle hashes of Arrow text columns, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a fixed bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        def table(base):
            t = np.full(n, base, np.uint64)
            t[0] = 1
            return np.cumprod(t, dtype=np.uint64)
        _powers = table(_BASE), table(_BASE_INVERSE)
    return _powers[0][:n], _powers[1][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows (null counts as empty)."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int = 4 * SEGMENT) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes (one row at least)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each run without the white space 0x20, 0x09-0x0D; a row's end also ends a word."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    last = inside
    last[:-1] &= ~inside[1:] | first[1:]
    return starts, np.flatnonzero(last) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each span of bytes (A-Z as a-z); long inputs go segment by segment."""
    out = np.empty(len(starts), np.uint64)
    byte = _BYTE[_LOWER] if lower else _BYTE
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + SEGMENT, "right")))
        hi = int(ends[j - 1])
        up, down = _power(max(hi - lo, SEGMENT) + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(byte[data[lo:hi]] * up[:hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (ends[i:j] - starts[i:j]).astype(np.uint64))
        i = j
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the word offsets of the rows."""
    starts, ends = word_spans(data, offsets)
    return hash_spans(data, starts, ends), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``size``-word shingle with the shingle offsets of the rows; a shorter text that has words is one shingle."""
    n = np.diff(offsets)
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    out_offsets = np.concatenate([[0], np.cumsum(counts)])
    if len(words) >= size:
        total = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            total += words[k:len(words) - size + 1 + k] * _PLACE[k]
    else:
        total = np.zeros(0, np.uint64)
    total = mix(total)
    out = np.zeros(out_offsets[-1], np.uint64)
    long_rows = np.flatnonzero(n >= size)
    if len(long_rows):
        at = np.repeat(offsets[long_rows] - out_offsets[long_rows], counts[long_rows])
        where = np.repeat(out_offsets[long_rows] - np.concatenate([[0], np.cumsum(counts[long_rows])[:-1]]), counts[long_rows]) + np.arange(counts[long_rows].sum())
        out[where] = total[where + at]
    for row in np.flatnonzero((n > 0) & (n < size)):
        w = words[offsets[row]:offsets[row + 1]]
        out[out_offsets[row]] = mix(np.sum(w * _PLACE[:len(w)], dtype=np.uint64, keepdims=True) + np.uint64(len(w)))[0]
    return out, out_offsets
