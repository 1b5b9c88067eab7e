"""Vectorised text primitives over Arrow buffers: word spans, 64-bit word hashes and word shingles.

Every function works on a slab: the concatenated UTF-8 bytes of several texts and their offsets.
Hashes are polynomials modulo 2**64 with an odd base, finished by a bit mixer, so that each word's hash
comes from two entries of one running sum and no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
SLAB = 1 << 20
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i up to n."""
    global _powers, _inverses
    if len(_powers) <= n:
        size = max(n + 1, SLAB + 1, 2 * len(_powers))
        up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers, _inverses = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finish of 64-bit values (shifts and odd multipliers)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slabs(n_bytes: np.ndarray, limit: int = SLAB) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes; a longer text is a range of its own."""
    start, total = 0, 0
    for i, n in enumerate(n_bytes.tolist()):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(n_bytes):
        yield start, len(n_bytes)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each run of bytes other than white space; texts never share a word."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = (data != 32) & ((data < 9) | (data > 13))
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(offsets, s, "right") - 1


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[e] - sums[s]) * down[s])


def chain(hashes: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """The hash of k consecutive words from each start on."""
    out = np.zeros(len(starts), np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + hashes[starts + j])
    return out


def shingles(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each k-word shingle; a text of fewer words gives its whole sequence, one of none nothing."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    full = np.flatnonzero(rows[: n - k + 1] == rows[k - 1 :]) if n >= k else np.zeros(0, np.int64)
    values, at = chain(hashes, full, k), rows[full]
    begin = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    count = np.diff(np.r_[begin, n])
    for j in range(1, k):
        few = begin[count == j]
        if len(few):
            values, at = np.r_[values, chain(hashes, few, j) + np.uint64(j)], np.r_[at, rows[few]]
    order = np.argsort(at, kind="stable")
    return values[order], at[order]
