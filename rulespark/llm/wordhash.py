"""Vectorised word hashing over the UTF-8 bytes of Arrow string columns.

A word is a maximal run of bytes that are not separators, hashed after lower-casing A-Z. The hash of a byte
run is the difference of two prefix sums of ``byte * B**position`` (mod 2**64), shifted back to position 0 and
mixed, so a whole batch takes a fixed number of numpy passes and no Python object per word.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_B = 0x9E3779B97F4A7C15 | 1
_C = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], dtype=U)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: True for bytes of words: anything but ASCII other than digits and letters.
ALNUM = np.ones(256, bool)
ALNUM[:128] = [chr(i).isalnum() for i in range(128)]
#: True for bytes of words that white space alone separates.
SOLID = np.ones(256, bool)
SOLID[[0x20, 9, 10, 11, 12, 13]] = False

_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow.get("up", ())) < n + 1:
        size = max(1 << 20, n + 1)
        up, down = np.full(size, _B, U), np.full(size, pow(_B, -1, 1 << 64), U)
        up[0] = down[0] = 1
        _pow["up"], _pow["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _pow["up"], _pow["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(31))
    h *= _C[0]
    h ^= h >> U(29)
    h *= _C[1]
    h ^= h >> U(32)
    return h


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def release() -> None:
    """Give the system back what this worker holds but doesn't use: idle workers stay for the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def slices(col, max_bytes: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``max_bytes``; a longer text comes alone, whole.
    Null counts as empty."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    col = col.cast(pa.large_string()).fill_null("")
    n = len(col)
    if not n:
        return
    _, o, d = col.buffers()
    offs = np.frombuffer(o, np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(d, np.uint8) if d is not None and d.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi
    release()


def words(data: np.ndarray, offs: np.ndarray, keep: np.ndarray = ALNUM, mask: np.ndarray | None = None):
    """Hashes of all words, the range of words of each row, and their byte starts and ends. ``keep``: the values of bytes
    of words; ``mask``: which bytes are."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U), np.zeros(len(offs), np.int64), z, z
    w = keep[data] if mask is None else mask
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, w[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, w[1:]
    starts = np.flatnonzero(w & (~before | edge[:-1]))
    ends = np.flatnonzero(w & (~after | edge[1:])) + 1
    up, down = _powers(n)
    total = np.zeros(n + 1, U)
    np.cumsum((LOWER[data].astype(U) + U(1)) * up[:n], out=total[1:])
    h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U) * _C[2])
    return h, np.searchsorted(starts, offs), starts, ends


def shingles(h: np.ndarray, ranges: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``k`` words of each row, and each row's range of them. A row of fewer words, but not
    none, has one: all its words."""
    m = np.diff(ranges)
    count = np.where(m >= k, m - k + 1, (m > 0).astype(m.dtype))
    out = np.zeros(len(ranges), np.int64)
    np.cumsum(count, out=out[1:])
    row = np.repeat(np.arange(len(m)), count)
    at = np.arange(out[-1]) - out[row] + ranges[row]
    padded = np.concatenate([h, np.zeros(k, U)])
    acc = np.zeros(len(at), U)
    short = (m < k)[row]
    for j in range(k):
        x = padded[at + j] * _C[j % 8]
        if short.any():
            x[short & (j >= m[row])] = U(j + 1)
        acc = (acc ^ (acc >> U(27))) * _C[7] + x
    return mix(acc), out


def occurrences(s: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """Make the hashes of a row distinct: the j-th repeat of a value becomes another value, the same in each row.
    So sets of the results stand for multisets of the values."""
    if not len(s):
        return s
    row = np.repeat(np.arange(len(ranges) - 1, dtype=U), np.diff(ranges))
    key = s ^ mix(row + U(1))
    # only what repeats, and what shares low bits with it, must be in order
    low, mask = np.sort(key), U((1 << 18) - 1)
    marks = np.zeros(1 << 18, bool)
    marks[low[1:][low[1:] == low[:-1]] & mask] = True
    some = np.flatnonzero(marks[key & mask])
    if not len(some):
        return s
    order = some[np.argsort(key[some], kind="stable")]
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    turn = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    out = s.copy()
    again = turn > 0
    out[order[again]] = mix(s[order[again]] + turn[again].astype(U) * _C[3])
    return out


def digests(h: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """One hash of the whole word sequence of each row; 0 for rows of no words."""
    m = np.diff(ranges)
    out = np.zeros(len(m), U)
    full = m > 0
    if full.any():
        at = np.arange(len(h)) - np.repeat(ranges[:-1], m)
        out[full] = np.add.reduceat(mix(h + at.astype(U) * _C[4]), ranges[:-1][full])
        out[full] = mix(out[full] + m[full].astype(U) * _C[5]) | U(1)
    return out


def lists(values: np.ndarray, ranges: np.ndarray, kind=None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ranges.astype(np.int32)), pa.array(values, type=kind))
