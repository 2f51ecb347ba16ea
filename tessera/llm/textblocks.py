"""Vectorised text primitives over Arrow string buffers.

A batch is cut into blocks of whole texts; inside a block words, n-grams and
lines are found with array operations over its UTF-8 bytes, so no Python code
runs per word.  Hashes are polynomial prefix hashes modulo 2**64 followed by a
mixing step; texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes whose hash powers are tabulated at once.
SEGMENT = 1 << 22
#: Bytes that begin a code point.
LEAD = (np.arange(256) & 0xC0) != 0x80

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for k, x in enumerate((BASE, INVERSE)):
            full = np.full(size, U(x))
            full[0] = 1
            np.multiply.accumulate(full, out=full)
            _powers[k] = full
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a new array."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.empty(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(column, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts of about ``most_bytes``."""
    data, at = buffers(column)
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most_bytes, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def spans(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text index) of the maximal runs of ``inside`` that stay within one text."""
    if not len(inside):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = at[1:] > at[:-1]
    first, last = at[:-1][full], at[1:][full] - 1
    starts[first] = inside[first]
    ends[last] = inside[last]
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(at, s, "right") - 1


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of ``[^\\x20\\x09-\\x0D]+``."""
    return spans(~SPACE[data], at)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of byte spans, after ``table`` if given; equal bytes hash alike wherever they stand."""
    if not len(starts):
        return np.empty(0, U)
    if len(data) > SEGMENT and len(starts) > 1:
        # Spans come in order: take those of one stretch at a time, so that a very long text needs no longer tables.
        out, i = [], 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + SEGMENT // 2)))
            part = data[starts[i] : int(ends[i:j].max())]
            out.append(hashes(part, starts[i:j] - starts[i], ends[i:j] - starts[i], table) if len(part) <= SEGMENT or j == i + 1 else np.concatenate([hashes(data[a:b], np.zeros(1, np.int64), np.array([b - a]), table) for a, b in zip(starts[i:j].tolist(), ends[i:j].tolist())]))
            i = j
        return np.concatenate(out)
    power, inverse = _powers_to(len(data) + 1)
    value = ((table[data] if table is not None else data).astype(U) + U(1)) * power[: len(data)]
    total = np.zeros(len(data) + 1, U)
    np.cumsum(value, out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix(h ^ ((ends - starts).astype(U) << U(40)))


def grams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position of its first item) of the runs of ``n`` items within one text."""
    if len(h) < n:
        return np.empty(0, U), np.empty(0, np.int64)
    m = len(h) - n + 1
    out = h[:m].copy()
    for k in range(1, n):
        out *= U(0xD6E8FEB86659FD93)
        out ^= h[k : k + m]
        out = mix(out)
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return out[at], at


def per_text(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by text as doubles."""
    return np.bincount(doc, weights=values, minlength=n)


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs twice or more, is not its key's first occurrence) for each key."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k), bool)
    same[1:] = k[1:] == k[:-1]
    later = np.zeros(len(k), bool)
    later[order] = same
    many = same.copy()
    many[:-1] |= same[1:]
    both = np.zeros(len(k), bool)
    both[order] = many
    return both, later
