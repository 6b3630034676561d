"""Vectorised text kernels shared by the operators of this subpackage.

Everything here works on an Arrow string column and returns flat numpy arrays over
the whole slice, so that no Python code runs per word. A *word* is a maximal run of
ASCII letters or digits and non-ASCII bytes of the lower-cased UTF-8 text; every other
byte separates. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one slice holds; a longer document is a slice by itself.
SLICE_BYTES = 1 << 20

_U = np.uint64
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
_IS_WORD = np.zeros(256, np.bool_)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        up, down = np.empty(size, np.uint64), np.empty(size, np.uint64)
        up[:] = _U(_MULT)
        down[:] = _U(_INV)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0][:n], _powers[1][:n]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, part) pieces of a string column with about ``limit`` bytes each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n, done = 0, len(column), 0
    while at < n:
        to = int(np.searchsorted(size, done + limit, side="right"))
        to = min(max(to, at + 1), n)
        yield at, column.slice(at, to - at)
        done = int(size[to - 1])
        at = to


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows in one array and the n + 1 row bounds in it."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


class Words:
    """The words of a slice: hash, row and byte span of each, and where each row's words begin."""

    __slots__ = ("hash", "first", "start", "end", "n")

    def __init__(self, column: pa.Array, lower: bool = True) -> None:
        data, bounds = raw_bytes(pc.utf8_lower(column) if lower else column)
        n = len(data)
        inside = np.zeros(n + 2, np.int8)
        inside[1:-1] = _IS_WORD[data]
        edge = np.diff(inside)
        # a row's end also ends a word
        cut = bounds[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        both = np.unique(cut[(inside[cut] & inside[cut + 1]) == 1])
        start = np.flatnonzero(edge == 1)
        end = np.flatnonzero(edge == -1)
        if len(both):
            start = np.sort(np.concatenate([start, both]))
            end = np.sort(np.concatenate([end, both]))
        up, down = _power_tables(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=total[1:])
        self.hash = mix((total[end] - total[start]) * down[start])
        self.first = np.searchsorted(start, bounds)
        self.start, self.end, self.n = start, end, len(bounds) - 1

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.first))


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams within rows and the position (of the first word) of each."""
    h = words.hash
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        total *= _U(_MULT)
        total += h[k : len(h) - n + 1 + k]
    row = words.row()
    at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
    return mix(total[at]), at


def code_points(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Unicode code points of all rows in one array and the n + 1 row bounds in it."""
    data, bounds = raw_bytes(pc.utf8_lower(column) if lower else column)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    leads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=leads[1:])
    return points, leads[bounds]
