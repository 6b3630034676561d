"""Python over Arrow batches, a slice at a time: what it keeps as objects doesn't grow with the batch."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of input that one slice holds; a larger row is a slice by itself.
SLICE_BYTES = 1 << 20


def sliced(run: Callable[..., pa.Array]) -> Callable[..., pa.Array]:
    """``run``, a function of a batch's columns, on slices of about 1 MB; its rows must not depend on each other."""

    def ends_of(columns: tuple[pa.Array, ...]) -> list[int]:
        """Where the slices end."""
        n = len(columns[0])
        size = np.full(n, 8, np.int64)
        for c in columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
                size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            elif pa.types.is_nested(c.type):
                size += np.fromiter((c.slice(i, 1).nbytes for i in range(n)), np.int64, n)
        total, ends, done = np.cumsum(size), [], 0
        while not ends or ends[-1] < n:
            at = ends[-1] if ends else 0
            ends.append(min(n, max(int(np.searchsorted(total, done + SLICE_BYTES, side="right")), at + 1)))
            done = int(total[ends[-1] - 1]) if n else 0
        return ends

    @functools.wraps(run)
    def each(*columns: pa.Array) -> pa.Array:
        ends = ends_of(columns)
        parts = [run(*(c.slice(lo, hi - lo) for c in columns)) for lo, hi in zip([0, *ends], ends)]
        return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)

    return each
