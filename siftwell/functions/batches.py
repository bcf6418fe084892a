"""Arrow batches cut into slices of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task turns into Python objects at a time.
SLICE_BYTES = 2_000_000


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after which what Arrow has kept for later goes back to the system: workers live longer than tasks."""

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return whole


def text_slices(texts: pa.Array, most: int | None = None) -> Iterator[pa.Array]:
    """The array in slices of about ``most`` bytes; a longer text is a slice of its own."""
    most = most or SLICE_BYTES
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    return _cut(texts, ends, most)


def list_slices(lists: pa.ListArray, most: int) -> Iterator[pa.ListArray]:
    """The array in slices of about ``most`` entries; a longer list is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    return _cut(lists, ends, most)


def _cut(rows: pa.Array, ends: np.ndarray, most: int) -> Iterator[pa.Array]:
    start = 0
    while start < len(rows):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield rows.slice(start, end - start)
        start = end
