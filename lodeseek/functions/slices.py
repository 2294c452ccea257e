"""Arrow batches in slices of a bounded number of bytes, for Python code that makes objects of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES, SLICE_ROWS = 1_000_000, 1024


def cuts(texts: pa.Array, size: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[tuple[int, int]]:
    """From and to of slices of about `size` bytes and at most `rows` texts, one at least; nothing for no texts."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = min(max(int(np.searchsorted(ends, before + size, side="right")), at + 1), at + rows)
        yield at, min(to, len(ends))
        at = to
