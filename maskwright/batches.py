"""Arrow batches in lots that Python can hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A lot holds so many rows and bytes of text at most, or one row.
LOT_ROWS, LOT_BYTES = 1024, 2 << 20


def lots(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches, by the size of their column number `text`: what Python makes of a batch's words is many times the batch."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size.astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, before + LOT_BYTES, "right"))
            to = min(max(to, at + 1), at + LOT_ROWS, b.num_rows)
            yield b.slice(at, to - at)
            at = to
