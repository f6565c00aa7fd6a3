"""Arrow batches cut to a bounded amount of text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a worker handles at once; a single longer text is handled alone.
SLICE_BYTES = 4 << 20


def bounded(batches: Iterable[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about ``limit`` bytes of the text column."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        piece = (np.cumsum(sizes) - sizes) // limit
        starts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
        for a, b in zip(starts, starts[1:]):
            yield batch.slice(a, b - a)
