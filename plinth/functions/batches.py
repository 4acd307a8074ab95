"""Arrow batches in slices, so that a step needs little memory whatever a batch holds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Rows of one Arrow slice handed to a vectorised function; bounds the memory that one step needs.
SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of a batch with about ``most`` bytes of the column each; one long row is a slice of its own."""
    start, seen = 0, 0
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    for i, n in enumerate(sizes):
        if seen and seen + (n or 0) > most:
            yield batch.slice(start, i - start)
            start, seen = i, 0
        seen += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)
