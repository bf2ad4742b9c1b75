"""Arrow batches in pieces, so that a task's Python holds the objects of a few rows, not of a whole batch."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

ROWS, BYTES = 256, 1 << 20  # of a piece


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows in order, at most ROWS at once and about BYTES; a longer row is a piece of its own."""
    for batch in batches:
        todo = [batch.slice(k, ROWS) for k in range(batch.num_rows - 1 - (batch.num_rows - 1) % ROWS, -1, -ROWS)]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > BYTES:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part
