"""Arrow batches in pieces, for Python that works row by row."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Bytes and rows that become Python objects at a time, however many rows a batch of Spark's has.
PIECE_BYTES, PIECE_ROWS = 1 << 20, 512


def pieces(batches: Iterable[pa.Array | tuple[pa.Array, ...]]) -> Iterator[tuple[list, ...]]:
    """The values of neighbouring rows, column by column: about PIECE_BYTES at a time, one row at least."""
    for batch in batches:
        columns = batch if isinstance(batch, tuple) else (batch,)
        rows = len(columns[0])
        step = max(1, min(PIECE_ROWS, rows * PIECE_BYTES // max(1, sum(c.nbytes for c in columns))))
        for at in range(0, rows, step):
            yield tuple(c.slice(at, step).to_pylist() for c in columns)
