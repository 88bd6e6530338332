"""Arrow batches in pieces of bounded size, so that a worker's Python objects do not grow with a batch's rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Bytes of a piece that are turned into Python objects at a time.
PIECE_BYTES = 1 << 20


def pieces(batches: Iterable[pa.RecordBatch], rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Pieces of at most PIECE_BYTES (or one row) and so many rows, in order; nothing is copied, empty batches are left out."""
    for batch in batches:
        step = rows or max(1, batch.num_rows)
        left = [batch.slice(i, step) for i in range(0, batch.num_rows, step)][::-1]
        while left:
            piece = left.pop()
            if piece.num_rows > 1 and piece.nbytes > PIECE_BYTES:
                half = piece.num_rows // 2
                left += [piece.slice(half), piece.slice(0, half)]
            else:
                yield piece
