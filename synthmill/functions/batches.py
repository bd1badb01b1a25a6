"""Rows to and from Arrow batches inside tasks, a bounded number of bytes at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Rows and bytes of an outgoing batch; a larger row is a batch of its own.
ROWS, BYTES = 2048, 4 << 20
#: Rows of an incoming batch that are Python values at once.
TAKEN = 64


def rows_of(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The rows of the batches, as tuples of the columns named."""
    for batch in batches:
        for start in range(0, batch.num_rows, TAKEN):
            piece = batch.slice(start, TAKEN)
            yield from zip(*(piece.column(c).to_pylist() for c in columns), strict=True)


def batched(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches, whatever input rows they come from; texts and binaries count towards the size of a batch."""
    sized = [i for i, f in enumerate(schema) if pa.types.is_string(f.type) or pa.types.is_binary(f.type)]

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += sum(len(row[i]) for i in sized if row[i] is not None)
        if len(held) >= ROWS or weight > BYTES:
            yield batch()
            held, weight = [], 0
    if held:
        yield batch()
