"""Arrow batches taken apart and put together again, so that Python holds few rows as objects, however many a batch has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

#: Rows that are Python objects at once, and cells (or the like) after which a batch is handed on.
ROWS, CELLS = 64, 16_384


def rows_of(batches: Iterator[pa.RecordBatch], size: int = ROWS) -> Iterator[tuple]:
    """The rows of all batches, one by one."""
    for b in batches:
        for at in range(0, b.num_rows, size):
            yield from zip(*(c.to_pylist() for c in b.slice(at, size).columns), strict=True)


def batches_of(rows: Iterator[tuple], schema: pa.Schema, weight: Callable[[tuple], int] = lambda row: 1, most: int = CELLS) -> Iterator[pa.RecordBatch]:
    """The rows as batches, each handed on as soon as its rows weigh ``most``."""
    held: list[tuple] = []
    weighs = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        weighs += weight(row)
        if weighs >= most:
            yield batch()
            held, weighs = [], 0
    if held:
        yield batch()


def mapped(f: Callable, kind: pa.DataType, *arrays: pa.Array, size: int = ROWS) -> pa.Array:
    """``f`` of each row of the arrays, as an array."""
    parts = [pa.array([f(*v) for v in zip(*(a.slice(at, size).to_pylist() for a in arrays), strict=True)], kind) for at in range(0, len(arrays[0]), size)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)
