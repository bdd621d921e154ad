"""Reading sorted Arrow batches inside a task: whole groups of rows, binary columns, flat lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int = 2) -> Iterator[pa.RecordBatch]:
    """One batch per run of rows that agree in their first columns (integers without nulls)."""
    held: list[pa.RecordBatch] = []
    name: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for v in values:
            change |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = tuple(v[a] for v in values)
            if held and own != name:
                yield pa.concat_batches(held)
                held = []
            name = own
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.concat_batches(held)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all values, length of each list) of a list column without nulls."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), lengths


def array_of(value: bytes, kind: type, width: int | None = None) -> np.ndarray:
    """The numbers of a binary value, in rows of the given width."""
    numbers = np.frombuffer(value, dtype=kind)
    return numbers if width is None else numbers.reshape(-1, width)


def firsts(rows: np.ndarray, *order: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k entries of each row number, by the given keys (first key first)."""
    by = np.lexsort((*order[::-1], rows))
    ranked = rows[by]
    start = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(by) else np.zeros(0, dtype=np.int64)
    length = np.diff(np.r_[start, len(by)])
    rank = np.arange(len(by)) - np.repeat(start, length)
    return by[rank < k]
