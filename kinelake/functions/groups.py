"""Vectorised processing of many whole groups at a time.

``applyInPandas`` calls Python once per group, which costs about a
millisecond each; trajectory tables have millions of small groups.  Here the
rows are hash-partitioned and sorted on integer keys, and a kernel gets Arrow
tables holding many complete groups at once, so that it can work on flat
numpy arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinelake.session import map_arrow

CHUNK_ROWS = 200_000


def _last_group_start(table: pa.Table, keys: list[str]) -> int:
    start = 0
    for k in keys:
        v = table[k].to_numpy()
        other = np.flatnonzero(v != v[-1])
        if len(other):
            start = max(start, int(other[-1]) + 1)
    return start


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = CHUNK_ROWS) -> Iterator[pa.Table]:
    """Arrow tables of complete groups out of batches sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held)
            at = _last_group_start(table, keys)
            if at:
                yield table.slice(0, at).combine_chunks()
                rest = table.slice(at).combine_chunks()
                held, n = rest.to_batches(), rest.num_rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def map_groups(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    kernel: Callable[[pa.Table], pa.RecordBatch | pa.Table | None],
    schema: str,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Shuffle ``df`` on its non-null integer ``keys``, sort by keys and
    ``order`` inside each partition, and run ``kernel`` over chunks of whole
    groups.  A group must be bounded by construction (callers block hot ones).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in whole_groups(batches, keys, rows):
            out = kernel(chunk)
            if out is None:
                continue
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out.to_batches()

    return map_arrow(df.repartition(*keys).sortWithinPartitions(*keys, *order), run, schema)


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Boolean mask of the first row of each group in sorted key arrays."""
    first = np.zeros(len(keys[0]), bool)
    if len(first):
        first[0] = True
        for k in keys:
            first[1:] |= k[1:] != k[:-1]
    return first


def column(table: pa.Table, name: str, fill: float | int | None = None) -> np.ndarray:
    """A column as numpy; nulls become ``fill`` (NaN for floats if not given)."""
    c = table[name].combine_chunks() if isinstance(table[name], pa.ChunkedArray) else table[name]
    if c.null_count and fill is not None:
        c = c.fill_null(fill)
    return c.to_numpy(zero_copy_only=False)
