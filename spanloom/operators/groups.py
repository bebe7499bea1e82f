"""Groups of rows as slices of sorted Arrow batches, without a call into Python for each group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Slices = Callable[[pa.Table, np.ndarray, np.ndarray], pa.RecordBatch]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of whole groups with the groups' begins and ends; rows come sorted by the keys, and a group that reaches over batches is held until it ends."""
    held: pa.Table | None = None

    def bounds(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in keys:
            x = t.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        starts = bounds(t)
        if len(starts) > 1:
            yield t.slice(0, starts[-1]), starts[:-1], starts[1:]
        held = t.slice(starts[-1]) if len(starts) else t
    if held is not None and held.num_rows:
        starts = bounds(held)
        yield held, starts, np.append(starts[1:], held.num_rows)


def map_groups(df: DataFrame, keys: list[str], order: list[str], f: Slices, schema: str) -> DataFrame:
    """f on the groups of a partition, in slices of batches; one shuffle by the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, lo, hi in whole_groups(batches, keys):
            yield f(t.combine_chunks(), lo, hi)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
