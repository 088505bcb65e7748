"""Work on whole groups of rows, many groups at a time, in a stream of sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from querysentry.llm.frames import forget_kept


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold every row of the groups in them, from batches sorted by ``key``.

    Only the last group of a batch waits for the next one.
    """
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        start = 0
        if kept and keys[0] != kept[-1].column(key)[0]:
            yield pa.Table.from_batches(kept)
            kept = []
        if keys[0] != keys[-1]:
            start = int(np.searchsorted(pa.compute.equal(keys, keys[-1]).to_numpy(zero_copy_only=False), True))
            yield pa.Table.from_batches([*kept, batch.slice(0, start)])
            kept = []
        kept.append(batch.slice(start))
    if kept:
        yield pa.Table.from_batches(kept)


def map_groups(df: DataFrame, key: str, order: list, run: Callable, schema: str) -> DataFrame:
    """``run`` (table -> iterator of record batches) on whole groups of ``key``, rows in ``order`` inside them.

    A call gets many groups, so that small ones cost no call each; the caller bounds a group's size.
    """

    def each(batches):
        forget_kept()
        for part in whole_groups(batches, key):
            yield from run(part)
        part = None
        forget_kept()

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(each, schema)


def borders(table: pa.Table, key: str) -> np.ndarray:
    """Where the groups of a table begin; the last entry is the end."""
    keys = table.column(key).combine_chunks()
    n = len(keys)
    if n < 2:
        return np.array([0, n])
    change = pa.compute.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(change) + 1, [n]])
