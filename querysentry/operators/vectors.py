"""Feature vectors as matrices: arrays of numbers, or sparse ones of places and values.

A sparse vector is a struct of its ``size``, the places (``index``, from 0) and the values
(``value``) that are not zero. Tables keep it as it is; an Arrow batch of it becomes a
matrix where numbers are needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SPARSE = "struct<size:int,index:array<int>,value:array<double>>"


def dense(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A matrix with a row per vector; missing numbers are NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    if column.null_count:
        raise ValueError("A row has no features")
    if pa.types.is_struct(column.type):
        size, index, value = (pc.struct_field(column, n) for n in ("size", "index", "value"))
        counts = pc.list_value_length(index).to_numpy(zero_copy_only=False)
        made = np.zeros((len(column), int(pc.max(size).as_py())))
        made[np.repeat(np.arange(len(column)), counts), index.flatten().to_numpy()] = value.flatten().to_numpy(zero_copy_only=False)
        return made
    widths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if (widths != widths[0]).any():
        raise ValueError("Vectors differ in width")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), int(widths[0]))


def pieces(x: np.ndarray, rows: int | None) -> Iterator[np.ndarray]:
    """At most ``rows`` rows at a time."""
    for start in range(0, len(x), rows or max(len(x), 1)):
        yield x[start : start + (rows or len(x))]


def by_row(score: Callable[[np.ndarray], np.ndarray], features: str | Column, rows: int | None = None) -> Column:
    """A number per vector, in matrices of at most ``rows`` rows."""

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        found = [np.asarray(score(x), float) for x in pieces(dense(column), rows)]
        return pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return run(features)


def pack(x: np.ndarray) -> bytes:
    """A matrix as bytes; one of mostly zeros keeps only the other numbers."""
    rows, width = x.shape
    at = np.flatnonzero(x) if np.isfinite(x).all() else np.arange(x.size)
    sparse = 3 * len(at) < 2 * x.size
    head = np.array([rows, width, len(at) if sparse else -1], np.int64).tobytes()
    return head + (at.astype(np.int32).tobytes() + x.ravel()[at].tobytes() if sparse else np.ascontiguousarray(x).tobytes())


def unpack(raw: bytes) -> np.ndarray:
    rows, width, count = np.frombuffer(raw, np.int64, 3).tolist()
    if count < 0:
        return np.frombuffer(raw, float, offset=24).reshape(rows, width)
    made = np.zeros(rows * width)
    made[np.frombuffer(raw, np.int32, count, 24)] = np.frombuffer(raw[24 + 4 * count :], float)
    return made.reshape(rows, width)
