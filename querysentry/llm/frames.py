"""Shared helpers: input columns, Arrow batches of bounded size, shared folders."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querysentry.session import checkpoint_root, shared_path

#: Bytes of text that one step inside a task works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20


def kept_in_process(key: tuple, make: Callable):
    """Make a costly object (a tokenizer, its word cache) once in each worker process.

    Functions travel to executors by value, so their own globals start anew with every
    task; a module of the process does not. Workers outlive stages, so only the object
    asked for last is kept (and number tables): a job's stages don't pile theirs up.
    """
    home = sys.modules.setdefault("_querysentry_kept", types.ModuleType("_querysentry_kept")).__dict__
    if key not in home:
        if key[0] == "powers":
            home[key] = make()
        else:
            forget_kept()
            home[key] = make()
            give_back()
    return home[key]


def forget_kept() -> None:
    """Let go of what earlier stages left in this process, number tables apart."""
    home = sys.modules.setdefault("_querysentry_kept", types.ModuleType("_querysentry_kept")).__dict__
    for old in [k for k in home if isinstance(k, tuple) and k[0] != "powers"]:
        del home[old]
    give_back()


def give_back() -> None:
    """What is free in this process goes back to the machine.

    Executors share a bounded memory with their workers, busy and idle ones, which
    otherwise hold on to the largest size any stage needed.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(batch: pa.RecordBatch, text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of an Arrow batch with at most ``limit`` bytes of text, or one row."""
    if batch.num_rows == 0:
        return
    ends = pa.compute.cumulative_sum(pa.compute.cast(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0), pa.int64()))
    ends = ends.to_numpy(zero_copy_only=False)
    start, base = 0, 0
    while start < len(ends):
        stop = max(start + 1, int(ends.searchsorted(base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start, base = stop, int(ends[stop - 1])


def map_steps(df: DataFrame, columns: list, run: Callable, schema: str, limit: int = STEP_BYTES, keeps: bool = False) -> DataFrame:
    """``run`` on bounded Arrow slices of ``columns`` (which must hold ``text``).

    Nulls in ``text`` are empty texts. Rows stay in their partitions, so nothing is
    shuffled and a lost task is simply run again. A stage that ``keeps`` nothing in its
    process drops what an earlier one kept there; any gives back what is free when a task ends.
    """

    def each(batches):
        if not keeps:
            forget_kept()
        for batch in batches:
            for part in steps(batch, limit=limit):
                made = run(part)
                if made is not None and made.num_rows:
                    yield made
        batch = part = made = None
        (give_back if keeps else forget_kept)()

    return df.select(*columns).mapInArrow(each, schema)


def doc_columns(text: str = "text", key: str = "doc_id") -> list:
    """Key and text under plain names; other columns, whatever their names, are not read."""
    return [F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")]


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: a cut that survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def training_row(key: str = "doc_id"):
    """True for rows whose labels may be learnt: crc32(key as text) mod 3 is not 1."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 != 1
