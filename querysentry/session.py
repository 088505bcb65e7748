"""Session helpers: where shared files go, and when a side may be broadcast."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_GROUPS = 10_000
MAX_BROADCAST_BYTES = 32 << 20
SMALL_GROUP_ROWS = 1_000_000


def local_session(name: str = "querysentry", cpus: int | str = "*") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUERYSENTRY_DRIVER_MEMORY", "12g"))
        # Checkpoints go when nothing refers to them any more.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written tables.

    The cluster names it in ``spark.checkpoint.dir``. Only where neither that
    setting nor a checkpoint directory exists (local tests) a folder is created.
    On a cluster such a folder would be one machine's own, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"Set spark.checkpoint.dir to a folder that all machines of {master} share")
        root = tempfile.mkdtemp(prefix="querysentry-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A fresh path below the shared folder."""
    return "/".join([checkpoint_root(spark).rstrip("/"), *parts, uuid.uuid4().hex])


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so lost executors do not replay it."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


class GroupProfile(NamedTuple):
    """Measured size of a grouping: decides which plan a table gets."""

    groups: int
    largest: int
    #: Rows that surely fit one task, where they are not ``SMALL_GROUP_ROWS``.
    bound: int | None = None

    @property
    def small(self) -> bool:
        """True if any single group surely fits one task."""
        return self.largest <= (self.bound or SMALL_GROUP_ROWS)

    def hint(self, side: DataFrame, row_bytes: int = 256) -> DataFrame:
        """Broadcast hint for a table with one row per group, if those are few and small.

        Otherwise the side stays as it is: Spark plans a shuffled join, and AQE
        splits hot groups.
        """
        fits = self.groups <= MAX_BROADCAST_GROUPS and self.groups * row_bytes <= MAX_BROADCAST_BYTES
        return F.broadcast(side) if fits else side


def profile_groups(source: DataFrame, by: list[str]) -> GroupProfile:
    """Count the groups of ``source`` and the rows of the largest one.

    Only the grouping columns are read, and only one row reaches the driver.
    """
    sizes = source.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    row = sizes.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.max("_n"), F.lit(0)).alias("largest")).first()
    return GroupProfile(row.groups, row.largest)


def join_groups(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join on group columns; a null group meets a null group, as it does in an aggregation."""
    named = right.withColumnsRenamed({c: f"_by_{c}" for c in by})
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return left.join(named, on, how).drop(*(f"_by_{c}" for c in by))


def broadcast_if_small(side: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast a dimension only after its rows were counted (up to the limit)."""
    if side.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(side)
    return side


#: Rows of a log, or of a table of documents, that a task is given, about.
ROWS_PER_TASK, TEXTS_PER_TASK = 1 << 18, 1 << 14


def task_count(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> int:
    """Tasks for a table: one a core, and more as its rows need them, so that no task grows with the table."""
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / rows_per_task))


def spread_small_input(df: DataFrame, *keys: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Use all cores for heavy per-row work on an input with few splits.

    A file with one row group is read by one task. If the input has fewer files than there
    are cores, rows are spread by keys, over as many tasks as they need; other inputs are
    left as they are, unshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(task_count(df, rows_per_task), *keys) if len(df.inputFiles()) < cores else df
