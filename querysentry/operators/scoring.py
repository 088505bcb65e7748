"""Scoring tables with a user's own functions, and measuring throughput."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querysentry import registry
from querysentry.operators.vectors import by_row


def score_table(
    df: DataFrame,
    features_fn: Callable[[DataFrame], DataFrame],
    score_fn: Callable[[np.ndarray], np.ndarray],
    batch_size: int | None = registry.AE_BATCH,
    keep: list[str] | None = None,
) -> DataFrame:
    """Score every row; rows keep their identity, whatever the batches.

    ``features_fn`` is plain DataFrame code that adds a ``features`` array.
    ``score_fn`` maps a matrix to one score per row; it gets at most
    ``batch_size`` rows at a time.
    """

    return features_fn(df).select(*(keep or ["row_id"]), by_row(score_fn, "features", batch_size).alias("score"))


def throughput(scores: DataFrame, model: str) -> DataFrame:
    """Force the scoring and report model, elapsed seconds and number of rows."""
    started = time.monotonic()
    n = scores.agg(F.count("score").alias("n")).first().n
    elapsed = time.monotonic() - started
    return scores.sparkSession.createDataFrame(
        [(model, elapsed, n)], "model string, elapsed_seconds double, n_samples long"
    )
