"""Row selection, projection, sampling and splitting."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querysentry import registry
from querysentry.functions.hashing import hash_below, row_hash
from querysentry.operators.quantiles import order_statistic


def filter_split(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("split") == name)


def known_splits(df: DataFrame) -> DataFrame:
    """Rows of the train, test and validation splits; others vanish."""
    return df.filter(F.col("split").isin(registry.SPLITS))


def drop_metadata(df: DataFrame) -> DataFrame:
    """Remove the known non-feature columns, where present."""
    return df.drop(*registry.METADATA_COLUMNS)


def select_mode_features(df: DataFrame, mode: str, lexical: bool = False, keep: list[str] | None = None) -> DataFrame:
    """The numeric columns a mode trains on, in training order, after ``keep``.

    Rule-id mode keeps the sparse ``kind_counts`` map in place of its 1,013
    count columns (``operators.tree.widen_kinds`` makes those on request).
    """
    names = registry.SYNTACTIC + registry.tag_columns(mode) + registry.KEYWORD_STATS
    if mode == "ruleid":
        names = [*names, "kind_counts"]
    return df.select(*(keep or []), *names, *(registry.LEXICAL if lexical else []))


def select_single_input_templates(df: DataFrame, template_ids: list[str]) -> DataFrame:
    """Attack rows made from one of the given templates."""
    return df.filter(F.col("query_template_id").isin(template_ids) & (F.col("label") == 1))


def validation_split(
    df: DataFrame, fraction: float = 0.1, seed: int = 2, key: str = "row_id", exact: bool = False
) -> DataFrame:
    """Relabel a random share of the training rows as validation rows.

    The default decides each row by its own hash: no shuffle, about the wanted
    share. ``exact`` takes precisely ``ceil(fraction * n)`` rows, namely those
    with the smallest hashes; the limiting hash is found as a distributed order
    statistic and rows that share it are told apart by their key.
    """
    train = F.col("split") == "train"
    if not exact:
        return df.withColumn("split", F.when(train & hash_below(F.col(key), seed, fraction), "val").otherwise(F.col("split")))
    rank_value = F.conv(F.substring(row_hash(F.col(key), seed), 1, 13), 16, 10).cast("long").cast("double")
    ranked = df.filter(train).select(F.col(key).alias("_key"), rank_value.alias("_rank"))
    n = ranked.count()
    wanted = math.ceil(round(fraction * n, 9))
    if wanted == 0:
        return df
    limit = order_statistic(ranked, "_rank", wanted - 1)
    below = ranked.filter(F.col("_rank") < limit).count()
    # Only rows with the very same 52-bit hash: practically one.
    tied = [r[0] for r in ranked.filter(F.col("_rank") == limit).orderBy("_key").limit(wanted - below).collect()]
    chosen = (rank_value < limit) | F.col(key).isin(tied)
    return df.withColumn("split", F.when(train & chosen, "val").otherwise(F.col("split")))


def sample_n(df: DataFrame, n: int = 500, seed: int = 2, key: str = "row_id") -> DataFrame:
    """Exactly ``n`` random rows, the same ones whatever the partitioning."""
    return df.orderBy(row_hash(F.col(key), seed), F.col(key)).limit(n)


def sample_fraction(df: DataFrame, percent: float, seed: int = 2, key: str = "row_id") -> DataFrame:
    """About ``percent`` per cent of the rows."""
    return df.filter(hash_below(F.col(key), seed, percent / 100))


def shuffled_first_n(df: DataFrame, n: int, derived: Column, name: str, seed: int = 2, key: str = "row_id") -> DataFrame:
    """The first ``n`` rows, in seeded random order, whose derived value exists.

    Fewer than ``n`` such rows is an error.
    """
    rows = df.withColumn(name, derived).filter(F.col(name).isNotNull())
    if rows.select(key).limit(n).count() < n:
        raise ValueError(f"Fewer than {n} rows qualify")
    return rows.orderBy(row_hash(F.col(key), seed), F.col(key)).limit(n)
