"""Exact order statistics and running totals that do not need a single-task sort.

The size of the groups is measured first. Where every group surely fits one task
the built-in aggregate or window is used. Beyond that both work on one row per distinct value. Values are put into buckets by split
points taken from a quantile sketch, each bucket is ordered by itself, and the
totals of the buckets before it are added. A bucket that is still too large is split again
by itself. The bucket of a row depends on its value only, never on where a task ran, so a
lost executor changes nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querysentry.session import GroupProfile, cut_lineage, profile_groups

SKETCH_ACCURACY = 10_000
#: Buckets of one level, and the rows of a bucket that one task orders.
MAX_BUCKETS, BUCKET_ROWS = 4_096, 1_000_000


def _bucket_count(df: DataFrame, buckets: int | None) -> int:
    wanted = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2, min(wanted, MAX_BUCKETS))


def _bucket(value: Column, splits: Column, coarse: Column, step: int) -> Column:
    """Number of split points below a value: a coarse look-up, then a fine one."""
    skipped = F.size(F.filter(coarse, lambda s: s < value))
    near = F.slice(splits, skipped * step + 1, step)
    return skipped * step + F.size(F.filter(near, lambda s: s < value))


def running_totals(
    counts: DataFrame,
    by: list[str],
    order: str,
    sums: list[str],
    descending: bool = False,
    following: bool = False,
    buckets: int | None = None,
    profile: GroupProfile | None = None,
    level: int = 0,
) -> DataFrame:
    """Add ``cum_<c>`` (running sum) and ``all_<c>`` (group sum) for each of ``sums``.

    ``counts`` has one row per group and distinct ``order`` value. With
    ``following`` the next row's values come along as ``next_<c>``. ``profile``
    is an upper bound of the group sizes if already known.
    """
    profile = profile or profile_groups(counts, by)
    direction = F.desc if descending else F.asc
    if profile.small:
        whole = W.partitionBy(*by)
        ordered = whole.orderBy(direction(order))
        return counts.select(
            *counts.columns,
            *[F.sum(c).over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow)).alias(f"cum_{c}") for c in sums],
            *[F.sum(c).over(whole).alias(f"all_{c}") for c in sums],
            *([F.lead(c).over(ordered).alias(f"next_{c}") for c in sums] if following else []),
        )
    n = _bucket_count(counts, buckets)
    step = math.ceil(math.sqrt(n))
    # The group columns go into one struct, which is never null, so that a null group
    # takes part in the joins below just as it does in a window.
    kept, group, bucket = counts.columns, [f"_group{level}"], f"_bucket{level}"
    counts = counts.withColumn(group[0], F.struct(*by) if by else F.lit(1))

    known = F.when(~F.isnan(F.col(order).cast("double")), F.col(order).cast("double"))
    sketched = F.percentile_approx(known, [i / n for i in range(1, n)], max(SKETCH_ACCURACY, 20 * n))
    splits = counts.groupBy(*group).agg(
        F.coalesce(F.array_distinct(sketched), F.array().cast("array<double>")).alias("_splits")
    ).withColumn("_coarse", F.filter("_splits", lambda _, i: (i + 1) % step == 0))
    bucketed = counts.join(profile.hint(splits, 64 + 10 * n), group).withColumn(
        bucket, _bucket(F.col(order), F.col("_splits"), F.col("_coarse"), step)
    ).drop("_splits", "_coarse")

    # At most `n` rows per group from here to the offsets.
    first = F.max_by if descending else F.min_by
    totals = cut_lineage(bucketed.groupBy(*group, bucket).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(c).alias(f"_sum_{c}") for c in sums],
        *([first(c, order).alias(f"_first_{c}") for c in sums] if following else []),
    ))
    across = W.partitionBy(*group).orderBy(direction(bucket))
    before = across.rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *group,
        bucket,
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in sums],
        *[F.sum(f"_sum_{c}").over(W.partitionBy(*group)).alias(f"_all_{c}") for c in sums],
        *([F.lead(f"_first_{c}").over(across).alias(f"_lead_{c}") for c in sums] if following else []),
    )
    size = totals.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.max("_rows"), F.lit(0)).alias("largest")).first()
    # Inside the buckets by the window, or by another level of buckets where one is too large
    # and splitting still helps.
    bound = profile.bound or BUCKET_ROWS
    if size.largest > bound:
        bucketed = cut_lineage(bucketed)
        bound = bound if size.largest < profile.largest else size.largest
    inside = running_totals(
        bucketed, [*group, bucket], order, sums, descending, following, buckets, GroupProfile(size.groups, size.largest, bound), level + 1
    )
    joined = inside.join(offsets, [*group, bucket])
    return joined.select(
        *kept,
        *[(F.col(f"_before_{c}") + F.col(f"cum_{c}")).alias(f"cum_{c}") for c in sums],
        *[F.col(f"_all_{c}").alias(f"all_{c}") for c in sums],
        *([F.coalesce(f"next_{c}", f"_lead_{c}").alias(f"next_{c}") for c in sums] if following else []),
    )


def _at_ranks(
    values: DataFrame, by: list[str], q: float, low_rank: Column, high_rank: Column, profile: GroupProfile, margin: float = 2 / SKETCH_ACCURACY
) -> DataFrame:
    """Per group: row count and the values at two ranks (from 0) near quantile ``q``.

    A sketch brackets the wanted ranks with twice its guaranteed rank error. Only
    values inside the bracket are counted one by one; those below it count as one. Groups
    whose bracket does not hold the ranks get a bracket eight times as wide, until it is
    everything.
    """
    group = ["_all"]
    values = values.select(*values.columns, (F.struct(*by) if by else F.lit(1)).alias("_all"))
    found = None
    while True:
        tried = cut_lineage(_in_bracket(values, group, q, low_rank, high_rank, profile, margin))
        sure = tried.filter("held")
        found = sure if found is None else found.unionByName(sure)
        missed = tried.filter("NOT held").select(*group)
        if missed.isEmpty():
            break
        values = values.join(profile.hint(missed), group, "left_semi")
        margin *= 8
    return found.select(*(F.col(f"_all.{c}").alias(c) for c in by), "n", "low", "high")


def _in_bracket(
    values: DataFrame, group: list[str], q: float, low_rank: Column, high_rank: Column, profile: GroupProfile, margin: float
) -> DataFrame:
    """Per group ``n``, the values at both ranks, and whether the bracket ``held`` them."""
    sketch = F.percentile_approx("_v", [max(q - margin, 0.0), min(q + margin, 1.0)], SKETCH_ACCURACY)
    stats = values.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), sketch.alias("_s")
    )
    # For few rows, or at the ends, the bracket is everything on that side.
    few = F.col("n") * margin < 4 if margin >= 2 / SKETCH_ACCURACY else F.lit(False)
    stats = stats.select(
        *group,
        "n",
        F.when(few | F.lit(q <= margin), F.col("_min")).otherwise(F.col("_s")[0]).alias("_lo"),
        F.when(few | F.lit(q >= 1 - margin), F.col("_max")).otherwise(F.col("_s")[1]).alias("_hi"),
    )
    bounds = profile.hint(stats)
    counts = (
        values.join(bounds.select(*group, "_lo", "_hi"), group)
        .filter(F.col("_v") <= F.col("_hi"))
        .groupBy(*group, F.when(F.col("_v") < F.col("_lo"), F.lit(float("-inf"))).otherwise(F.col("_v")).alias("_v"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    ranked = running_totals(counts, group, "_v", ["c"], profile=profile).join(bounds, group)
    return ranked.groupBy(*group).agg(
        F.first("n").alias("n"),
        F.first("_lo").alias("_lo"),
        F.min(F.when(F.col("cum_c") > low_rank, F.col("_v"))).alias("low"),
        F.min(F.when(F.col("cum_c") > high_rank, F.col("_v"))).alias("high"),
    ).withColumn("held", F.coalesce((F.col("low") >= F.col("_lo")) & F.col("high").isNotNull(), F.lit(False)))


def _values(df: DataFrame, value: str | Column, by: list[str]) -> DataFrame:
    column = F.col(value) if isinstance(value, str) else value
    return df.select(*by, column.cast("double").alias("_v")).filter(F.col("_v").isNotNull())


def exact_quantile(
    df: DataFrame, value: str | Column, q: float, by: list[str] | None = None, profile: GroupProfile | None = None
) -> DataFrame:
    """Quantile with linear interpolation between neighbouring ranks, per group.

    Returns the group columns, ``n`` and ``quantile``; nulls are left out.
    """
    return exact_quantiles(df, value, [q], by, profile).drop("q")


def exact_quantiles(
    df: DataFrame,
    value: str | Column,
    qs: list[float],
    by: list[str] | None = None,
    profile: GroupProfile | None = None,
) -> DataFrame:
    """Several quantiles of one column, one row per group and ``q``."""
    by = by or []
    profile = profile or profile_groups(df, by)
    values = _values(df, value, by)
    if profile.small:
        wide = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile("_v", F.lit(qs)).alias("_p"))
        return wide.select(
            *by, F.inline(F.zip_with(F.lit([float(q) for q in qs]), "_p", lambda q, p: F.struct(q.alias("q"), p.alias("quantile")))), "n"
        ).select(*by, "q", "n", "quantile")
    parts = []
    for q in qs:
        position = (F.col("n") - 1) * F.lit(float(q))
        found = _at_ranks(values, by, q, F.floor(position), F.ceil(position), profile)
        # The same arithmetic as the built-in aggregate, so both plans give the same bits.
        low, high = F.floor(position), F.ceil(position)
        mixed = (high - position) * F.col("low") + (position - low) * F.col("high")
        between = F.when((low == high) | (F.col("low") == F.col("high")), F.col("low")).otherwise(mixed)
        parts.append(found.select(*by, F.lit(float(q)).alias("q"), "n", between.alias("quantile")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def order_statistic(df: DataFrame, value: str | Column, rank: int) -> float:
    """The value with ``rank`` (from 0) smaller-or-earlier values, as a scalar."""
    values = _values(df, value, [])
    n = values.count()
    if not 0 <= rank < n:
        raise ValueError(f"Rank {rank} outside 0..{n - 1}")
    q = rank / (n - 1) if n > 1 else 0.0
    return _at_ranks(values, [], q, F.lit(rank), F.lit(rank), GroupProfile(1, n)).first().low
