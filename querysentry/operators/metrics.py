"""Thresholds and quality measures of scored rows.

A scored row has ``row_id``, ``model``, ``score`` and ``label``; some measures
also use ``split``, ``attack_technique`` and ``statement_type``. Results are
numbers; formatting them as text is left to the reader of the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querysentry import registry
from querysentry.operators.quantiles import exact_quantile
from querysentry.session import GroupProfile, join_groups, profile_groups

MODEL = ["model"]


def threshold(
    scores: DataFrame, max_rate: float = registry.MAX_FALSE_POSITIVE_RATE, by: list[str] = MODEL, score: str = "score"
) -> DataFrame:
    """The (1 - rate) quantile of all the given scores, interpolated, per model.

    Give it the validation rows; their labels do not matter.
    """
    return exact_quantile(scores, score, 1 - max_rate, by).select(*by, F.col("quantile").alias("threshold"))


def threshold_fixed_fpr(scores: DataFrame, fpr: float, by: list[str] = MODEL) -> DataFrame:
    """The same quantile over rows with label 0: give it the test rows."""
    return threshold(scores.filter(F.col("label") == 0), fpr, by)


def with_thresholds(
    scores: DataFrame, thresholds: DataFrame, by: list[str] = MODEL, profile: GroupProfile | None = None
) -> DataFrame:
    """Attach each model's threshold to its rows. A model without one is an error, not left out."""
    profile = profile or profile_groups(scores, by)
    missing = F.raise_error(F.concat(F.lit("No threshold for "), F.to_json(F.struct(*by)) if by else F.lit("the scores")))
    joined = join_groups(scores, profile.hint(thresholds), by, "left")
    return joined.withColumn("threshold", F.coalesce("threshold", missing.cast("double")))


def exceedance(scores: DataFrame, thresholds: DataFrame, by: list[str] = MODEL) -> DataFrame:
    """Number and share of rows strictly above the threshold."""
    above = F.col("score") > F.col("threshold")
    return (
        with_thresholds(scores, thresholds, by).groupBy(*by, "threshold")
        .agg(F.count_if(above).alias("n_above"), (F.count_if(above) / F.count(F.lit(1))).alias("share_above"))
    )


def insider_as_fn(scores: DataFrame, by: list[str] = MODEL, technique: str = "insider") -> DataFrame:
    """Give rows of one technique their model's lowest score, so none is predicted.

    For attacks that leave no trace to collect. Apply it after the threshold is fixed.
    """
    lowest = profile_groups(scores, by).hint(scores.groupBy(*by).agg(F.min("score").alias("_lowest")))
    changed = F.when(F.col("attack_technique") == technique, F.col("_lowest")).otherwise(F.col("score"))
    return join_groups(scores, lowest, by).withColumn("score", changed).drop("_lowest").select(*scores.columns)


def predict(scores: DataFrame, thresholds: DataFrame, by: list[str] = MODEL) -> DataFrame:
    """``pred`` is 1 from the threshold upwards (the threshold itself included)."""
    scored = with_thresholds(scores, thresholds, by)
    return scored.withColumn("pred", (F.col("score") >= F.col("threshold")).cast("int")).drop("threshold")


def _cells() -> list[Column]:
    label, pred = F.col("label"), F.col("pred")
    return [
        F.count_if((label == 0) & (pred == 0)).alias("tn"),
        F.count_if((label == 0) & (pred == 1)).alias("fp"),
        F.count_if((label == 1) & (pred == 0)).alias("fn"),
        F.count_if((label == 1) & (pred == 1)).alias("tp"),
    ]


def confusion(predictions: DataFrame, by: list[str] = MODEL) -> DataFrame:
    """The four cells, always all of them."""
    return predictions.groupBy(*by).agg(*_cells())


def _ratio(part: Column, whole: Column) -> Column:
    """Zero where the denominator is zero."""
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def _scores(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    return {"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn)}


def basic_metrics(predictions: DataFrame, by: list[str] = MODEL) -> DataFrame:
    """Accuracy, precision, recall, F1 and false-positive rate."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return confusion(predictions, by).select(
        *by,
        _ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        *[c.alias(n) for n, c in _scores(tp, fp, fn).items()],
        _ratio(fp, fp + tn).alias("fpr"),
    )


def averaged_metrics(predictions: DataFrame, average: str = "binary", by: list[str] = MODEL) -> DataFrame:
    """Precision, recall and F1 of class 1, or averaged over both classes.

    ``macro`` is the mean of the classes that occur as a label or a prediction,
    ``micro`` pools their counts.
    """
    cells = confusion(predictions, by)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    if average == "binary":
        picked = _scores(tp, fp, fn)
    elif average == "micro":
        picked = _scores(tp + tn, fp + fn, fn + fp)
    elif average == "macro":
        positive, negative = _scores(tp, fp, fn), _scores(tn, fn, fp)
        has_one, has_zero = (tp + fp + fn > 0).cast("int"), (tn + fp + fn > 0).cast("int")
        picked = {n: _ratio(positive[n] * has_one + negative[n] * has_zero, has_one + has_zero) for n in positive}
    else:
        raise ValueError(f"Unknown average: {average}")
    return cells.select(*by, *[c.alias(n) for n, c in picked.items()])


def binomial_ci(value: Column, n: Column) -> Column:
    """Half-width of the 95 % confidence interval of a proportion over ``n`` rows."""
    return registry.CONFIDENCE_Z * F.sqrt(value * (1 - value) / n)


def recall_by(predictions: DataFrame, column: str, by: list[str] = MODEL) -> DataFrame:
    """Recall within each value of ``column`` that occurs among the attacks."""
    hit, attack = (F.col("label") == 1) & (F.col("pred") == 1), F.col("label") == 1
    return (
        predictions.filter(F.col(column).isNotNull()).groupBy(*by, column)
        .agg(F.count_if(attack).alias("n_attacks"), F.count_if(hit).alias("n_found"))
        .filter("n_attacks > 0")
        .select(*by, column, "n_attacks", (F.col("n_found") / F.col("n_attacks")).alias("recall"))
    )


def recall_by_technique(predictions: DataFrame, by: list[str] = MODEL) -> DataFrame:
    return recall_by(predictions, "attack_technique", by)


def recall_by_statement_type(predictions: DataFrame, by: list[str] = MODEL) -> DataFrame:
    return recall_by(predictions, "statement_type", by)


def balanced_accuracy_by_technique(predictions: DataFrame, exact: bool = False, by: list[str] = MODEL) -> DataFrame:
    """Mean of the true-negative rate and the recall of every technique.

    Technique recalls enter as per cent rounded to two decimals, as the report
    shows them, unless ``exact``.
    """
    recall = F.col("recall") if exact else F.round(F.col("recall") * 100, 2) / 100
    techniques = recall_by_technique(predictions, by).select(*by, recall.alias("recall"))
    normal = (
        predictions.filter(F.col("label") == 0).groupBy(*by)
        .agg((F.count_if(F.col("pred") == 0) / F.count(F.lit(1))).alias("recall"))
    )
    both = normal.unionByName(techniques)
    return both.groupBy(*by).agg(F.avg("recall").alias("balanced_accuracy"))


def prevalence(df: DataFrame, by: list[str] = MODEL) -> DataFrame:
    """Share of label 1: the precision of a random classifier."""
    return df.groupBy(*by).agg(F.avg(F.col("label").cast("double")).alias("prevalence"))


def class_counts_by_split(df: DataFrame) -> DataFrame:
    return df.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


def label_agreement(results: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows whose models disagree about the label, or that some model lacks.

    One grouped aggregate instead of a self-join per pair of models.
    """
    models = results.select("model").distinct().count()
    return (
        results.groupBy(key)
        .agg(
            F.count_distinct("model").alias("n_models"),
            F.min("label").alias("min_label"),
            F.max("label").alias("max_label"),
        )
        .filter((F.col("n_models") != models) | (F.col("min_label") != F.col("max_label")))
    )
