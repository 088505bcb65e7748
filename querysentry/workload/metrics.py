"""Queries over scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from querysentry import registry
from querysentry.operators import curves as C
from querysentry.operators import metrics as M
from querysentry.operators import traces as TR
from querysentry.plans import evaluation as E
from querysentry.session import shared_path
from querysentry.sources import sinks
from querysentry.workload.bindings import SCORES, STATEMENTS, scores, statements
from querysentry.workload.registry import query


def _val(spark, sf_dir):
    return scores(spark, sf_dir).filter("split = 'val'")


def _test(spark, sf_dir):
    return scores(spark, sf_dir).filter("split = 'test'")


def _rounded(df, *columns):
    """Nine decimals: engines add floating-point numbers in different orders."""
    return df.withColumns({c: F.round(c, 9) for c in columns})


THRESHOLD = f"""SELECT model, quantile_cont(score, 0.999) AS threshold FROM ({SCORES}) WHERE split = 'val' GROUP BY model"""
FIXED = f"""SELECT model, quantile_cont(score, 0.99) AS threshold FROM ({SCORES}) WHERE split = 'test' AND label = 0 GROUP BY model"""
LOOSE = f"""SELECT model, quantile_cont(score, 0.9) AS threshold FROM ({SCORES}) WHERE split = 'val' GROUP BY model"""
PREDICTED = f"""SELECT s.*, CAST(s.score >= t.threshold AS INT) AS pred FROM ({SCORES}) s JOIN ({LOOSE}) t ON t.model = s.model
WHERE s.split = 'test'"""


@query("threshold", f"SELECT model, ROUND(threshold, 9) AS threshold FROM ({THRESHOLD})")
def threshold(spark, sf_dir):
    return _rounded(M.threshold(_val(spark, sf_dir)), "threshold")


@query("threshold_fixed_fpr", f"SELECT model, ROUND(threshold, 9) AS threshold FROM ({FIXED})")
def threshold_fixed_fpr(spark, sf_dir):
    return _rounded(M.threshold_fixed_fpr(_test(spark, sf_dir), 0.01), "threshold")


@query(
    "exceedance",
    f"""SELECT s.model, ROUND(t.threshold, 9) AS threshold, COUNT(*) FILTER (WHERE score > t.threshold) AS n_above,
ROUND(COUNT(*) FILTER (WHERE score > t.threshold) / COUNT(*), 9) AS share_above
FROM ({SCORES}) s JOIN ({THRESHOLD}) t ON t.model = s.model WHERE s.split = 'val' GROUP BY s.model, t.threshold""",
)
def exceedance(spark, sf_dir):
    val = _val(spark, sf_dir)
    return _rounded(M.exceedance(val, M.threshold(val)), "threshold", "share_above")


@query(
    "insider_as_fn",
    f"""SELECT row_id, model, CASE WHEN attack_technique = 'insider' THEN MIN(score) OVER (PARTITION BY model) ELSE score END AS score,
label, attack_technique, statement_type, split, errno FROM ({SCORES}) WHERE split = 'test'""",
)
def insider_as_fn(spark, sf_dir):
    return M.insider_as_fn(_test(spark, sf_dir))


def _predicted(spark, sf_dir):
    return M.predict(_test(spark, sf_dir), M.threshold(_val(spark, sf_dir), 0.1))


@query("predict", f"SELECT row_id, model, label, pred FROM ({PREDICTED})")
def predict(spark, sf_dir):
    return _predicted(spark, sf_dir).select("row_id", "model", "label", "pred")


CELLS = f"""SELECT model, COUNT(*) FILTER (WHERE label = 0 AND pred = 0) AS tn, COUNT(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
COUNT(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, COUNT(*) FILTER (WHERE label = 1 AND pred = 1) AS tp
FROM ({PREDICTED}) GROUP BY model"""


@query("confusion", CELLS)
def confusion(spark, sf_dir):
    return M.confusion(_predicted(spark, sf_dir))


BASIC = f"""SELECT model, (tp + tn) / (tp + tn + fp + fn) AS accuracy, COALESCE(tp / NULLIF(tp + fp, 0), 0) AS "precision",
COALESCE(tp / NULLIF(tp + fn, 0), 0) AS recall, COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0) AS f1,
COALESCE(fp / NULLIF(fp + tn, 0), 0) AS fpr FROM ({CELLS})"""


@query(
    "basic_metrics",
    f"""SELECT model, ROUND(accuracy, 9) AS accuracy, ROUND("precision", 9) AS "precision", ROUND(recall, 9) AS recall,
ROUND(f1, 9) AS f1, ROUND(fpr, 9) AS fpr FROM ({BASIC})""",
)
def basic_metrics(spark, sf_dir):
    return _rounded(M.basic_metrics(_predicted(spark, sf_dir)), "accuracy", "precision", "recall", "f1", "fpr")


@query(
    "averaged_metrics",
    f"""SELECT 'binary' AS average, model, ROUND(tp / (tp + fp), 9) AS "precision", ROUND(tp / (tp + fn), 9) AS recall,
ROUND(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM ({CELLS})
UNION ALL SELECT 'macro', model, ROUND((tp / (tp + fp) + tn / (tn + fn)) / 2, 9), ROUND((tp / (tp + fn) + tn / (tn + fp)) / 2, 9),
ROUND((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 9) FROM ({CELLS})
UNION ALL SELECT 'micro', model, ROUND((tp + tn) / (tp + tn + fp + fn), 9), ROUND((tp + tn) / (tp + tn + fp + fn), 9),
ROUND((tp + tn) / (tp + tn + fp + fn), 9) FROM ({CELLS})""",
)
def averaged_metrics(spark, sf_dir):
    predicted = _predicted(spark, sf_dir)
    parts = [
        M.averaged_metrics(predicted, a).select(F.lit(a).alias("average"), "model", "precision", "recall", "f1")
        for a in ("binary", "macro", "micro")
    ]
    return _rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), "precision", "recall", "f1")


COUNTS = f"""SELECT model, score, COUNT(*) FILTER (WHERE label = 1) AS pos, COUNT(*) FILTER (WHERE label = 0) AS neg
FROM ({SCORES}) WHERE split = 'test' GROUP BY model, score"""
RUNNING = f"""SELECT model, score, pos, neg, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp,
SUM(pos) OVER (PARTITION BY model) AS p, SUM(neg) OVER (PARTITION BY model) AS n,
LEAD(pos) OVER (PARTITION BY model ORDER BY score DESC) AS next_pos, LEAD(neg) OVER (PARTITION BY model ORDER BY score DESC) AS next_neg
FROM ({COUNTS}) WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING)"""
AREAS = f"""SELECT model, SUM((r - r0) * (pr + pr0) / 2) AS auprc, SUM((f - f0) * (r + r0) / 2) AS auroc FROM (
SELECT model, tp / p AS r, fp / n AS f, tp / (tp + fp) AS pr,
 COALESCE(LAG(tp / p) OVER o, 0) AS r0, COALESCE(LAG(fp / n) OVER o, 0) AS f0, COALESCE(LAG(tp / (tp + fp)) OVER o, 1) AS pr0
FROM ({RUNNING}) WINDOW o AS (PARTITION BY model ORDER BY score DESC)) GROUP BY model"""


@query(
    "pr_curve",
    f"""SELECT model, score AS threshold, ROUND(tp / (tp + fp), 9) AS "precision", ROUND(tp / p, 9) AS recall FROM ({RUNNING})
UNION ALL SELECT DISTINCT model, NULL::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE FROM ({COUNTS})""",
)
def pr_curve(spark, sf_dir):
    return _rounded(C.pr_curve(_test(spark, sf_dir)), "precision", "recall")


@query("auprc", f"SELECT model, ROUND(auprc, 9) AS auprc FROM ({AREAS})")
def auprc(spark, sf_dir):
    return _rounded(C.auprc(_test(spark, sf_dir)), "auprc")


@query(
    "roc_curve",
    f"""SELECT model, score AS threshold, ROUND(fp / n, 9) AS fpr, ROUND(tp / p, 9) AS tpr FROM ({RUNNING})
WHERE next_pos IS NULL OR next_pos <> pos OR next_neg <> neg OR tp + fp = pos + neg
UNION ALL SELECT DISTINCT model, 'inf'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM ({COUNTS})""",
)
def roc_curve(spark, sf_dir):
    return _rounded(C.roc_curve(_test(spark, sf_dir)), "fpr", "tpr")


@query("auroc", f"SELECT model, ROUND(auroc, 9) AS auroc FROM ({AREAS})")
def auroc(spark, sf_dir):
    return _rounded(C.auroc(_test(spark, sf_dir)), "auroc")


@query(
    "binomial_ci",
    f"""SELECT a.model, ROUND(1.96 * sqrt(auroc * (1 - auroc) / n), 9) AS auroc_ci,
ROUND(1.96 * sqrt(auprc * (1 - auprc) / n), 9) AS auprc_ci
FROM ({AREAS}) a JOIN (SELECT model, COUNT(*) AS n FROM ({SCORES}) WHERE split = 'test' GROUP BY model) c ON c.model = a.model""",
)
def binomial_ci(spark, sf_dir):
    test = _test(spark, sf_dir)
    sizes = test.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    return _rounded(
        C.curve_areas(test).join(sizes, "model").select(
            "model", *[M.binomial_ci(F.col(a), F.col("n")).alias(f"{a}_ci") for a in ("auroc", "auprc")]
        ),
        "auroc_ci",
        "auprc_ci",
    )


def _recall_sql(column: str) -> str:
    return f"""SELECT model, {column}, COUNT(*) FILTER (WHERE label = 1) AS n_attacks,
COUNT(*) FILTER (WHERE label = 1 AND pred = 1) / COUNT(*) FILTER (WHERE label = 1) AS recall
FROM ({PREDICTED}) WHERE {column} IS NOT NULL GROUP BY model, {column} HAVING COUNT(*) FILTER (WHERE label = 1) > 0"""


@query("recall_by_technique", f"SELECT * REPLACE (ROUND(recall, 9) AS recall) FROM ({_recall_sql('attack_technique')})")
def recall_by_technique(spark, sf_dir):
    return _rounded(M.recall_by_technique(_predicted(spark, sf_dir)), "recall")


@query("recall_by_statement_type", f"SELECT * REPLACE (ROUND(recall, 9) AS recall) FROM ({_recall_sql('statement_type')})")
def recall_by_statement_type(spark, sf_dir):
    return _rounded(M.recall_by_statement_type(_predicted(spark, sf_dir)), "recall")


BALANCED = f"""SELECT model, AVG(r) AS balanced_accuracy FROM (
SELECT model, COUNT(*) FILTER (WHERE pred = 0) / COUNT(*) AS r FROM ({PREDICTED}) WHERE label = 0 GROUP BY model
UNION ALL SELECT model, ROUND(recall * 100, 2) / 100 FROM ({_recall_sql('attack_technique')})) GROUP BY model"""


@query("balanced_accuracy_by_technique", f"SELECT model, ROUND(balanced_accuracy, 9) AS balanced_accuracy FROM ({BALANCED})")
def balanced_accuracy_by_technique(spark, sf_dir):
    return _rounded(M.balanced_accuracy_by_technique(_predicted(spark, sf_dir)), "balanced_accuracy")


@query("prevalence", f"SELECT model, ROUND(AVG(label), 9) AS prevalence FROM ({SCORES}) GROUP BY model")
def prevalence(spark, sf_dir):
    return _rounded(M.prevalence(scores(spark, sf_dir)), "prevalence")


@query("class_counts_by_split", f"SELECT split, label, COUNT(*) AS n FROM ({STATEMENTS}) GROUP BY split, label")
def class_counts_by_split(spark, sf_dir):
    return M.class_counts_by_split(statements(spark, sf_dir))


@query(
    "label_agreement",
    f"""WITH r AS (SELECT 'a' AS model, row_id, label FROM ({SCORES}) UNION ALL
SELECT 'b', row_id, CASE WHEN statement_type = 's3' AND attack_technique = 't2' THEN 1 - label ELSE label END FROM ({SCORES}))
SELECT row_id, COUNT(DISTINCT model) AS n_models, MIN(label) AS min_label, MAX(label) AS max_label FROM r GROUP BY row_id
HAVING COUNT(DISTINCT model) <> 2 OR MIN(label) <> MAX(label)""",
)
def label_agreement(spark, sf_dir):
    """A second model is made from the same rows; some of its labels are flipped."""
    flipped = F.when((F.col("statement_type") == "s3") & (F.col("attack_technique") == "t2"), 1 - F.col("label"))
    both = F.array(
        F.struct(F.lit("a").alias("model"), F.col("row_id"), F.col("label")),
        F.struct(F.lit("b").alias("model"), F.col("row_id"), F.coalesce(flipped, F.col("label")).alias("label")),
    )
    return M.label_agreement(scores(spark, sf_dir).select(F.inline(both)))


@query(
    "anomaly_score",
    f"SELECT row_id, model, -score AS score FROM ({SCORES})",
)
def anomaly_score(spark, sf_dir):
    return E.anomaly_score(scores(spark, sf_dir)).select("row_id", "model", "score")


@query(
    "usable_errors",
    f"""SELECT CASE WHEN errno IN ({", ".join(map(str, registry.TRACEABLE_ERRORS))}) THEN 'usable' ELSE 'discard' END AS outcome,
COUNT(*) AS n FROM ({SCORES}) GROUP BY 1""",
)
def usable_errors(spark, sf_dir):
    outcome = TR.classify_error(F.col("errno")).alias("outcome")
    return scores(spark, sf_dir).groupBy(outcome).agg(F.count(F.lit(1)).alias("n"))


_REPORT_RECALLS = ", ".join(
    f"ROUND(MAX(recall) FILTER (WHERE attack_technique = '{t}'), 9) AS recall{t}" for t in ("insider", "t1", "t2", "t3", "t4", "t5", "t6")
)
_REPORT_TYPES = ", ".join(
    f"ROUND(MAX(recall) FILTER (WHERE statement_type = 's{i}'), 9) AS recall_s{i}" for i in range(5)
)


@query(
    "model_report",
    f"""SELECT b.model, ROUND(t.threshold, 9) AS threshold, ROUND(f1, 9) AS f1, ROUND(accuracy, 9) AS accuracy,
ROUND("precision", 9) AS "precision", ROUND(recall, 9) AS recall, ROUND(fpr, 9) AS fpr, ROUND(auprc, 9) AS auprc,
ROUND(auroc, 9) AS auroc, ROUND(1.96 * sqrt(auroc * (1 - auroc) / n), 9) AS auroc_ci,
ROUND(1.96 * sqrt(auprc * (1 - auprc) / n), 9) AS auprc_ci, ROUND(balanced_accuracy, 9) AS balanced_accuracy,
r.* EXCLUDE (model), y.* EXCLUDE (model)
FROM ({BASIC}) b JOIN ({LOOSE}) t ON t.model = b.model JOIN ({AREAS}) a ON a.model = b.model
JOIN (SELECT model, COUNT(*) AS n FROM ({SCORES}) WHERE split = 'test' GROUP BY model) c ON c.model = b.model
JOIN ({BALANCED}) ba ON ba.model = b.model
JOIN (SELECT model, {_REPORT_RECALLS} FROM ({_recall_sql('attack_technique')}) GROUP BY model) r ON r.model = b.model
JOIN (SELECT model, {_REPORT_TYPES} FROM ({_recall_sql('statement_type')}) GROUP BY model) y ON y.model = b.model""",
)
def model_report(spark, sf_dir):
    report = E.model_report(_test(spark, sf_dir), _val(spark, sf_dir), max_rate=0.1)
    wide = E.widen_recalls(
        report, ["insider", *[f"t{i}" for i in range(1, 7)]], [f"s{i}" for i in range(5)]
    )
    return _rounded(wide, *[c for c in wide.columns if c != "model"])


@query(
    "write_results",
    f"""SELECT 'expert' AS trace_type, model, ROUND(accuracy, 9) AS accuracy, ROUND("precision", 9) AS "precision",
ROUND(recall, 9) AS recall, ROUND(f1, 9) AS f1, ROUND(fpr, 9) AS fpr FROM ({BASIC})""",
)
def write_results(spark, sf_dir):
    """Result rows written per trace type and model, read back."""
    path = shared_path(spark, "results")
    rows = M.basic_metrics(_predicted(spark, sf_dir)).withColumn("trace_type", F.lit("expert"))
    sinks.write_results(rows, path)
    return _rounded(spark.read.parquet(path), "accuracy", "precision", "recall", "f1", "fpr")


@query(
    "write_curves",
    f"""SELECT model, COUNT(*) AS n_points, ROUND(MAX(recall), 9) AS max_recall, ROUND(MIN("precision"), 9) AS min_precision FROM (
SELECT model, tp / (tp + fp) AS "precision", tp / p AS recall FROM ({RUNNING})
UNION ALL SELECT DISTINCT model, 1.0::DOUBLE, 0.0::DOUBLE FROM ({COUNTS})) GROUP BY model""",
)
def write_curves(spark, sf_dir):
    """Curve points written per model, read back and counted."""
    path = shared_path(spark, "curves")
    sinks.write_curves(C.pr_curve(_test(spark, sf_dir)), path)
    points = spark.read.parquet(path)
    return points.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.round(F.max("recall"), 9).alias("max_recall"),
        F.round(F.min("precision"), 9).alias("min_precision"),
    )
