"""Comparison tables of models, timing summaries and statement variants."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querysentry import registry
from querysentry.functions.text import stripped
from querysentry.operators.quantiles import exact_quantile, exact_quantiles
from querysentry.session import broadcast_if_small, profile_groups

CLASSIFIERS = ["OCSVM", "AE"]
SEMANTIC_MODELS = ["expert", "chatgpt", "claude", "llama", "mistral", "gptoss", "ruleid"]
RECALL_COLUMNS = [
    "recallboolean", "recallerror", "recallunion", "recallstacked", "recalltime", "recallinline", "recallinsider",
]
METRIC_COLUMNS = ["auprc", "auroc", "f1", *RECALL_COLUMNS]


def model_names(spark: SparkSession, pipeline: str, baselines: dict[str, str] | None = None) -> DataFrame:
    """Model name to (classifier, semantic model), built from the naming rule.

    Pipelines are called ``<pipeline> and <classifier>-scaler-<vocabulary>``.
    ``baselines`` gives, by label, the name pattern of each baseline with
    ``{}`` for the classifier; ``ord`` keeps their order in reports.
    """
    vocabularies = [*registry.VOCABULARIES, "ruleid"]
    rows = [
        (f"{pipeline} and {c}-scaler-{v}", c, v.replace("-", ""), False, 0) for c in CLASSIFIERS for v in vocabularies
    ]
    order = 0
    for label, pattern in (baselines or {}).items():
        for classifier in CLASSIFIERS:
            order += 1
            rows.append((pattern.format(classifier), classifier, label, True, order))
    return spark.createDataFrame(
        rows, "model string, classifier string, semantic_model string, is_baseline boolean, ord int"
    )


def map_models(results: DataFrame, names: DataFrame) -> DataFrame:
    """Results with classifier and semantic model; unknown models are dropped."""
    return results.withColumn("model", stripped(F.col("model"))).join(broadcast_if_small(names), "model")


def parse_value(text: Column) -> Column:
    return stripped(text).try_cast("double")


def parse_percent(text: Column) -> Column:
    """``" 12.34% "`` as 12.34; null where it is no number."""
    return F.regexp_replace(stripped(text), "%+$", "").try_cast("double")


def percent_or_zero(df: DataFrame, column: str) -> Column:
    """A percentage column as a number; 0 if the table does not have it."""
    return parse_percent(F.col(column)) if column in df.columns else F.lit(0.0)


def parsed_results(results: DataFrame) -> DataFrame:
    """Result text rows as numbers in per cent; areas are scaled to per cent too."""
    scaled = {"auprc": "auprc", "auroc": "rocauc", "auprc_ci": "auprc_ci", "auroc_ci": "auroc_ci"}
    return results.select(
        "model",
        parse_percent(F.col("fone")).alias("f1"),
        *[(parse_value(F.col(c)) * 100).alias(n) for n, c in scaled.items()],
        *[percent_or_zero(results, c).alias(c) for c in RECALL_COLUMNS],
        *[c for c in ("classifier", "semantic_model", "is_baseline", "ord") if c in results.columns],
    )


def metric_matrix(results: DataFrame) -> DataFrame:
    """Classifier and metric rows, one column of values per semantic model.

    ``results`` are parsed and mapped. Each cell has ``value``, ``ci`` and
    ``is_best``; all models that share the row's maximum are flagged.
    """
    long = results.select(
        "classifier",
        "semantic_model",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.col(f"{m}_ci").alias("ci"))
                    for m in ("auprc", "auroc")
                ]
            )
        ),
    )
    # One row per model and metric: fixed by the naming rule, not by the data.
    best = F.max("value").over(W.partitionBy("classifier", "metric"))
    flagged = long.withColumn("is_best", F.col("value") == best)
    return flagged.groupBy("classifier", "metric").pivot("semantic_model", SEMANTIC_MODELS).agg(
        F.max("value").alias("value"), F.max("ci").alias("ci"), F.max("is_best").alias("is_best")
    )


def top_k_by_f1(results: DataFrame, k: int = 3) -> DataFrame:
    """The best ``k`` pipelines by F1; equal ones in name order."""
    return results.orderBy(F.desc("f1"), "model").limit(k)


def comparison(results: DataFrame, k: int = 3, tolerance: float = 1e-6) -> DataFrame:
    """The best ``k`` pipelines, then the baselines in their fixed order.

    ``best_<metric>`` flags every value within ``tolerance`` of its column's maximum.
    """
    top = top_k_by_f1(results.filter(~F.col("is_baseline")), k)
    ranked = top.withColumn("place", F.row_number().over(W.orderBy(F.desc("f1"), "model")))  # k rows
    baselines = results.filter("is_baseline").withColumn("place", F.col("ord") + k)
    shown = ranked.unionByName(baselines)
    best = shown.agg(*[F.max(c).alias(f"_max_{c}") for c in METRIC_COLUMNS])  # one row
    flags = [(F.abs(F.col(c) - F.col(f"_max_{c}")) < tolerance).alias(f"best_{c}") for c in METRIC_COLUMNS]
    joined = shown.withColumn("_one", F.lit(1)).join(F.broadcast(best.withColumn("_one", F.lit(1))), "_one")
    return joined.select("place", "model", "classifier", "semantic_model", *METRIC_COLUMNS, *flags)


_DURATION = r"^(-?\d+) days? (\d+):(\d+):(\d+(?:\.\d+)?)$"


def parse_duration(text: Column) -> Column:
    """``D days HH:MM:SS.f`` as seconds; null for anything else."""
    day, hour, minute, second = (F.regexp_extract(text, _DURATION, i).try_cast("double") for i in range(1, 5))
    return day * 86400 + hour * 3600 + minute * 60 + second


def quality_vs_latency(results: DataFrame, timings: DataFrame, n: Column | int) -> DataFrame:
    """Quality next to seconds per statement. ``n`` statements were scored."""
    count = n if isinstance(n, Column) else F.lit(n)
    seconds = timings.select("model", (parse_duration(F.col("inference_time")) / count).alias("seconds_per_statement"))
    return results.withColumn("rocauc", parse_value(F.col("rocauc"))).join(seconds, "model")


def model_family(name: Column, prefixes: dict[str, str] | None = None) -> Column:
    """Display family of a model name; an unknown name is an error.

    ``prefixes`` maps name beginnings of baselines to their family. Other names
    are told apart by what follows ``scaler-``.
    """
    families = {
        "claude": "Claude", "chatgpt": "ChatGPT", "llama": "Llama", "mistral": "Mistral", "gpt-oss": "OSS-GPT",
        "ruleid": "naive", "expert": "expert",
    }
    suffix = F.get(F.split(name, "scaler-"), F.lit(1))
    family = F.lit(None).cast("string")
    for tag, label in families.items():
        family = F.when(suffix == tag, label).otherwise(family)
    for prefix, label in reversed((prefixes or {}).items()):
        family = F.when(name.startswith(prefix), label).otherwise(family)
    return F.when(family.isNull(), F.raise_error(F.concat(F.lit("Unknown model type: "), name))).otherwise(family)


# --- Timing tables: statement, plain time, instrumented time ------------------------


def overhead(timings: DataFrame) -> DataFrame:
    """Extra time of the instrumented run, where both times exist and are not zero."""
    usable = (F.col("timen") != 0) & (F.col("timec") != 0)
    return timings.filter(usable).withColumn("overhead", F.col("timec") - F.col("timen"))


def overhead_summary(overheads: DataFrame) -> DataFrame:
    return overheads.agg(
        F.avg("timen").alias("mean_timen"),
        F.avg("timec").alias("mean_timec"),
        F.avg("overhead").alias("mean_overhead"),
        F.stddev_pop("overhead").alias("pstdev_overhead"),
        F.max("overhead").alias("max_overhead"),
    )


@functools.cache
def t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t distribution.

    The distribution function comes from its density by Simpson's rule on the
    substituted half line, the quantile by bisection. Plain numbers, once per call.
    """
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_quantile(1 - p, df)
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)

    def upper_half(t: float) -> float:
        # With x = sqrt(df) * tan(a) the density becomes cos(a)^(df-1).
        end, steps = math.atan(t / math.sqrt(df)), 20_000
        h = end / steps
        total = 1 + math.cos(end) ** (df - 1)
        for i in range(1, steps):
            total += (4 if i % 2 else 2) * math.cos(i * h) ** (df - 1)
        return scale * total * h / 3

    low, high = 0.0, 1.0
    while upper_half(high) < p - 0.5:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if upper_half(middle) < p - 0.5 else (low, middle)
    return (low + high) / 2


def t_interval(df: DataFrame, column: str, level: float = 0.95) -> DataFrame:
    """Confidence interval of a mean: one row ``mean, lower, upper, n``."""
    row = df.agg(F.count(column).alias("n")).first()
    t = t_quantile(0.5 + level / 2, row.n - 1)
    half = F.stddev_samp(column) / F.sqrt(F.count(column)) * t
    return df.agg(
        F.avg(column).alias("mean"), (F.avg(column) - half).alias("lower"), (F.avg(column) + half).alias("upper"),
        F.count(column).alias("n"),
    )


def tail_cutoffs(df: DataFrame, column: str, qs: list[float] | None = None) -> DataFrame:
    """Cut-offs of the slowest and fastest shares."""
    return exact_quantiles(df, column, qs or [0.99, 0.999, 0.001]).select("q", F.col("quantile").alias("cutoff"))


def tail_rows(df: DataFrame, column: str, q: float = 0.999) -> DataFrame:
    """Rows strictly above a quantile. The cut-off is one number, used as a literal."""
    cutoff = exact_quantile(df, column, q).first()
    return df.filter(F.col(column) > F.lit(cutoff.quantile)) if cutoff else df.limit(0)


# --- Statement variants -----------------------------------------------------------------

PLACEHOLDER = "{value}"


def template_of(full_query: Column, user_input: Column) -> Column:
    """The statement with the first occurrence of the trimmed input made a placeholder.

    Null if the statement does not hold the input.
    """
    value = stripped(user_input)
    at = F.instr(full_query, value)
    rest = F.substring(full_query, at + F.length(value), F.length(full_query))
    return F.when(at > 0, F.concat(F.substring(full_query, F.lit(1), at - 1), F.lit(PLACEHOLDER), rest))


def extract_templates(df: DataFrame) -> DataFrame:
    """Template and payload of every statement that holds its input."""
    return df.select(
        "*",
        template_of(F.col("full_query"), F.col("user_inputs")).alias("template"),
        stripped(F.col("user_inputs")).alias("payload"),
    ).filter(F.col("template").isNotNull())


def render_variants(templates: DataFrame, payloads: DataFrame, on: list[str]) -> DataFrame:
    """A statement for every template and payload that share ``on``.

    A payload table is a list of variants per template key. Each placeholder is
    replaced by the payload.
    """
    joined = templates.join(payloads, on)
    return joined.withColumn("full_query", F.replace("template", F.lit(PLACEHOLDER), F.col("payload")))


def evaded(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Variants scored below their model's threshold have evaded it."""
    joined = scores.join(profile_groups(scores, ["model"]).hint(thresholds), "model")
    return joined.withColumn("status", F.col("score") < F.col("threshold"))


def evasion_summary(runs: DataFrame, by: list[str], successes_only: bool = True) -> DataFrame:
    """Evasions, mean rounds and number of samples per group.

    Rounds are averaged over the evasions, or over all runs as in the small study.
    """
    rounds = F.when(F.col("status"), F.col("rounds")) if successes_only else F.col("rounds")
    return runs.groupBy(*by).agg(
        F.count_if(F.col("status")).alias("success_count"),
        F.avg(rounds).alias("avg_rounds"),
        F.count(F.lit(1)).alias("samples_count"),
    )
