"""Writers: result tables, curves, reusable feature tables and models."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_results(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Result or timing rows, one folder per trace type and model."""
    (
        df.repartition("trace_type", "model")
        .write.mode(mode).partitionBy("trace_type", "model").format(fmt)
        .option("header", True).option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False).save(path)
    )


def write_curves(points: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Curve points, one folder per model. Points stay spread over as many files
    as there are partitions, because a curve may have as many points as rows."""
    (
        points.write.mode(mode).partitionBy("model").format(fmt)
        .option("header", True).save(path)
    )


def content_fingerprint(df: DataFrame) -> DataFrame:
    """One row that identifies the content of a table, whatever its row order.

    Three commutative aggregates over a 64-bit row hash: Spark combines them
    inside each partition, so only one small row per task is shuffled.
    """
    # The hash skips nulls, so whether a column is null is hashed with it.
    columns = [part for c in sorted(df.columns) for part in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    row = df.select(F.xxhash64(*columns).alias("h"))
    return row.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("xor_hash"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum_hash"),
    )


def materialize(df: DataFrame, root: str, version: str, mode: str, source: DataFrame | None = None) -> DataFrame:
    """Store a table once per input content, version and mode; reuse it afterwards.

    ``source`` is the input whose content decides (default: the table itself).
    """
    source = df if source is None else source
    print_row = content_fingerprint(source).first()
    # Names and types are part of the key, so no table is read under another's schema.
    schemas = hashlib.sha256("\n".join(d.schema.json() for d in (source, df)).encode()).hexdigest()[:16]
    name = f"{schemas}-{print_row.n_rows}-{print_row.xor_hash & (2**64 - 1):016x}-{print_row.sum_hash}"
    path = f"{root.rstrip('/')}/mode={mode}/version={version}/fingerprint={name}"
    spark = df.sparkSession
    if not _has_marker(spark, path):
        df.write.mode("overwrite").parquet(path + "/data")
        # Written last: a job that dies half-way leaves no marker behind.
        marker = spark.createDataFrame([(print_row.n_rows,)], "n_rows long")
        marker.coalesce(1).write.mode("overwrite").parquet(path + "/marker")
    return spark.read.schema(df.schema).parquet(path + "/data").select(*df.columns)


def _has_marker(spark: SparkSession, path: str) -> bool:
    try:
        return spark.read.schema("n_rows long").parquet(path + "/marker").first() is not None
    except AnalysisException:
        return False


MODEL_SCHEMA = (
    "model_name string, kind string, parameters string, feature_columns array<string>, "
    "scaler array<double>, weights array<double>"
)


def save_model(spark: SparkSession, model: dict, root: str) -> str:
    """Store a fitted model as one Parquet row: weights, scaler, columns, parameters."""
    path = f"{root.rstrip('/')}/{model['model_name']}"
    row = (
        model["model_name"],
        model["kind"],
        json.dumps(model["parameters"], sort_keys=True),
        list(model["feature_columns"]),
        None if model.get("scaler") is None else [float(v) for v in model["scaler"]],
        [float(v) for v in model["weights"]],
    )
    spark.createDataFrame([row], MODEL_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)
    return path


def load_model(spark: SparkSession, model_name: str, roots: list[str]) -> dict:
    """Read a model from the first folder that has it."""
    for root in roots:
        try:
            row = spark.read.schema(MODEL_SCHEMA).parquet(f"{root.rstrip('/')}/{model_name}").first()
        except AnalysisException:
            continue
        if row is not None:
            model = row.asDict()
            model["parameters"] = json.loads(model["parameters"])
            return model
    raise FileNotFoundError(f"Model '{model_name}' not found in any of: {', '.join(roots)}")
