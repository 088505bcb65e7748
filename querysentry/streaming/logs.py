"""Streams over trace logs and statements.

Files are the source: a checkpoint remembers which were read, so each row is
handled once and nothing has to be truncated. Feature code is shared with the
batch operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querysentry import registry
from querysentry.operators.autoencoder import score_autoencoder
from querysentry.operators.lexical import lexical_features
from querysentry.operators.tree import trace_features
from querysentry.sources.tables import typed_trace_log


def stream_trace_log(
    spark: SparkSession, path: str, extra: list[T.StructField] | None = None, max_files: int | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Trace-log rows of a folder as they arrive. A file whose header names other columns is an error."""
    columns = [*(extra or []), *[T.StructField(c, T.StringType()) for c in registry.LOG_COLUMNS]]
    reader = (
        spark.readStream.schema(T.StructType(columns)).option("header", True)
        .option("quote", '"').option("escape", '"').option("multiLine", multi_line).option("enforceSchema", False)
    )
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return typed_trace_log(reader.csv(path))


def stream_parquet(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """One table in a folder as a stream: a Parquet file, or a folder of them, of the table's name.

    A pattern finds either; a plain path would have to be a folder.
    """
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def stream_features(stream: DataFrame, mode: str | None = None, lexical: bool = True) -> DataFrame:
    """The batch feature columns on a stream: a stateless projection."""
    if mode is not None:
        stream = trace_features(stream, mode)
    return lexical_features(stream) if lexical else stream


def stream_alerts(stream: DataFrame, model: dict, threshold: float) -> DataFrame:
    """Rows of a feature stream whose score reaches the threshold."""
    return score_autoencoder(stream, model).filter(F.col("score") >= threshold)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append everything that has arrived to a Parquet folder, then stop."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
