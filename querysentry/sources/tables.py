"""Readers for statements, trace logs and delimited tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querysentry import registry

STATEMENT_SCHEMA = T.StructType(
    [
        T.StructField(name, T.IntegerType() if name == "label" else T.StringType())
        for name in registry.STATEMENT_COLUMNS
    ]
)


def with_row_id(df: DataFrame, key: str = "row_id") -> DataFrame:
    """Add a unique 64-bit key without a shuffle.

    The key depends on the file splits only. Write the table once, or name a
    key column of your own, before using it in several queries.
    """
    return df.select(F.monotonically_increasing_id().alias(key), "*")


def read_labelled_queries(
    spark: SparkSession,
    path: str | list[str],
    key: str = "row_id",
    extra: list[T.StructField] | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Labelled SQL statements from CSV, with declared types and a row key.

    ``multi_line`` accepts line breaks inside quoted statements; Spark then reads
    each file in one task, so large inputs should come as many files. ``extra``
    declares further leading columns; one of them may already be the key.
    """
    schema = T.StructType([*(extra or []), *STATEMENT_SCHEMA.fields])
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    return df if key in df.columns else with_row_id(df, key)


_LOG_STRINGS = T.StructType([T.StructField(c, T.StringType()) for c in registry.LOG_COLUMNS])


def typed_trace_log(raw: DataFrame) -> DataFrame:
    """Give a trace log read as text its types.

    Numbers that cannot be read become null, an empty tree becomes the empty-tree
    text. Columns the log lacks are left out, unknown ones kept.
    """
    columns = []
    for name in raw.columns:
        if name == "semantic_tree":
            tree = F.coalesce(F.col(name), F.lit(""))
            columns.append(F.when(tree == "", F.lit(registry.EMPTY_TREE)).otherwise(tree).alias(name))
        elif name == "is_syntax_error":
            columns.append(F.col(name).try_cast("double").cast("int").alias(name))
        elif name in registry.LOG_COLUMNS:
            columns.append(F.col(name).try_cast("double").cast("long").alias(name))
        else:
            columns.append(F.col(name))
    return raw.select(*columns)


def read_trace_log(
    spark: SparkSession,
    path: str | list[str],
    extra: list[T.StructField] | None = None,
    header_from_file: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """Parser-trace log rows from CSV.

    By default the standard column order is expected; a file whose header row says
    otherwise is an error, never read into wrong columns. ``header_from_file`` takes
    names and order from each file's own header row instead: files with the same
    header are read together, those without one in the standard order. Empty files
    give an empty table. ``multi_line`` accepts line breaks inside quotes, at the
    price of one task per file.
    """
    standard = T.StructType([*(extra or []), *_LOG_STRINGS.fields])
    reader = spark.read.option("quote", '"').option("escape", '"').option("multiLine", multi_line)
    if not header_from_file:
        return typed_trace_log(reader.schema(standard).option("header", True).option("enforceSchema", False).csv(path))
    types = {f.name: f.dataType for f in standard.fields}
    rows = None
    for header, files in _files_by_header(spark, path).items():
        names = [n.strip().strip('"') for n in header.split(",")] if header else standard.names
        schema = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in names])
        part = reader.schema(schema).option("header", bool(header)).csv(files)
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return typed_trace_log(spark.createDataFrame([], standard) if rows is None else rows)


def _files_by_header(spark: SparkSession, path: str | list[str]) -> dict[str, list[str]]:
    """Header rows (first lines that name the statement's key) and the files that begin with them; "" for files without one.

    Every file is a partition of its own, and its task ends after the first rows it gets.
    """
    lines = spark.read.text(path)

    def first(frames):
        for frame in frames:
            if len(frame):
                if frame["start"].iloc[0] == 0:
                    yield frame.iloc[:1]
                return

    heads = lines.select("value", F.input_file_name().alias("file"), F.input_file_block_start().alias("start"))
    option = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(option)
    # As if opening a file cost a whole partition, so that no partition holds two.
    spark.conf.set(option, spark.conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        # One line per file, as many as Spark's own file listing holds.
        found = heads.mapInPandas(first, "value string, file string, start long").collect()
    finally:
        spark.conf.set(option, before)
    made: dict[str, list[str]] = {}
    for row in found:
        if "query_id" in [field.strip().strip('"') for field in row.value.split(",")]:
            made.setdefault(row.value, []).append(row.file)
    headed = {f for files in made.values() for f in files}
    rest = [f for f in lines.inputFiles() if f not in headed]
    return {**made, **({"": rest} if rest else {})}


def read_null_normalised_csv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Delimited file with a header row; every empty field becomes null, then gets its type."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = (
        spark.read.schema(text).option("header", True).option("quote", '"').option("escape", '"')
        .csv(path)
    )
    return raw.select(
        *[F.nullif(F.col(f.name), F.lit("")).try_cast(f.dataType).alias(f.name) for f in schema.fields]
    )
