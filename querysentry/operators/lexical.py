"""Lexical features of statement texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querysentry import registry
from querysentry.functions import text as X


def lexical_features(df: DataFrame, text: str = "full_query") -> DataFrame:
    """Append the 32 lexical features, in training order. Narrow, no UDF."""
    prepared = df.withColumns({"_lower": F.lower(F.col(text)), "_found": X.found_words(F.col(text))})
    steps = X.character_steps(F.col(text))
    for name, column in [*steps, *X.tautology_steps(F.col(text), F.col("_rest"))]:
        prepared = prepared.withColumn(name, column)
    texts = {name: F.col(name) for name, _ in steps}
    columns = X.lexical_columns(F.col(text), F.col("_lower"), F.col("_found"), texts)
    return prepared.select(*df.columns, *[columns[name].alias(name) for name in registry.LEXICAL])


def lexical_subset(df: DataFrame, names: list[str], keys: list[str], text: str = "full_query") -> DataFrame:
    """Only some lexical features; the others are not computed."""
    return lexical_features(df, text).select(*keys, *names)


def escape_counts(df: DataFrame, text: str = "full_query") -> DataFrame:
    """Counts of hexadecimal and unicode escapes; not part of the feature set."""
    return df.select("*", *X.escape_counts(F.col(text)))
