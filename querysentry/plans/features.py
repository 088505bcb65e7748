"""Feature tables: trace features, lexical features, and both together."""

from __future__ import annotations

from pyspark.sql import DataFrame

from querysentry.operators.lexical import lexical_features
from querysentry.operators.selection import select_mode_features
from querysentry.operators.tree import trace_features


def hybrid_features(traces: DataFrame, mode: str, words=None) -> DataFrame:
    """Trace features followed by lexical features of the same row; one scan."""
    return lexical_features(trace_features(traces, mode, words))


def training_table(traces: DataFrame, mode: str, lexical: bool, keep: list[str], words=None) -> DataFrame:
    """Exactly the columns a model of this mode trains on, after ``keep``."""
    features = trace_features(traces, mode, words)
    if lexical:
        features = lexical_features(features)
    return select_mode_features(features, mode, lexical, keep)
