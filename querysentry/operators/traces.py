"""From parser-trace log rows to one trace per statement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querysentry import registry
from querysentry.functions.tree import has_two_parts, tree_parts

INVOCATIONS_PER_CHUNK = 4_096


def _total(name: str) -> Column:
    """The sum of a counter; missing numbers add nothing."""
    return F.coalesce(F.sum(name), F.lit(0)).alias(name)


def merge_trace_counters(log: DataFrame, key: str = "stmt_id", order: str = "seq") -> DataFrame:
    """The numeric part of a merged trace: sums, flags and the number of invocations.

    Every aggregate combines inside the map tasks, so a statement with any share
    of all invocations costs one small row per task.
    """
    return log.groupBy(key).agg(
        F.min_by("query_id", order).alias("query_id"),
        _total("n_terminal"),
        _total("n_nonterminal"),
        F.max(F.when(F.col("is_syntax_error") == 1, 1).otherwise(0)).alias("is_syntax_error"),
        _total("depth"),
        F.count(F.lit(1)).alias("n_parser_invoc"),
    )


def merge_traces(log: DataFrame, key: str = "stmt_id", order: str = "seq") -> DataFrame:
    """One row per statement from one row per parser invocation.

    Counters are summed, node texts and edge texts are joined in invocation
    order around one separator. Trees without exactly two parts are left out of
    the text but counted; a statement with one invocation keeps its tree as it is.

    The texts are joined in two steps, first per run of invocations: a statement
    with very many invocations is sorted and joined by many tasks, and only the
    finished pieces meet. (The joined tree of a statement is one value and has to
    fit one row; ``operators.tree.statement_features`` does without it.)
    """
    parts = tree_parts(F.col("semantic_tree"))
    usable = F.coalesce(has_two_parts(F.col("semantic_tree")), F.lit(False))
    piece = F.when(usable, F.struct(F.col(order).alias("at"), parts[0].alias("nodes"), parts[1].alias("edges")))

    def joined(pieces: Column, name: str) -> Column:
        return F.array_join(F.transform(F.array_sort(pieces), lambda p: p[name]), "")

    chunks = (
        log.withColumn("_chunk", F.floor(F.col(order) / INVOCATIONS_PER_CHUNK))
        .groupBy(key, "_chunk")
        .agg(
            F.min_by("query_id", order).alias("query_id"),
            F.min(order).alias("_first"),
            _total("n_terminal"),
            _total("n_nonterminal"),
            F.max(F.when(F.col("is_syntax_error") == 1, 1).otherwise(0)).alias("is_syntax_error"),
            _total("depth"),
            F.count(F.lit(1)).alias("n_parser_invoc"),
            # The tree of a single invocation, where its parts don't make it up again.
            F.min(F.when(~usable, F.col("semantic_tree"))).alias("_tree"),
            F.max(usable).alias("_whole"),
            F.collect_list(piece).alias("_pieces"),
        )
        .withColumn(
            "_pieces",
            F.struct(
                F.col("_chunk").alias("at"),
                joined(F.col("_pieces"), "nodes").alias("nodes"),
                joined(F.col("_pieces"), "edges").alias("edges"),
            ),
        )
    )
    return (
        chunks.groupBy(key)
        .agg(
            F.min_by("query_id", "_first").alias("query_id"),
            _total("n_terminal"),
            _total("n_nonterminal"),
            F.max("is_syntax_error").alias("is_syntax_error"),
            _total("depth"),
            F.sum("n_parser_invoc").alias("n_parser_invoc"),
            F.min("_tree").alias("_tree"),
            F.max("_whole").alias("_whole"),
            F.collect_list("_pieces").alias("_pieces"),
        )
        .select(
            key,
            "query_id",
            "n_terminal",
            "n_nonterminal",
            "is_syntax_error",
            F.when((F.col("n_parser_invoc") == 1) & ~F.col("_whole"), F.col("_tree"))
            .otherwise(
                F.concat(
                    joined(F.col("_pieces"), "nodes"),
                    F.lit(registry.TREE_SEPARATOR),
                    joined(F.col("_pieces"), "edges"),
                )
            )
            .alias("semantic_tree"),
            "depth",
            "n_parser_invoc",
        )
    )


_FAILED_VALUES = {
    "n_terminal": 0,
    "n_nonterminal": 0,
    "is_syntax_error": 0,
    "semantic_tree": registry.EMPTY_TREE,
    "depth": 0,
    "n_parser_invoc": 0,
}


def fill_failed_traces(queries: DataFrame, traces: DataFrame, key: str = "row_id") -> DataFrame:
    """Every statement with its trace; one without a trace gets the failed-trace row.

    A failed trace has zero counters, an empty tree, no query id and
    ``n_parser_invoc = 0``, which never happens for a real trace.
    """
    found = traces.withColumn("_found", F.lit(True))
    joined = queries.join(found, key, "left")
    missing = F.col("_found").isNull()
    columns = []
    for name in joined.columns:
        if name == "_found":
            continue
        if name in _FAILED_VALUES and name in traces.columns:
            columns.append(F.when(missing, F.lit(_FAILED_VALUES[name])).otherwise(F.col(name)).alias(name))
        else:
            columns.append(F.col(name))
    return joined.select(*columns)


def classify_error(errno: Column) -> Column:
    """``usable`` if a statement with this error code still left a valid trace."""
    known = errno.isNull() | errno.isin(registry.TRACEABLE_ERRORS)
    return F.when(known, F.lit("usable")).otherwise(F.lit("discard"))


def drop_unusable(log: DataFrame, errno: str = "errno") -> DataFrame:
    """Log rows of statements whose execution left a valid trace."""
    return log.filter(classify_error(F.col(errno)) == "usable")


def align(queries: DataFrame, traces: DataFrame, key: str = "row_id") -> DataFrame:
    """Attach each trace to its own statement, whatever the completion order."""
    return queries.join(traces, key)


def one_to_one_violations(queries: DataFrame, traces: DataFrame, key: str = "row_id", split: str = "split") -> DataFrame:
    """Keys that do not have exactly one statement and one trace, with their split."""
    sides = queries.select(key, split, F.lit(1).alias("q"), F.lit(0).alias("t")).unionByName(
        traces.select(key, F.lit(None).cast("string").alias(split), F.lit(0).alias("q"), F.lit(1).alias("t"))
    )
    return (
        sides.groupBy(key)
        .agg(F.max(split).alias(split), F.sum("q").alias("n_queries"), F.sum("t").alias("n_traces"))
        .filter((F.col("n_queries") != 1) | (F.col("n_traces") != 1))
    )


def assert_one_to_one(queries: DataFrame, traces: DataFrame, key: str = "row_id", split: str = "split") -> None:
    """Raise if any statement lacks its one trace; the message names the split."""
    bad = one_to_one_violations(queries, traces, key, split)
    row = bad.orderBy(key).first()
    if row is not None:
        raise ValueError(
            f"Statement {row[key]} of split {row[split]!r} has {row.n_queries} rows and "
            f"{row.n_traces} traces; every statement must have exactly one of each"
        )


def pending(queries: DataFrame, done: DataFrame, key: str = "row_id") -> DataFrame:
    """Statements not yet in the stored partial result."""
    return queries.join(done.select(key), key, "left_anti")


def failed_trace_count(traces: DataFrame) -> DataFrame:
    """Number of failed traces, as one row."""
    return traces.agg(F.count_if(F.col("n_parser_invoc") == 0).alias("n_failed"))


def traces_per_split(queries: DataFrame, traces: DataFrame, key: str = "row_id") -> DataFrame:
    """Statements of the known splits with their traces; each has exactly one row.

    One join serves all splits; ``filter_split`` then gives the three tables, and
    a table written with ``partitionBy("split")`` prunes them.
    """
    known = queries.filter(F.col("split").isin(registry.SPLITS))
    return fill_failed_traces(known, traces, key)
