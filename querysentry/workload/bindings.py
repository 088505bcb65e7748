"""The library's input tables, derived from the benchmark tables.

Each binding exists twice: as a DataFrame and as the SQL text of the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from querysentry import registry
from querysentry.session import TEXTS_PER_TASK, spread_small_input


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- Labelled statements: documents and labels ---------------------------------

STATEMENTS = """
SELECT d.doc_id AS row_id, d.text AS full_query, COALESCE(l.toxic, 0) AS label,
       CASE CASE WHEN LENGTH(d.text) > 60 THEN d.doc_id % 8 ELSE 0 END WHEN 5 THEN SUBSTR(d.text, 31, 20) WHEN 6 THEN SUBSTR(d.text, 5, 10) || chr(9) || chr(10)
            WHEN 7 THEN SUBSTR(d.text, 1, 10) || '#absent#' ELSE SUBSTR(d.text, 1, 20) END AS user_inputs, d.source AS query_template_id, d.lang AS statement_type,
       CASE WHEN COALESCE(l.toxic, 0) = 1 THEN CONCAT('t', CAST(d.doc_id % 7 AS VARCHAR)) END AS attack_technique,
       CASE WHEN (d.doc_id * 2654435761 + 7) % 1000 < 600 THEN 'train'
            WHEN (d.doc_id * 2654435761 + 7) % 1000 < 950 THEN 'test' ELSE 'other' END AS split
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    key = F.col("doc_id")
    share = (key % 1_000_000 * 2654435761 + 7) % 1000
    toxic = F.coalesce(F.col("toxic"), F.lit(0))
    long = F.length("text") > 60
    return documents.join(labels, "doc_id", "left").select(
        key.alias("row_id"),
        F.col("text").alias("full_query"),
        toxic.alias("label"),
        # Most inputs begin their statement; others are inside, end in white space or are not there.
        F.when(long & (key % 8 == 5), F.substring("text", 31, 20))
        .when(long & (key % 8 == 6), F.concat(F.substring("text", 5, 10), F.lit("\t\n")))
        .when(long & (key % 8 == 7), F.concat(F.substring("text", 1, 10), F.lit("#absent#")))
        .otherwise(F.substring("text", 1, 20))
        .alias("user_inputs"),
        F.col("source").alias("query_template_id"),
        F.col("lang").alias("statement_type"),
        F.when(toxic == 1, F.concat(F.lit("t"), (key % 7).cast("string"))).alias("attack_technique"),
        F.when(share < 600, "train").when(share < 950, "test").otherwise("other").alias("split"),
    )


# Prose holds few operators. Wrapping every text in an injection pattern exercises them.
WRAPPED = """
SELECT row_id, full_query, label FROM s
UNION ALL
SELECT row_id + 1000000000000,
       CONCAT('SELECT COUNT(a) FROM t WHERE x<=3 AND NOT IN a=''', full_query, ''' OR 1=1 -- /*x*/ [b] {c} a!b'), label
FROM s
"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document text as it is and once more inside an injection pattern."""
    plain = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("full_query"))
    wrapped = F.concat(
        F.lit("SELECT COUNT(a) FROM t WHERE x<=3 AND NOT IN a='"), F.col("full_query"), F.lit("' OR 1=1 -- /*x*/ [b] {c} a!b")
    )
    both = F.array(
        F.struct(F.col("row_id"), F.col("full_query")),
        F.struct((F.col("row_id") + 1_000_000_000_000).alias("row_id"), wrapped.alias("full_query")),
    )
    return spread_small_input(plain, "row_id", rows_per_task=TEXTS_PER_TASK).select(F.inline(both))


TEXTS = """
SELECT doc_id AS row_id, text AS full_query FROM documents
UNION ALL
SELECT doc_id + 1000000000000,
       CONCAT('SELECT COUNT(a) FROM t WHERE x<=3 AND NOT IN a=''', text, ''' OR 1=1 -- /*x*/ [b] {c} a!b')
FROM documents
"""


# --- Scored rows: events ----------------------------------------------------------

SCORES = """
SELECT event_id AS row_id, CONCAT('m', CAST(user_id % 3 AS VARCHAR)) AS model, value AS score,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
       CASE WHEN user_id % 7 = 0 THEN 'insider' ELSE CONCAT('t', CAST(user_id % 7 AS VARCHAR)) END AS attack_technique,
       CONCAT('s', CAST(user_id % 5 AS VARCHAR)) AS statement_type,
       CASE WHEN event_id % 10 < 3 THEN 'val' ELSE 'test' END AS split,
       1000 + event_id % 1000 AS errno
FROM events
"""


def score_columns(events: DataFrame, *extra: str) -> DataFrame:
    user, event = F.col("user_id"), F.col("event_id")
    return events.select(
        event.alias("row_id"),
        F.concat(F.lit("m"), (user % 3).cast("string")).alias("model"),
        F.col("value").alias("score"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"),
        F.when(user % 7 == 0, "insider").otherwise(F.concat(F.lit("t"), (user % 7).cast("string"))).alias("attack_technique"),
        F.concat(F.lit("s"), (user % 5).cast("string")).alias("statement_type"),
        F.when(event % 10 < 3, "val").otherwise("test").alias("split"),
        (1000 + event % 1000).alias("errno"),
        *extra,
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_columns(table(spark, sf_dir, "events"))


# --- Trace log: lineitem -----------------------------------------------------------

# One invocation per line item; statements are orders. Two nodes each: the first
# tagged, the second blank; every 97th part makes a node with a seventh field.
_TREE = """
CONCAT('1:', CAST(832 + l_partkey % 1013 AS VARCHAR), ':', CAST(l_suppkey AS VARCHAR), ':',
       {tags}, ':',
       CASE WHEN l_quantity > 25 THEN CONCAT('select ', l_returnflag, ' from t') ELSE '' END,
       CASE WHEN l_partkey % 97 = 0 THEN ':x' ELSE '' END,
       '|2:', CAST(l_suppkey % 900 AS VARCHAR), ':', CAST(l_partkey AS VARCHAR), ':::|', '||-||', '1>2: ')
"""
_EXPERT_TAGS = """
CASE l_partkey % 6 WHEN 0 THEN 'CREATE' WHEN 1 THEN 'DELETE' WHEN 2 THEN 'MODIFY'
                   WHEN 3 THEN 'EXECUTE' WHEN 4 THEN 'READ' ELSE '' END, ':',
CASE l_suppkey % 5 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'INDEX' WHEN 2 THEN 'VIEW' WHEN 3 THEN 'USER' ELSE '' END
"""


def _vocabulary_tags(vocabulary: str) -> str:
    if vocabulary == "expert":
        return _EXPERT_TAGS
    arms = " ".join(f"WHEN {i} THEN '{tag}'" for i, tag in enumerate(registry.TAG_VOCABULARIES[vocabulary]))
    return f"CASE l_partkey % 21 {arms} ELSE '' END, ':', ''"


_INVOCATION = """
l_orderkey AS stmt_id, {extra} l_partkey AS query_id, CAST(FLOOR(l_quantity) AS BIGINT) AS n_terminal,
CAST(l_linenumber AS BIGINT) AS n_nonterminal, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS is_syntax_error,
{tree} AS semantic_tree, CAST(l_linenumber AS BIGINT) AS depth
"""


def invocations_sql(vocabulary: str = "expert") -> str:
    """Log rows without a sequence number."""
    tree = _TREE.format(tags=_vocabulary_tags(vocabulary))
    return f"SELECT {_INVOCATION.format(extra='', tree=tree)} FROM lineitem"


def trace_log_sql(vocabulary: str = "expert") -> str:
    """Log rows, numbered within their statement."""
    tree = _TREE.format(tags=_vocabulary_tags(vocabulary))
    return f"""
SELECT {_INVOCATION.format(extra='CAST(seq AS INT) AS seq,', tree=tree)}
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey
                ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq FROM lineitem)
"""


def _tree_column(vocabulary: str):
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")

    def text(column):
        return column.cast("string")

    if vocabulary == "expert":
        first = F.element_at(F.array(*[F.lit(a) for a in [*("CREATE", "DELETE", "MODIFY", "EXECUTE", "READ"), ""]]), (part % 6 + 1).cast("int"))
        second = F.element_at(F.array(*[F.lit(o) for o in ("TABLE", "INDEX", "VIEW", "USER", "")]), (supplier % 5 + 1).cast("int"))
    else:
        tags = [*registry.TAG_VOCABULARIES[vocabulary], ""]
        first = F.element_at(F.array(*[F.lit(t) for t in tags]), (part % 21 + 1).cast("int"))
        second = F.lit("")
    literal = F.when(F.col("l_quantity") > 25, F.concat(F.lit("select "), F.col("l_returnflag"), F.lit(" from t"))).otherwise("")
    seventh = F.when(part % 97 == 0, ":x").otherwise("")
    return F.concat(
        F.concat_ws(":", F.lit("1"), text(832 + part % 1013), text(supplier), first, second, literal),
        seventh,
        F.lit("|2:"),
        F.concat_ws(":", text(supplier % 900), text(part), F.lit(""), F.lit(""), F.lit("")),
        F.lit("|||-||1>2: "),
    )


def invocation_columns(vocabulary: str, *extra: str) -> list:
    return [
        F.col("l_orderkey").alias("stmt_id"),
        *extra,
        F.col("l_partkey").alias("query_id"),
        F.floor("l_quantity").alias("n_terminal"),
        F.col("l_linenumber").cast("long").alias("n_nonterminal"),
        F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("is_syntax_error"),
        _tree_column(vocabulary).alias("semantic_tree"),
        F.col("l_linenumber").cast("long").alias("depth"),
    ]


ITEM = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*ITEM, "l_quantity", "l_returnflag", "l_extendedprice")


def invocations(spark: SparkSession, sf_dir: str, vocabulary: str = "expert") -> DataFrame:
    """Log rows without a sequence number: a plain projection of the table."""
    return spread_small_input(items(spark, sf_dir), *ITEM).select(*invocation_columns(vocabulary))


def trace_log(spark: SparkSession, sf_dir: str, vocabulary: str = "expert") -> DataFrame:
    """Log rows, numbered within their statement."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return (
        table(spark, sf_dir, "lineitem").withColumn("seq", F.row_number().over(order))
        .select(*invocation_columns(vocabulary, "seq"))
    )


def statement_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements behind the trace log: orders. Some have no invocation."""
    share = F.col("o_orderkey") % 10
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("stmt_id"),
        F.when(share < 6, "train").when(share < 9, "test").otherwise("other").alias("split"),
    )


STATEMENT_KEYS = """
SELECT o_orderkey AS stmt_id,
       CASE WHEN o_orderkey % 10 < 6 THEN 'train' WHEN o_orderkey % 10 < 9 THEN 'test' ELSE 'other' END AS split
FROM orders
"""


# --- Feature vectors: embeddings ----------------------------------------------------


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"), "label"
    )


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same vectors with every fiftieth stretched to eight times its length."""
    outlier = F.col("row_id") % 50 == 0
    return vectors(spark, sf_dir).select(
        "row_id",
        F.when(outlier, F.transform("features", lambda v: v * 8)).otherwise(F.col("features")).alias("features"),
        outlier.cast("int").alias("label"),
    )


# --- Result strings: orders -----------------------------------------------------------
