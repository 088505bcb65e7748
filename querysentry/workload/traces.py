"""Queries over trace logs and parse trees."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from querysentry import registry
from querysentry.operators import selection as S
from querysentry.operators import traces as TR
from querysentry.operators import tree as TREE
from querysentry.plans import features as P
from querysentry.session import shared_path, spread_small_input, task_count
from querysentry.sources import dimensions as D
from querysentry.sources import tables
from querysentry.workload.bindings import (
    ITEM,
    STATEMENT_KEYS,
    invocations,
    invocations_sql,
    items,
    statement_keys,
    table,
    trace_log,
    trace_log_sql,
)
from querysentry.workload.lexical import KEYWORD_SQL, features_sql
from querysentry.workload.registry import query

LOG = registry.LOG_COLUMNS
ROW_KEYS = ["stmt_id", "query_id", "n_nonterminal"]

# --- SQL pieces ------------------------------------------------------------------

_NODES = "list_filter(string_split(split_part(semantic_tree, '||-||', 1), '|'), lambda n: n <> '')"
FIELDS = f"list_filter(list_transform({_NODES}, lambda n: string_split(n, ':')), lambda f: len(f) = 6)"


def _tag_sql(vocabulary: str) -> dict[str, str]:
    columns = {}
    for family, tag in registry.vocabulary_tags(vocabulary):
        place = 5 if family == "object" else 4
        hit = "''" if tag in (registry.ACTION_BLANK, registry.OBJECT_BLANK) else f"'{tag}'"
        columns[tag] = f"CAST(len(list_filter(fields, lambda f: f[{place}] = {hit})) AS BIGINT)"
    return columns


def _node_keywords(keys: str) -> str:
    """Keyword counts of literals, one row per node that has one."""
    counted = KEYWORD_SQL.replace("full_query", "literal")
    return f"""SELECT {keys}, {counted} AS c FROM (SELECT {keys}, unnest(fields)[6] AS literal FROM p) WHERE literal <> ''"""


_STATS = """COALESCE(AVG(c), 0.0) AS avg_c_sqlkywds, CAST(COALESCE(MAX(c), 0) AS INT) AS max_c_sqlkywds,
CAST(COALESCE(MIN(c), 0) AS INT) AS min_c_sqlkywds"""


# --- Trace log and merging ---------------------------------------------------------

_LOG_EXTRA = [T.StructField("stmt_id", T.LongType()), T.StructField("seq", T.IntegerType())]


@query(
    "read_trace_log",
    f"""SELECT stmt_id, seq, CASE WHEN query_id % 11 = 0 THEN NULL ELSE query_id END AS query_id, n_terminal,
n_nonterminal, is_syntax_error,
CASE WHEN query_id % 13 = 0 THEN '||-||' ELSE semantic_tree END AS semantic_tree, depth FROM ({trace_log_sql()})""",
)
def read_trace_log(spark, sf_dir):
    path = shared_path(spark, "trace-log")
    raw = trace_log(spark, sf_dir).select(
        "stmt_id",
        "seq",
        F.when(F.col("query_id") % 11 == 0, "bad").otherwise(F.col("query_id").cast("string")).alias("query_id"),
        "n_terminal",
        "n_nonterminal",
        "is_syntax_error",
        F.when(F.col("query_id") % 13 == 0, "").otherwise(F.col("semantic_tree")).alias("semantic_tree"),
        "depth",
    )
    # Two groups of files with their columns in different orders.
    for half, columns in enumerate((raw.columns, raw.columns[::-1])):
        rows = raw.filter(F.col("stmt_id") % 2 == half).select(*columns)
        rows.write.option("header", True).option("escape", '"').option("ignoreTrailingWhiteSpace", False).csv(f"{path}/half={half}")
    log = tables.read_trace_log(spark, [f"{path}/half=0", f"{path}/half=1"], _LOG_EXTRA, header_from_file=True)
    return log.select(*raw.columns)


MERGED = f"""SELECT stmt_id, arg_min(query_id, seq) AS query_id, CAST(SUM(n_terminal) AS BIGINT) AS n_terminal,
CAST(SUM(n_nonterminal) AS BIGINT) AS n_nonterminal, MAX(is_syntax_error) AS is_syntax_error,
CONCAT(string_agg(split_part(semantic_tree, '||-||', 1), '' ORDER BY seq), '||-||',
       string_agg(split_part(semantic_tree, '||-||', 2), '' ORDER BY seq)) AS semantic_tree,
CAST(SUM(depth) AS BIGINT) AS depth, COUNT(*) AS n_parser_invoc
FROM ({trace_log_sql()}) GROUP BY stmt_id"""


@query("merge_traces", MERGED)
def merge_traces(spark, sf_dir):
    return TR.merge_traces(trace_log(spark, sf_dir))


@query("merge_trace_counters", f"SELECT * EXCLUDE (semantic_tree) FROM ({MERGED})")
def merge_trace_counters(spark, sf_dir):
    return TR.merge_trace_counters(trace_log(spark, sf_dir))


FILLED = f"""SELECT k.stmt_id, k.split, t.query_id, COALESCE(t.n_terminal, 0) AS n_terminal,
COALESCE(t.n_nonterminal, 0) AS n_nonterminal, COALESCE(t.is_syntax_error, 0) AS is_syntax_error,
COALESCE(t.semantic_tree, '||-||') AS semantic_tree, COALESCE(t.depth, 0) AS depth,
COALESCE(t.n_parser_invoc, 0) AS n_parser_invoc
FROM ({STATEMENT_KEYS}) k LEFT JOIN ({MERGED}) t ON t.stmt_id = k.stmt_id"""


@query("fill_failed_traces", FILLED)
def fill_failed_traces(spark, sf_dir):
    return TR.fill_failed_traces(statement_keys(spark, sf_dir), TR.merge_traces(trace_log(spark, sf_dir)), "stmt_id")


@query("failed_trace_count", f"SELECT COUNT(*) FILTER (WHERE n_parser_invoc = 0) AS n_failed FROM ({FILLED})")
def failed_trace_count(spark, sf_dir):
    counters = TR.merge_trace_counters(trace_log(spark, sf_dir))
    return TR.failed_trace_count(TR.fill_failed_traces(statement_keys(spark, sf_dir), counters, "stmt_id"))


@query("align_traces", f"SELECT k.split, t.* FROM ({STATEMENT_KEYS}) k JOIN ({MERGED}) t ON t.stmt_id = k.stmt_id")
def align_traces(spark, sf_dir):
    return TR.align(statement_keys(spark, sf_dir), TR.merge_traces(trace_log(spark, sf_dir)), "stmt_id")


@query(
    "one_to_one_violations",
    f"""SELECT COALESCE(k.stmt_id, t.stmt_id) AS stmt_id, k.split, COALESCE(k.n, 0) AS n_queries, COALESCE(t.n, 0) AS n_traces
FROM (SELECT stmt_id, split, COUNT(*) AS n FROM ({STATEMENT_KEYS}) GROUP BY ALL) k
FULL JOIN (SELECT l_orderkey AS stmt_id, COUNT(*) AS n FROM lineitem GROUP BY ALL) t ON t.stmt_id = k.stmt_id
WHERE COALESCE(k.n, 0) <> 1 OR COALESCE(t.n, 0) <> 1""",
)
def one_to_one_violations(spark, sf_dir):
    return TR.one_to_one_violations(statement_keys(spark, sf_dir), invocations(spark, sf_dir), "stmt_id")


@query(
    "pending_statements",
    f"SELECT * FROM ({STATEMENT_KEYS}) k WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = k.stmt_id)",
)
def pending_statements(spark, sf_dir):
    """Resume: statements a stored partial result does not hold yet."""
    path = shared_path(spark, "partial")
    TR.merge_trace_counters(trace_log(spark, sf_dir)).write.parquet(path)
    return TR.pending(statement_keys(spark, sf_dir), spark.read.parquet(path), "stmt_id")


@query("traces_per_split", f"SELECT * FROM ({FILLED}) WHERE split IN ('train', 'test', 'val')")
def traces_per_split(spark, sf_dir):
    return TR.traces_per_split(statement_keys(spark, sf_dir), TR.merge_traces(trace_log(spark, sf_dir)), "stmt_id")


# --- Nodes and tags -------------------------------------------------------------------


@query(
    "explode_nodes",
    f"""WITH p AS (SELECT *, {FIELDS} AS fields FROM ({invocations_sql()})),
n AS (SELECT stmt_id, query_id, n_nonterminal, unnest(fields) AS f, CAST(generate_subscripts(fields, 1) - 1 AS INT) AS pos FROM p)
SELECT stmt_id, query_id, n_nonterminal, pos, f[1] AS "order", f[2] AS kind, f[3] AS id, f[4] AS tag1, f[5] AS tag2,
f[6] AS literal FROM n""",
)
def explode_nodes(spark, sf_dir):
    return TREE.explode_nodes(invocations(spark, sf_dir), ROW_KEYS)


@query(
    "malformed_nodes",
    f"""SELECT * FROM (SELECT stmt_id, query_id, n_nonterminal, unnest({_NODES}) AS node FROM ({invocations_sql()}))
WHERE len(string_split(node, ':')) <> 6""",
)
def malformed_nodes(spark, sf_dir):
    return TREE.malformed_nodes(invocations(spark, sf_dir), ROW_KEYS)


def _register_tag_counts(vocabulary: str) -> None:
    columns = ", ".join(f'{sql} AS "{tag}"' for tag, sql in _tag_sql(vocabulary).items())

    @query(
        f"tag_counts_{vocabulary}",
        f"""WITH p AS (SELECT *, {FIELDS} AS fields FROM ({invocations_sql(vocabulary)}))
SELECT stmt_id, query_id, n_nonterminal, {columns} FROM p""",
    )
    def run(spark, sf_dir):
        return TREE.tag_counts(invocations(spark, sf_dir, vocabulary), vocabulary, ROW_KEYS)


for _vocabulary in registry.VOCABULARIES:
    _register_tag_counts(_vocabulary)


@query(
    "tag_vocabulary",
    "WITH v AS ("
    + " UNION ALL ".join(
        f"SELECT 'expert' AS vocab, '{family}' AS family, '{tag}' AS tag, {i} AS ord"
        for i, (family, tag) in enumerate(registry.vocabulary_tags("expert"))
    )
    + f"""), p AS (SELECT {FIELDS} AS fields FROM ({invocations_sql()})),
n AS (SELECT unnest(fields) AS f FROM p),
c AS (SELECT 'action' AS family, CASE WHEN f[4] = '' THEN 'A_NONE' ELSE f[4] END AS tag, COUNT(*) AS n FROM n GROUP BY ALL
      UNION ALL SELECT 'object', CASE WHEN f[5] = '' THEN 'O_NONE' ELSE f[5] END, COUNT(*) FROM n GROUP BY ALL)
SELECT v.vocab, v.family, v.tag, v.ord, COALESCE(c.n, 0) AS n_nodes FROM v LEFT JOIN c ON c.family = v.family AND c.tag = v.tag""",
)
def tag_vocabulary(spark, sf_dir):
    """How often the whole log uses each tag of the vocabulary."""
    used = TREE.explode_nodes(invocations(spark, sf_dir), ["stmt_id"]).select(
        F.inline(
            F.array(
                F.struct(F.lit("action").alias("family"), F.coalesce(F.nullif("tag1", F.lit("")), F.lit("A_NONE")).alias("tag")),
                F.struct(F.lit("object").alias("family"), F.coalesce(F.nullif("tag2", F.lit("")), F.lit("O_NONE")).alias("tag")),
            )
        )
    )
    counts = used.groupBy("family", "tag").agg(F.count(F.lit(1)).alias("n_nodes"))
    return D.tag_vocabulary(spark, "expert").join(counts, ["family", "tag"], "left").fillna(0, ["n_nodes"])


@query(
    "unknown_tags",
    f"""WITH p AS (SELECT stmt_id, query_id, n_nonterminal, {FIELDS} AS fields FROM ({invocations_sql('claude')})),
n AS (SELECT stmt_id, query_id, n_nonterminal, unnest(fields)[4] AS tag, CAST(generate_subscripts(fields, 1) - 1 AS INT) AS pos FROM p)
SELECT stmt_id, query_id, n_nonterminal, pos, 'tag' AS family, tag FROM n
WHERE tag <> '' AND tag NOT IN ({", ".join("'" + t + "'" for t in registry.TAG_VOCABULARIES["chatgpt"])})""",
)
def unknown_tags(spark, sf_dir):
    """A log tagged with one vocabulary, checked against another."""
    return TREE.unknown_tags(invocations(spark, sf_dir, "claude"), "chatgpt", ROW_KEYS)


@query(
    "literal_keyword_stats",
    f"""WITH p AS (SELECT stmt_id, {FIELDS} AS fields FROM ({MERGED})),
k AS ({_node_keywords("stmt_id")})
SELECT p.stmt_id, {_STATS} FROM p LEFT JOIN k ON k.stmt_id = p.stmt_id GROUP BY p.stmt_id""",
)
def literal_keyword_stats(spark, sf_dir):
    return TREE.literal_keyword_stats(TR.merge_traces(trace_log(spark, sf_dir)), ["stmt_id"])


@query(
    "symbkinds",
    f"""WITH p AS (SELECT stmt_id, {FIELDS} AS fields FROM ({MERGED}))
SELECT stmt_id, array_to_string(list_transform(fields, lambda f: f[2]), ',') AS symbkinds FROM p""",
)
def symbkinds(spark, sf_dir):
    kinds = TREE.symbkinds(TR.merge_traces(trace_log(spark, sf_dir)), ["stmt_id"])
    return kinds.select("stmt_id", F.array_join(F.col("symbkinds").cast("array<string>"), ",").alias("symbkinds"))


_KINDS = f"""WITH p AS (SELECT stmt_id, {FIELDS} AS fields FROM ({MERGED})),
n AS (SELECT stmt_id, CAST(unnest(fields)[2] AS INT) AS kind FROM p)
SELECT stmt_id, kind, COUNT(*) AS n FROM n WHERE kind BETWEEN 832 AND 1844 GROUP BY ALL"""


@query("vectorize_symbkinds", f"SELECT stmt_id, kind, CAST(n AS INT) AS n FROM ({_KINDS})")
def vectorize_symbkinds(spark, sf_dir):
    """The sparse row-wise counts, shown as rows."""
    kinds = TREE.symbkinds(TR.merge_traces(trace_log(spark, sf_dir)), ["stmt_id"])
    pairs = TREE.vectorize_symbkinds(kinds).select("stmt_id", F.explode_outer("kind_counts").alias("kind", "n"))
    return pairs.filter(F.col("kind").isNotNull())


@query("statement_kind_counts", _KINDS)
def statement_kind_counts(spark, sf_dir):
    return TREE.statement_kind_counts(invocations(spark, sf_dir))


@query(
    "kind_columns",
    f"""WITH k AS ({_KINDS}), s AS (SELECT DISTINCT l_orderkey AS stmt_id FROM lineitem)
SELECT s.stmt_id, """
    + ", ".join(f"CAST(COALESCE(SUM(n) FILTER (WHERE kind = {k}), 0) AS INT) AS kind_{k}" for k in range(registry.MIN_RULE_KIND, registry.MAX_RULE_KIND + 1))
    + " FROM s LEFT JOIN k ON k.stmt_id = s.stmt_id GROUP BY s.stmt_id",
)
def kind_columns(spark, sf_dir):
    """Wide form, on request, of all rules."""
    kinds = TREE.vectorize_symbkinds(TREE.symbkinds(TR.merge_traces(trace_log(spark, sf_dir)), ["stmt_id"]))
    return TREE.widen_kinds(kinds, range(registry.MIN_RULE_KIND, registry.MAX_RULE_KIND + 1)).drop("symbkinds", "kind_counts")


# --- Feature tables -----------------------------------------------------------------------


def _features_sql(vocabulary: str) -> str:
    tags = ", ".join(f'{sql} AS "{tag}"' for tag, sql in _tag_sql(vocabulary).items())
    return f"""WITH p AS (SELECT *, {FIELDS} AS fields FROM ({_merged(vocabulary)})),
k AS ({_node_keywords("stmt_id")}),
st AS (SELECT stmt_id, {_STATS} FROM k GROUP BY stmt_id)
SELECT p.stmt_id, n_terminal, n_nonterminal, is_syntax_error, depth, n_parser_invoc, {tags},
COALESCE(avg_c_sqlkywds, 0.0) AS avg_c_sqlkywds, COALESCE(max_c_sqlkywds, 0) AS max_c_sqlkywds,
COALESCE(min_c_sqlkywds, 0) AS min_c_sqlkywds FROM p LEFT JOIN st ON st.stmt_id = p.stmt_id"""


def _merged(vocabulary: str) -> str:
    return MERGED.replace(trace_log_sql(), trace_log_sql(vocabulary))


@query("statement_features", _features_sql("expert"))
def statement_features(spark, sf_dir):
    """Features per statement without joining tree texts: one aggregation."""
    return TREE.statement_features(invocations(spark, sf_dir), "expert")


@query("trace_features", _features_sql("expert"))
def trace_features(spark, sf_dir):
    featured = TREE.trace_features(TR.merge_traces(trace_log(spark, sf_dir)), "expert")
    return featured.drop("query_id", "semantic_tree", "symbkinds")


def _register_vocabulary(vocabulary: str) -> None:
    @query(f"trace_features_{vocabulary}", _features_sql(vocabulary))
    def trace_features_of(spark, sf_dir):
        featured = TREE.trace_features(TR.merge_traces(trace_log(spark, sf_dir, vocabulary)), vocabulary)
        return featured.drop("query_id", "semantic_tree", "symbkinds")


for _vocabulary in registry.VOCABULARIES:
    if _vocabulary != "expert":
        _register_vocabulary(_vocabulary)


@query(
    "trace_features_ruleid",
    f"""WITH f AS ({_features_sql("expert")}), s AS (SELECT stmt_id, COUNT(*) AS kinds, SUM(n) AS nodes FROM ({_KINDS}) GROUP BY stmt_id)
SELECT f.*, CAST(COALESCE(kinds, 0) AS INT) AS n_kinds, CAST(COALESCE(nodes, 0) AS INT) AS n_rule_nodes FROM f LEFT JOIN s ON s.stmt_id = f.stmt_id""",
)
def trace_features_ruleid(spark, sf_dir):
    """The sparse rule counts come along; here their number and sum are shown."""
    featured = TREE.trace_features(TR.merge_traces(trace_log(spark, sf_dir)), "ruleid")
    total = F.aggregate(F.map_values("kind_counts"), F.lit(0), lambda acc, n: acc + n)
    shown = featured.withColumns({"n_kinds": F.size("kind_counts"), "n_rule_nodes": total})
    return shown.drop("query_id", "semantic_tree", "symbkinds", "kind_counts")


def _mode_sql(mode: str) -> str:
    names = ", ".join(f'"{n}"' for n in registry.SYNTACTIC + registry.tag_columns(mode) + registry.KEYWORD_STATS)
    return f"SELECT stmt_id, {names} FROM ({_features_sql(registry.vocabulary_of(mode))})"


@query("select_mode_features", _mode_sql("expert-no-const"))
def select_mode_features(spark, sf_dir):
    merged = TR.merge_traces(trace_log(spark, sf_dir))
    return S.select_mode_features(TREE.trace_features(merged, "expert-no-const"), "expert-no-const", keep=["stmt_id"])


@query(
    "semantic_projection",
    f"""WITH p AS (SELECT stmt_id, query_id, n_nonterminal, {FIELDS} AS fields FROM ({invocations_sql()}))
SELECT stmt_id, query_id, n_nonterminal, {", ".join(f'{q} AS "{t}"' for t, q in _tag_sql("expert").items())} FROM p""",
)
def semantic_projection(spark, sf_dir):
    return TREE.semantic_projection(TREE.trace_features(invocations(spark, sf_dir), "expert"), "expert", ROW_KEYS)


_TEXT_SOURCE = "SELECT stmt_id AS row_id, CONCAT('SELECT a=', semantic_tree) AS full_query FROM m"


@query(
    "hybrid_features",
    f"""WITH m AS ({MERGED}), f AS ({_features_sql("expert")}),
l AS ({features_sql(registry.LEXICAL, _TEXT_SOURCE)})
SELECT f.*, l.* EXCLUDE (row_id) FROM f JOIN l ON l.row_id = f.stmt_id""",
)
def hybrid_features(spark, sf_dir):
    merged = TR.merge_traces(trace_log(spark, sf_dir))
    texts = merged.withColumn("full_query", F.concat(F.lit("SELECT a="), "semantic_tree"))
    return P.hybrid_features(texts, "expert").drop("query_id", "semantic_tree", "symbkinds", "full_query")


# --- Edges ------------------------------------------------------------------------------------

# Four nodes per tree; the second parent comes twice and one child list ends blank.
_EDGE_KEYS = ["stmt_id", "line", "part"]
_EDGE_TREE = """SELECT l_orderkey AS stmt_id, l_linenumber AS line, l_partkey AS part,
CONCAT('1:', l_partkey, '::::|2:', l_suppkey, '::::|3:', l_partkey // 2, '::::|4:', l_suppkey // 2, '::::|',
       '||-||', '1>2:3 2>4 1>', l_linenumber % 4 + 1, ': ') AS semantic_tree, l_suppkey, l_quantity FROM lineitem"""


def _edge_trees(spark, sf_dir):
    return _trees_of(spread_small_input(items(spark, sf_dir), *ITEM))


def _trees_of(rows):
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    return rows.select(
        F.col("l_orderkey").alias("stmt_id"),
        F.col("l_linenumber").alias("line"),
        supplier.alias("supplier"),
        part.alias("part"),
        F.concat(
            F.lit("1:"), part, F.lit("::::|2:"), supplier, F.lit("::::|3:"), F.floor(part / 2),
            F.lit("::::|4:"), F.floor(supplier / 2), F.lit("::::|||-||1>2:3 2>4 1>"),
            F.col("l_linenumber") % 4 + 1, F.lit(": "),
        ).alias("semantic_tree"),
    )


_EDGES = """SELECT stmt_id, line, part, supplier, 1 AS parent, 2 AS child, 0 AS pos FROM e
UNION ALL SELECT stmt_id, line, part, supplier, 1, 3, 1 FROM e
UNION ALL SELECT stmt_id, line, part, supplier, 2, 4, 2 FROM e
UNION ALL SELECT stmt_id, line, part, supplier, 1, line % 4 + 1, 3 FROM e"""


@query(
    "explode_edges",
    f"""WITH e AS ({_EDGE_TREE}), t AS (SELECT stmt_id, line, part,
 unnest(list_filter(string_split(split_part(semantic_tree, '||-||', 2), ' '), lambda s: s <> '')) AS segment FROM e),
x AS (SELECT stmt_id, line, part, split_part(segment, '>', 1) AS parent, unnest(string_split(split_part(segment, '>', 2), ':')) AS child FROM t)
SELECT stmt_id, line, part, CAST(parent AS BIGINT) AS parent, CAST(child AS BIGINT) AS child FROM x WHERE child <> ''""",
)
def explode_edges(spark, sf_dir):
    return TREE.explode_edges(_edge_trees(spark, sf_dir), _EDGE_KEYS).drop("pos")


_TREE_KEYS = [*_EDGE_KEYS, "supplier"]
# Items of one order may repeat; equal trees under one key are one tree.
_TREES = f"SELECT DISTINCT stmt_id, line, part, l_suppkey AS supplier FROM ({_EDGE_TREE})"


def _distinct_trees(spark, sf_dir):
    # A tree's text is made of its keys, so the keys tell trees apart. Dealing them out by all of them
    # brings equal ones together; the number of tasks goes with the rows.
    keys = items(spark, sf_dir).select(*ITEM)
    return _trees_of(keys.repartition(task_count(keys), *ITEM).distinct()).select(*_TREE_KEYS, "semantic_tree")


@query(
    "tree_children",
    f"""WITH e AS ({_TREES})
SELECT stmt_id, line, part, supplier, CAST(1 AS BIGINT) AS parent, CONCAT('2,3,', line % 4 + 1) AS children FROM e
UNION ALL SELECT stmt_id, line, part, supplier, 2, '4' FROM e""",
)
def tree_children(spark, sf_dir):
    lists = TREE.children(_distinct_trees(spark, sf_dir), _TREE_KEYS)
    return lists.withColumn("children", F.array_join(F.col("children").cast("array<string>"), ","))


@query("read_symbol_kinds", "SELECT CAST(p_partkey AS INT) AS kind, CONCAT(replace(p_name, ' ', '_'), '_', p_partkey) AS name, p_partkey % 10 <> 9 AS closed FROM part")
def read_symbol_kinds(spark, sf_dir):
    return D.read_symbol_kinds(spark, _symbol_file(spark, sf_dir))


def _symbol_file(spark, sf_dir) -> str:
    """An enum text made from the part table."""
    path = shared_path(spark, "symbols")
    table(spark, sf_dir, "part").select(
        F.concat(
            F.lit("  YYSYMBOL_"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), "p_partkey", F.lit(" = "),
            "p_partkey", F.when(F.col("p_partkey") % 10 != 9, ",").otherwise(""), F.lit("   /* symbol  */"),
        )
    ).write.text(path)
    return path


_NAME = "CONCAT(replace({p}.p_name, ' ', '_'), '_', {p}.p_partkey)"


@query(
    "named_edges",
    f"""WITH e AS ({_TREES}), x AS ({_EDGES}),
k AS (SELECT *, CASE parent WHEN 1 THEN part WHEN 2 THEN supplier END AS pk,
      CASE child WHEN 1 THEN part WHEN 2 THEN supplier WHEN 3 THEN part // 2 ELSE supplier // 2 END AS ck FROM x)
SELECT stmt_id, line, part, supplier, pos, CAST(parent AS BIGINT) AS parent, CAST(child AS BIGINT) AS child,
{_NAME.format(p='a')} AS parent_name, {_NAME.format(p='b')} AS child_name
FROM k LEFT JOIN part a ON a.p_partkey = k.pk LEFT JOIN part b ON b.p_partkey = k.ck""",
)
def named_edges(spark, sf_dir):
    kinds = D.read_symbol_kinds(spark, _symbol_file(spark, sf_dir))
    return TREE.named_edges(_distinct_trees(spark, sf_dir), kinds, _TREE_KEYS)


@query(
    "dangling_edges",
    f"""WITH e AS ({_TREES})
SELECT stmt_id, line, part, supplier, 4 AS pos, CAST(2 AS BIGINT) AS parent, CAST(9 AS BIGINT) AS child, TRUE AS parent_found, FALSE AS child_found FROM e
UNION ALL SELECT stmt_id, line, part, supplier, 5, 8, 1, FALSE, TRUE FROM e WHERE supplier % 2 = 0""",
)
def dangling_edges(spark, sf_dir):
    """Every tree gets an edge to a node that is not there, every second one an edge from such a node."""
    more = F.when(F.col("supplier") % 2 == 0, " 2>9: 8>1: ").otherwise(" 2>9: ")
    trees = _distinct_trees(spark, sf_dir).withColumn("semantic_tree", F.concat(F.rtrim("semantic_tree"), more))
    return TREE.dangling_edges(trees, _TREE_KEYS)


@query(
    "untagged_rules",
    """SELECT CONCAT('rule_', p_partkey) AS rule FROM part
WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier)""",
)
def untagged_rules(spark, sf_dir):
    rules_path, tags_path = shared_path(spark, "rules"), shared_path(spark, "tags")
    table(spark, sf_dir, "part").select(F.concat(F.lit("  rule_"), "p_partkey", F.lit(" "))).write.text(rules_path)
    table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("rule_"), "s_suppkey").alias("rulename"), F.col("s_name").alias("tag")
    ).write.option("header", True).csv(tags_path)
    return TREE.untagged_rules(D.read_rule_list(spark, rules_path), D.read_tag_list(spark, tags_path)).select("rule")


@query(
    "read_rule_list",
    "SELECT CONCAT('rule_', p_partkey) AS rule FROM part",
)
def read_rule_list(spark, sf_dir):
    path = shared_path(spark, "rules")
    parts = table(spark, sf_dir, "part")
    parts.select(F.concat(F.lit(" rule_"), "p_partkey", F.lit("  \n   "))).write.text(path)
    return D.read_rule_list(spark, path).select("rule")


@query(
    "read_tag_list",
    "SELECT CONCAT('rule_', s_suppkey) AS rulename, s_name AS tag FROM supplier",
)
def read_tag_list(spark, sf_dir):
    path = shared_path(spark, "tags")
    table(spark, sf_dir, "supplier").select(
        F.concat(F.lit(" rule_"), "s_suppkey").alias("rulename"), F.col("s_name").alias("tag")
    ).write.option("header", True).csv(path)
    return D.read_tag_list(spark, path)
