"""Queries for sources, sampling, reports, timing tables, variants and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from querysentry import registry
from querysentry.functions.text import keyword_count
from querysentry.operators import reports as R
from querysentry.operators import scaling as SC
from querysentry.operators import selection as S
from querysentry.operators.lexical import lexical_subset
from querysentry.operators.scoring import score_table
from querysentry.operators.tree import semantic_projection
from querysentry.session import shared_path, task_count
from querysentry.sources import dimensions as D
from querysentry.sources import sinks, tables
from querysentry.streaming import logs, merging
from querysentry.workload import traces  # noqa: F401  (its SQL is reused)
from querysentry.workload.bindings import (
    ITEM,
    SCORES,
    STATEMENTS,
    invocation_columns,
    invocations,
    invocations_sql,
    scores,
    statements,
    table,
    vectors,
)
from querysentry.workload.lexical import features_sql
from querysentry.workload.models import _OUTPUT, fixed_model
from querysentry.workload.registry import ORACLES, query

# --- Sources and sinks ---------------------------------------------------------------------

_FULL = f"""SELECT row_id, full_query, label, user_inputs, NULL::VARCHAR AS attack_stage, NULL::VARCHAR AS tamper_method,
NULL::VARCHAR AS attack_status, statement_type, query_template_id, NULL::VARCHAR AS attack_id, attack_technique, split FROM ({STATEMENTS})"""


@query("read_labelled_queries", _FULL)
def read_labelled_queries(spark, sf_dir):
    """Statements with line breaks and quotes through CSV and back."""
    path = shared_path(spark, "statements")
    rows = statements(spark, sf_dir)
    missing = [F.lit(None).cast("string").alias(c) for c in registry.STATEMENT_COLUMNS if c not in rows.columns]
    rows.select("*", *missing).select("row_id", *registry.STATEMENT_COLUMNS).write.option("header", True).option(
        "escape", '"'
    ).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return tables.read_labelled_queries(spark, path, extra=[T.StructField("row_id", T.LongType())])


@query(
    "read_null_normalised_csv",
    """SELECT c_custkey, NULLIF(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END, '') AS c_name,
CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer""",
)
def read_null_normalised_csv(spark, sf_dir):
    path = shared_path(spark, "customers")
    key = F.col("c_custkey")
    table(spark, sf_dir, "customer").select(
        key,
        F.when(key % 3 == 0, "").otherwise(F.col("c_name")).alias("c_name"),
        F.when(key % 5 == 0, "").otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"),
    ).write.option("header", True).csv(path)
    schema = T.StructType(
        [
            T.StructField("c_custkey", T.LongType()),
            T.StructField("c_name", T.StringType()),
            T.StructField("c_acctbal", T.DoubleType()),
        ]
    )
    return tables.read_null_normalised_csv(spark, path, schema)


@query(
    "keyword_lexicon",
    """WITH w AS (SELECT DISTINCT upper(split_part(p_name, ' ', 1)) AS word FROM part
UNION SELECT DISTINCT upper(p_type) FROM part)
SELECT word, COUNT(*) FILTER (WHERE list_contains(string_split(lower(p_name), ' '), lower(word))) AS n_parts
FROM w, part GROUP BY word""",
)
def keyword_lexicon(spark, sf_dir):
    """A lexicon read from two word files, and how many part names use each word."""
    keywords, functions = shared_path(spark, "keywords"), shared_path(spark, "functions")
    parts = table(spark, sf_dir, "part")
    parts.select(F.concat(F.lit(" "), F.upper(F.split("p_name", " ")[0]))).distinct().write.text(keywords)
    parts.select(F.concat(F.upper("p_type"), F.lit("  "))).distinct().write.text(functions)
    lexicon = D.keyword_lexicon(spark, keywords, functions)
    used = parts.select(F.explode(F.array_distinct(F.split(F.upper("p_name"), " "))).alias("word"))
    counts = used.groupBy("word").agg(F.count(F.lit(1)).alias("n_parts"))
    return lexicon.join(counts, "word", "left").fillna(0, ["n_parts"])


@query(
    "keyword_count_with_lexicon",
    """WITH w AS (SELECT list(DISTINCT lower(split_part(p_name, ' ', 1))) AS ws FROM part)
SELECT p_partkey, CAST(len(list_filter(string_split(lower(p_name), ' '), lambda t: list_contains(ws, t))) AS INT) AS c_sqlkywds
FROM part, w""",
)
def keyword_count_with_lexicon(spark, sf_dir):
    """Counting with a lexicon that was read from a file."""
    keywords = shared_path(spark, "keywords")
    parts = table(spark, sf_dir, "part")
    parts.select(F.split("p_name", " ")[0]).distinct().write.text(keywords)
    words = D.lexicon_words(D.read_word_list(spark, keywords))
    return parts.select("p_partkey", keyword_count(F.col("p_name"), words).alias("c_sqlkywds"))


@query("materialize", STATEMENTS)
def materialize(spark, sf_dir):
    """Stored on the first call, found again by its fingerprint on the second."""
    root = shared_path(spark, "features")
    rows = statements(spark, sf_dir)
    sinks.materialize(rows, root, "1", "expert")
    return sinks.materialize(rows, root, "1", "expert")


# --- Selection and sampling -------------------------------------------------------------------


@query("filter_split", f"SELECT * FROM ({STATEMENTS}) WHERE split = 'train'")
def filter_split(spark, sf_dir):
    return S.filter_split(statements(spark, sf_dir), "train")


@query("known_splits", f"SELECT * FROM ({STATEMENTS}) WHERE split IN ('train', 'test', 'val')")
def known_splits(spark, sf_dir):
    return S.known_splits(statements(spark, sf_dir))


@query("drop_metadata", f"SELECT row_id, length(full_query) AS n_chars FROM ({STATEMENTS})")
def drop_metadata(spark, sf_dir):
    return S.drop_metadata(statements(spark, sf_dir).withColumn("n_chars", F.length("full_query").cast("long")))


_TEMPLATE_IDS = ["src3", "src7", "src9", "src19"]


@query(
    "select_single_input_templates",
    f"SELECT * FROM ({STATEMENTS}) WHERE label = 1 AND query_template_id IN ({', '.join(repr(i) for i in _TEMPLATE_IDS)})",
)
def select_single_input_templates(spark, sf_dir):
    return S.select_single_input_templates(statements(spark, sf_dir), _TEMPLATE_IDS)


def _hash(seed: int) -> str:
    return f"md5(CONCAT('{seed}:', row_id))"


_TENTH = format(int(0.1 * 16**12), "012x")


@query(
    "validation_split",
    f"SELECT row_id, CASE WHEN split = 'train' AND {_hash(2)} < '{_TENTH}' THEN 'val' ELSE split END AS split FROM ({STATEMENTS})",
)
def validation_split(spark, sf_dir):
    return S.validation_split(statements(spark, sf_dir)).select("row_id", "split")


@query(
    "validation_split_exact",
    f"""WITH s AS ({STATEMENTS}), r AS (SELECT row_id, ROW_NUMBER() OVER (ORDER BY substr({_hash(2)}, 1, 13), row_id) AS place,
COUNT(*) OVER () AS n FROM s WHERE split = 'train')
SELECT s.row_id, CASE WHEN place <= ceil(0.1 * n) THEN 'val' ELSE split END AS split FROM s LEFT JOIN r ON r.row_id = s.row_id""",
)
def validation_split_exact(spark, sf_dir):
    return S.validation_split(statements(spark, sf_dir), exact=True).select("row_id", "split")


@query("sample_n", f"SELECT row_id, split FROM ({STATEMENTS}) ORDER BY {_hash(2)}, row_id LIMIT 500")
def sample_n(spark, sf_dir):
    return S.sample_n(statements(spark, sf_dir).select("row_id", "split"), 500)


@query("sample_fraction", f"SELECT row_id, split FROM ({STATEMENTS}) WHERE {_hash(2)} < '{_TENTH}'")
def sample_fraction(spark, sf_dir):
    return S.sample_fraction(statements(spark, sf_dir).select("row_id", "split"), 10)


@query(
    "shuffled_first_n",
    f"""SELECT row_id, CONCAT('{{value}}', substr(full_query, length(regexp_replace(user_inputs, '^\\s+|\\s+$', '', 'g')) + 1)) AS template FROM
(SELECT * FROM ({STATEMENTS}) WHERE instr(full_query, regexp_replace(user_inputs, '^\\s+|\\s+$', '', 'g')) = 1) ORDER BY {_hash(2)}, row_id LIMIT 100""",
)
def shuffled_first_n(spark, sf_dir):
    """The first hundred statements, in random order, that begin with their input."""
    rows = statements(spark, sf_dir)
    template = R.template_of(F.col("full_query"), F.col("user_inputs"))
    derived = F.when(template.startswith(R.PLACEHOLDER), template)
    return S.shuffled_first_n(rows, 100, derived, "template").select("row_id", "template")


# --- Result strings ---------------------------------------------------------------------------

_PIPELINE = "net"
_BASELINES = {"lexical": "lexical and {}-scaler", "embedding": "embedding and {}"}
_NAMES = [
    *[f"{_PIPELINE} and {c}-scaler-{v}" for c in R.CLASSIFIERS for v in [*registry.VOCABULARIES, "ruleid"]],
    *[p.format(c) for p in _BASELINES.values() for c in R.CLASSIFIERS],
    "other",
]
_MAPPED = [
    (f"{_PIPELINE} and {c}-scaler-{v}", c, v.replace("-", ""), False, 0) for c in R.CLASSIFIERS for v in [*registry.VOCABULARIES, "ruleid"]
] + [
    (p.format(c), c, label, True, 2 * i + j + 1)
    for i, (label, p) in enumerate(_BASELINES.items())
    for j, c in enumerate(R.CLASSIFIERS)
]
_CASE = "CASE o_custkey % 19 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES[:-1])) + " ELSE 'other' END"


def _digits(column: str, modulus: int, width: int) -> str:
    return f"LPAD(CAST(CAST(SUM({column}) AS BIGINT) % {modulus} AS VARCHAR), {width}, '0')"


RESULTS = f"""SELECT {_CASE} AS model,
CONCAT(CAST(COUNT(*) % 100 AS VARCHAR), '.', {_digits('o_orderkey', 100, 2)}, '%') AS fone,
CONCAT('0.', {_digits('o_custkey', 10000, 4)}) AS rocauc, CONCAT('0.', {_digits('o_orderkey', 10000, 4)}) AS auprc,
CONCAT('0.0', {_digits('o_custkey', 100, 2)}) AS auroc_ci, CONCAT('0.0', {_digits('o_orderkey', 100, 2)}) AS auprc_ci,
CONCAT(' ', {_digits('o_custkey + o_orderkey', 100, 2)}, '.50% ') AS recallboolean,
CONCAT({_digits('o_orderkey', 90, 2)}, '.25%') AS recallerror,
CONCAT(CAST(COUNT(*) % 3 AS VARCHAR), ' days 0', CAST(CAST(SUM(o_orderkey) AS BIGINT) % 10 AS VARCHAR), ':01:58.5') AS inference_time
FROM orders GROUP BY {_CASE}"""


def _results(spark, sf_dir):
    names = F.lit("other")
    for i, name in enumerate(_NAMES[:-1]):
        names = F.when(F.col("o_custkey") % 19 == i, name).otherwise(names)

    def digits(column, modulus, width):
        return F.lpad((F.sum(column) % modulus).cast("string"), width, "0")

    return table(spark, sf_dir, "orders").groupBy(names.alias("model")).agg(
        F.concat((F.count(F.lit(1)) % 100).cast("string"), F.lit("."), digits("o_orderkey", 100, 2), F.lit("%")).alias("fone"),
        F.concat(F.lit("0."), digits("o_custkey", 10000, 4)).alias("rocauc"),
        F.concat(F.lit("0."), digits("o_orderkey", 10000, 4)).alias("auprc"),
        F.concat(F.lit("0.0"), digits("o_custkey", 100, 2)).alias("auroc_ci"),
        F.concat(F.lit("0.0"), digits("o_orderkey", 100, 2)).alias("auprc_ci"),
        F.concat(F.lit(" "), digits(F.col("o_custkey") + F.col("o_orderkey"), 100, 2), F.lit(".50% ")).alias("recallboolean"),
        F.concat(digits("o_orderkey", 90, 2), F.lit(".25%")).alias("recallerror"),
        F.concat(
            (F.count(F.lit(1)) % 3).cast("string"), F.lit(" days 0"), (F.sum("o_orderkey") % 10).cast("string"), F.lit(":01:58.5")
        ).alias("inference_time"),
    )


_VALUES = ", ".join(f"('{m}', '{c}', '{s}', {str(b).upper()}, {o})" for m, c, s, b, o in _MAPPED)
MAPPED = f"""SELECT r.*, n.classifier, n.semantic_model, n.is_baseline, n.ord FROM ({RESULTS}) r
JOIN (VALUES {_VALUES}) n(model, classifier, semantic_model, is_baseline, ord) ON n.model = trim(r.model)"""
PARSED = f"""SELECT model, CAST(rtrim(trim(fone), '%') AS DOUBLE) AS f1, ROUND(CAST(auprc AS DOUBLE) * 100, 9) AS auprc,
ROUND(CAST(rocauc AS DOUBLE) * 100, 9) AS auroc, ROUND(CAST(auprc_ci AS DOUBLE) * 100, 9) AS auprc_ci,
ROUND(CAST(auroc_ci AS DOUBLE) * 100, 9) AS auroc_ci, CAST(rtrim(trim(recallboolean), '%') AS DOUBLE) AS recallboolean,
CAST(rtrim(trim(recallerror), '%') AS DOUBLE) AS recallerror, 0.0::DOUBLE AS recallunion, 0.0::DOUBLE AS recallstacked,
0.0::DOUBLE AS recalltime, 0.0::DOUBLE AS recallinline, 0.0::DOUBLE AS recallinsider, classifier, semantic_model, is_baseline, ord
FROM ({MAPPED})"""


def _mapped(spark, sf_dir):
    return R.map_models(_results(spark, sf_dir), R.model_names(spark, _PIPELINE, _BASELINES))


def _parsed(spark, sf_dir):
    parsed = R.parsed_results(_mapped(spark, sf_dir))
    return parsed.withColumns({c: F.round(c, 9) for c in ("auprc", "auroc", "auprc_ci", "auroc_ci")})


@query("map_models", MAPPED)
def map_models(spark, sf_dir):
    return _mapped(spark, sf_dir)


@query("parse_results", PARSED)
def parse_results(spark, sf_dir):
    return _parsed(spark, sf_dir)


_CELLS = ", ".join(
    f"MAX({v}) FILTER (WHERE semantic_model = '{m}') AS {m}_{v}" for m in R.SEMANTIC_MODELS for v in ("value", "ci", "is_best")
)


@query(
    "metric_matrix",
    f"""WITH p AS (SELECT * FROM ({PARSED}) WHERE NOT is_baseline),
l AS (SELECT classifier, semantic_model, 'auprc' AS metric, auprc AS value, auprc_ci AS ci FROM p
      UNION ALL SELECT classifier, semantic_model, 'auroc', auroc, auroc_ci FROM p),
b AS (SELECT *, value = MAX(value) OVER (PARTITION BY classifier, metric) AS is_best FROM l)
SELECT classifier, metric, {_CELLS} FROM b GROUP BY classifier, metric""",
)
def metric_matrix(spark, sf_dir):
    return R.metric_matrix(_parsed(spark, sf_dir).filter(~F.col("is_baseline")))


@query("top_k_by_f1", f"SELECT model, f1 FROM ({PARSED}) WHERE NOT is_baseline ORDER BY f1 DESC, model LIMIT 3")
def top_k_by_f1(spark, sf_dir):
    return R.top_k_by_f1(_parsed(spark, sf_dir).filter(~F.col("is_baseline"))).select("model", "f1")


_FLAGS = ", ".join(f"abs({c} - MAX({c}) OVER ()) < 1e-6 AS best_{c}" for c in R.METRIC_COLUMNS)


@query(
    "comparison",
    f"""WITH p AS ({PARSED}), t AS (SELECT *, ROW_NUMBER() OVER (ORDER BY f1 DESC, model) AS place FROM p WHERE NOT is_baseline),
s AS (SELECT * FROM t WHERE place <= 3 UNION ALL SELECT *, ord + 3 FROM p WHERE is_baseline)
SELECT CAST(place AS INT) AS place, model, classifier, semantic_model, {", ".join(R.METRIC_COLUMNS)}, {_FLAGS} FROM s""",
)
def comparison(spark, sf_dir):
    return R.comparison(_parsed(spark, sf_dir))


_SECONDS = """CAST(split_part(inference_time, ' ', 1) AS DOUBLE) * 86400
+ CAST(split_part(split_part(inference_time, ' ', 3), ':', 1) AS DOUBLE) * 3600
+ CAST(split_part(inference_time, ':', 2) AS DOUBLE) * 60 + CAST(split_part(inference_time, ':', 3) AS DOUBLE)"""


@query("parse_duration", f"SELECT model, {_SECONDS} AS seconds FROM ({RESULTS})")
def parse_duration(spark, sf_dir):
    return _results(spark, sf_dir).select("model", R.parse_duration(F.col("inference_time")).alias("seconds"))


@query(
    "quality_vs_latency",
    f"""SELECT model, CAST(rocauc AS DOUBLE) AS rocauc, ROUND(({_SECONDS}) / (SELECT COUNT(*) FROM orders), 9) AS seconds_per_statement
FROM ({RESULTS})""",
)
def quality_vs_latency(spark, sf_dir):
    results = _results(spark, sf_dir)
    n = table(spark, sf_dir, "orders").count()
    joined = R.quality_vs_latency(results.select("model", "rocauc"), results.select("model", "inference_time"), n)
    return joined.withColumn("seconds_per_statement", F.round("seconds_per_statement", 9))


@query(
    "model_family",
    f"""SELECT model, CASE WHEN starts_with(model, 'embedding') THEN 'embedding (with GPU)' WHEN starts_with(model, 'lexical ') THEN 'lexical'
WHEN starts_with(model, 'other') THEN 'other' ELSE CASE split_part(model, 'scaler-', 2) WHEN 'claude' THEN 'Claude' WHEN 'chatgpt' THEN 'ChatGPT'
WHEN 'llama' THEN 'Llama' WHEN 'mistral' THEN 'Mistral' WHEN 'gpt-oss' THEN 'OSS-GPT' WHEN 'ruleid' THEN 'naive' ELSE 'expert' END END AS family
FROM ({RESULTS})""",
)
def model_family(spark, sf_dir):
    prefixes = {"embedding": "embedding (with GPU)", "lexical ": "lexical", "other": "other"}
    return _results(spark, sf_dir).select("model", R.model_family(F.col("model"), prefixes).alias("family"))


# --- Timing tables -----------------------------------------------------------------------------

_TIMINGS = "SELECT l_orderkey, l_linenumber, l_partkey, l_tax AS timen, l_discount AS timec FROM lineitem"
_OVERHEAD = f"SELECT *, timec - timen AS overhead FROM ({_TIMINGS}) WHERE timen <> 0 AND timec <> 0"


def _timings(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_tax").alias("timen"), F.col("l_discount").alias("timec")
    )


@query("overhead", f"SELECT * REPLACE (ROUND(overhead, 9) AS overhead) FROM ({_OVERHEAD})")
def overhead(spark, sf_dir):
    return R.overhead(_timings(spark, sf_dir)).withColumn("overhead", F.round("overhead", 9))


@query(
    "overhead_summary",
    f"""SELECT ROUND(AVG(timen), 9) AS mean_timen, ROUND(AVG(timec), 9) AS mean_timec, ROUND(AVG(overhead), 9) AS mean_overhead,
ROUND(stddev_pop(overhead), 9) AS pstdev_overhead, ROUND(MAX(overhead), 9) AS max_overhead FROM ({_OVERHEAD})""",
)
def overhead_summary(spark, sf_dir):
    summary = R.overhead_summary(R.overhead(_timings(spark, sf_dir)))
    return summary.select(*[F.round(c, 9).alias(c) for c in summary.columns])


@query(
    "t_interval",
    f"""SELECT ROUND(AVG(overhead), 6) AS mean, ROUND(AVG(overhead) - h, 6) AS lower, ROUND(AVG(overhead) + h, 6) AS upper, n FROM ({_OVERHEAD}),
(SELECT COUNT(*) AS n, stddev_samp(overhead) / sqrt(COUNT(*)) * (1.959963984540054 + (1.959963984540054 + pow(1.959963984540054, 3)) / (4 * (COUNT(*) - 1))) AS h
 FROM ({_OVERHEAD})) GROUP BY h, n""",
)
def t_interval(spark, sf_dir):
    interval = R.t_interval(R.overhead(_timings(spark, sf_dir)), "overhead")
    return interval.select(*[F.round(c, 6).alias(c) for c in ("mean", "lower", "upper")], "n")


@query(
    "tail_cutoffs",
    "SELECT q, ROUND(cutoff, 9) AS cutoff FROM ("
    + " UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, quantile_cont(overhead, {q}) AS cutoff FROM ({_OVERHEAD})" for q in (0.99, 0.999, 0.001))
    + ")",
)
def tail_cutoffs(spark, sf_dir):
    cutoffs = R.tail_cutoffs(R.overhead(_timings(spark, sf_dir)), "overhead")
    return cutoffs.withColumn("cutoff", F.round("cutoff", 9))


@query(
    "tail_rows",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
WHERE l_extendedprice > (SELECT quantile_cont(l_extendedprice, 0.999) FROM lineitem)""",
)
def tail_rows(spark, sf_dir):
    return R.tail_rows(
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), "l_extendedprice"
    )


# --- Variants ------------------------------------------------------------------------------------

_TEMPLATES = f"""SELECT row_id, full_query, regexp_replace(user_inputs, '^\\s+|\\s+$', '', 'g') AS payload,
CASE WHEN instr(full_query, regexp_replace(user_inputs, '^\\s+|\\s+$', '', 'g')) > 0 THEN
CONCAT(substr(full_query, 1, instr(full_query, regexp_replace(user_inputs, '^\\s+|\\s+$', '', 'g')) - 1), '{{value}}',
       substr(full_query, instr(full_query, regexp_replace(user_inputs, '^\\s+|\\s+$', '', 'g')) + length(regexp_replace(user_inputs, '^\\s+|\\s+$', '', 'g')))) END AS template FROM ({STATEMENTS})"""


@query("extract_templates", f"SELECT row_id, payload, template FROM ({_TEMPLATES}) WHERE template IS NOT NULL")
def extract_templates(spark, sf_dir):
    return R.extract_templates(statements(spark, sf_dir)).select("row_id", "payload", "template")


_VARIANTS = f"""SELECT row_id, variant, replace(template, '{{value}}', CASE variant WHEN 0 THEN payload WHEN 1 THEN CONCAT('/**/', payload)
ELSE CONCAT(payload, ' OR 1=1 -- ') END) AS full_query FROM ({_TEMPLATES}), (VALUES (0), (1), (2)) v(variant) WHERE template IS NOT NULL"""


def _variants(spark, sf_dir):
    templates = R.extract_templates(statements(spark, sf_dir)).select("row_id", "template", "payload")
    payloads = templates.select(
        "row_id",
        F.posexplode(F.array("payload", F.concat(F.lit("/**/"), "payload"), F.concat("payload", F.lit(" OR 1=1 -- ")))).alias("variant", "payload"),
    )
    return R.render_variants(templates.drop("payload"), payloads, ["row_id"]).select("row_id", "variant", "full_query")


@query("render_variants", _VARIANTS)
def render_variants(spark, sf_dir):
    return _variants(spark, sf_dir)


@query(
    "score_variants",
    f"""WITH v AS ({_VARIANTS}), f AS ({features_sql(['c_special', 'c_num', 'c_comparison'], 'SELECT row_id * 10 + variant AS row_id, full_query FROM v')}),
s AS (SELECT row_id, 'special' AS model, CAST(c_special AS DOUBLE) AS score, 40.0::DOUBLE AS threshold FROM f
      UNION ALL SELECT row_id, 'mixed', CAST(c_num + 5 * c_comparison AS DOUBLE), 6.0::DOUBLE FROM f)
SELECT row_id, model, score, threshold, score < threshold AS status FROM s""",
)
def score_variants(spark, sf_dir):
    """Each variant's features scored by two models and compared with their thresholds."""
    rows = _variants(spark, sf_dir).select((F.col("row_id") * 10 + F.col("variant")).alias("row_id"), "full_query")
    names = ["c_special", "c_num", "c_comparison"]
    vectors_of = lambda df: SC.assemble(lexical_subset(df, names, ["row_id"]), names, ["row_id"])
    special = score_table(rows, vectors_of, lambda x: x[:, 0]).withColumn("model", F.lit("special"))
    mixed = score_table(rows, vectors_of, lambda x: x[:, 1] + 5 * x[:, 2]).withColumn("model", F.lit("mixed"))
    thresholds = spark.createDataFrame([("special", 40.0), ("mixed", 6.0)], "model string, threshold double")
    return R.evaded(special.unionByName(mixed), thresholds)


_RUNS = f"SELECT attack_technique AS fuzzer, statement_type AS template, label = 1 AS status, score AS rounds FROM ({SCORES})"


@query(
    "evasion_summary",
    f"""SELECT fuzzer, COUNT(*) FILTER (WHERE status) AS success_count, ROUND(AVG(rounds) FILTER (WHERE status), 9) AS avg_rounds,
COUNT(*) AS samples_count FROM ({_RUNS}) GROUP BY fuzzer""",
)
def evasion_summary(spark, sf_dir):
    summary = R.evasion_summary(_runs(spark, sf_dir), ["fuzzer"])
    return summary.withColumn("avg_rounds", F.round("avg_rounds", 9))


@query(
    "evasion_summary_by_template",
    f"""SELECT template, fuzzer, COUNT(*) FILTER (WHERE status) AS success_count, ROUND(AVG(rounds), 9) AS avg_rounds,
COUNT(*) AS samples_count FROM ({_RUNS}) GROUP BY template, fuzzer""",
)
def evasion_summary_by_template(spark, sf_dir):
    summary = R.evasion_summary(_runs(spark, sf_dir), ["template", "fuzzer"], successes_only=False)
    return summary.withColumn("avg_rounds", F.round("avg_rounds", 9))


def _runs(spark, sf_dir):
    return scores(spark, sf_dir).select(
        F.col("attack_technique").alias("fuzzer"),
        F.col("statement_type").alias("template"),
        (F.col("label") == 1).alias("status"),
        F.col("score").alias("rounds"),
    )


# --- Streams ----------------------------------------------------------------------------------------


@query("stream_trace_log", invocations_sql())
def stream_trace_log(spark, sf_dir):
    """A folder of log files read as a stream; a second run finds nothing new."""
    source, out, checkpoint = (shared_path(spark, "stream", part) for part in ("log", "out", "checkpoint"))
    log = invocations(spark, sf_dir)
    # As many files as the rows need: one is read, and written, by a task.
    log.repartition(max(8, task_count(log))).write.option("header", True).option("escape", '"').option(
        "ignoreTrailingWhiteSpace", False
    ).csv(source)
    for _ in range(2):
        log = logs.stream_trace_log(spark, source, [T.StructField("stmt_id", T.LongType())], max_files=4)
        logs.run_available(log, out, checkpoint)
    return spark.read.parquet(out)


@query("stream_features", features_sql(registry.LEXICAL, "SELECT doc_id AS row_id, text AS full_query FROM documents"))
def stream_features(spark, sf_dir):
    out, checkpoint = (shared_path(spark, "stream", part) for part in ("out", "checkpoint"))
    schema = table(spark, sf_dir, "documents").schema
    stream = logs.stream_parquet(spark, sf_dir, "documents", schema).select(
        F.col("doc_id").alias("row_id"), F.col("text").alias("full_query")
    ).repartition(spark.sparkContext.defaultParallelism, "row_id")
    logs.run_available(logs.stream_features(stream).drop("full_query"), out, checkpoint)
    return spark.read.parquet(out)


@query(
    "stream_trace_features",
    ORACLES["semantic_projection"],
)
def stream_trace_features(spark, sf_dir):
    """Trace features of arriving log rows: the batch projection on a stream."""
    out, checkpoint = (shared_path(spark, "stream", part) for part in ("out", "checkpoint"))
    stream = logs.stream_parquet(spark, sf_dir, "lineitem", table(spark, sf_dir, "lineitem").schema)
    rows = stream.repartition(spark.sparkContext.defaultParallelism, *ITEM).select(*invocation_columns("expert"))
    featured = logs.stream_features(rows, "expert", lexical=False)
    logs.run_available(semantic_projection(featured, "expert", ["stmt_id", "query_id", "n_nonterminal"]), out, checkpoint)
    return spark.read.parquet(out)


@query(
    "stream_alerts",
    f"""WITH o AS ({_OUTPUT}), e AS (SELECT row_id, unnest(x) - unnest(y) AS d FROM o)
SELECT row_id, ROUND(AVG(d * d), 9) AS score FROM e GROUP BY row_id HAVING AVG(d * d) >= 0.0156""",
)
def stream_alerts(spark, sf_dir):
    out, checkpoint = (shared_path(spark, "stream", part) for part in ("out", "checkpoint"))
    schema = table(spark, sf_dir, "embeddings").schema
    stream = logs.stream_parquet(spark, sf_dir, "embeddings", schema).select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features")
    )
    logs.run_available(logs.stream_alerts(stream, fixed_model(), 0.0156), out, checkpoint)
    return spark.read.parquet(out).select("row_id", F.round("score", 9).alias("score"))


@query(
    "stream_merge_invocations",
    f"""WITH l AS (SELECT user_id AS stmt_id, event_id AS seq, ts, CAST(FLOOR(value) AS BIGINT) AS n_terminal, user_id % 5 AS depth,
 CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS err, CONCAT('1:', 832 + event_id % 1013, '::', upper(event_type), '::|') AS nodes FROM events),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY stmt_id ORDER BY ts, seq) < INTERVAL '1 hour' THEN 0 ELSE 1 END AS fresh FROM l),
w AS (SELECT *, SUM(fresh) OVER (PARTITION BY stmt_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT stmt_id, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS first_at, arg_min(seq, seq) AS query_id, CAST(SUM(n_terminal) AS BIGINT) AS n_terminal,
CAST(SUM(depth) AS BIGINT) AS n_nonterminal, MAX(err) AS is_syntax_error,
CONCAT(string_agg(nodes, '' ORDER BY seq), '||-||', string_agg('1>2: ', '' ORDER BY seq)) AS semantic_tree,
CAST(SUM(depth) AS BIGINT) AS depth, COUNT(*) AS n_parser_invoc FROM w GROUP BY stmt_id, run""",
)
def stream_merge_invocations(spark, sf_dir):
    """Statements of the stream, ended by a pause of an hour; the last ones are flushed."""
    schema = table(spark, sf_dir, "events").schema
    event, user = F.col("event_id"), F.col("user_id")
    stream = logs.stream_parquet(spark, sf_dir, "events", schema).select(
        user.alias("stmt_id"),
        event.alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        event.alias("query_id"),
        F.floor("value").alias("n_terminal"),
        (user % 5).alias("n_nonterminal"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("is_syntax_error"),
        F.concat(
            F.lit("1:"), (832 + event % 1013).cast("string"), F.lit("::"), F.upper("event_type"), F.lit("::|||-||1>2: ")
        ).alias("semantic_tree"),
        (user % 5).alias("depth"),
    )
    merged = merging.stream_merge_invocations(stream, shared_path(spark, "stream", "merge"), flush=True)
    return merged.withColumn("first_at", F.date_format("start", "yyyy-MM-dd HH:mm:ss")).drop("start", "end")
