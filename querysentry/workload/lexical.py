"""Queries over statement texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from querysentry import registry
from querysentry.functions.text import core_lexicon
from querysentry.operators import lexical as L
from querysentry.operators.tree import keyword_counts
from querysentry.workload.bindings import TEXTS, texts
from querysentry.workload.registry import query

_SPLIT = "regexp_split_to_array(lower(full_query), '[^\\p{L}\\p{N}_]+')"


def _list(words) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


def _n(pattern: str) -> str:
    return f"CAST(len(regexp_extract_all(full_query, '{pattern}')) AS INT)"


def _occurs(piece: str) -> str:
    return f"(length(full_query) - length(replace(full_query, '{piece}', ''))) // {len(piece)}"


SQL_FEATURES = {
    "len_query": "CAST(length(full_query) AS INT)",
    "has_comment": "CAST(contains(full_query, '--') OR contains(full_query, '#') AS INT)",
    "c_comparison": "CAST(" + " + ".join(_occurs(o) for o in registry.COMPARISON_OPERATORS) + " AS INT)",
    "c_num": _n(r"\p{Nd}"),
    "c_upper": _n(r"\p{Lu}"),
    "c_space": _n(r"[\s\x0B\p{Z}]"),
    "c_special": _n(r"[^\p{L}\p{N}\s\x0B\p{Z}/*+\-\[\](){}]"),
    "c_arith": f"CAST(len(regexp_extract_all(full_query, '[-+/*]')) - ({_occurs('/*')}) - ({_occurs('*/')}) AS INT)",
    "c_square_brackets": _n(r"[\[\]]"),
    "c_round_brackets": _n("[()]"),
    "c_curly_brackets": _n("[{}]"),
    "has_multiline_comment": "CAST(contains(full_query, '/*') OR contains(full_query, '*/') AS INT)",
}
SQL_FEATURES |= {n: f"CAST(list_contains(words, '{w}') AS INT)" for n, w in registry.WORD_FLAGS.items()}
SQL_FEATURES |= {n: f"CAST(list_has_any(words, {_list(ws)}) AS INT)" for n, ws in registry.WORD_SET_FLAGS.items()}
SQL_FEATURES |= {
    n: "CAST(" + " OR ".join(f"contains(lower(full_query), '{p}')" for p in ps) + " AS INT)"
    for n, ps in registry.SUBSTRING_FLAGS.items()
}
# The pieces around every '=': words that end the text before it and begin the text after it.
SQL_FEATURES["has_tautology"] = """CAST(len(list_filter(range(1, len(sides)), lambda i:
    len(list_filter(range(1, least(length(regexp_extract(sides[i], '[\\p{L}\\p{N}_]+$')),
                                   length(regexp_extract(sides[i + 1], '^[\\p{L}\\p{N}_]+'))) + 1),
        lambda k: right(sides[i], k::INT) = left(sides[i + 1], k::INT))) > 0)) > 0 AS INT)"""


def features_sql(names: list[str], source: str = TEXTS) -> str:
    picked = ", ".join(f"{SQL_FEATURES[n]} AS {n}" for n in names)
    return f"""WITH t AS ({source}),
p AS (SELECT row_id, full_query, {_SPLIT} AS words, string_split(full_query, '=') AS sides FROM t)
SELECT row_id, {picked} FROM p"""


def _register(name: str, names: list[str]) -> None:
    @query(name, features_sql(names))
    def run(spark, sf_dir):
        return L.lexical_subset(texts(spark, sf_dir), names, ["row_id"])


_register("lexical_features", registry.LEXICAL)
_register("text_length", ["len_query"])
_register("word_flags", list(registry.WORD_FLAGS))
_register("query_keyword_flag", ["has_query_keywords"])
_register("string_function_flag", ["has_string_functions"])
_register("connection_keyword_flag", ["has_connection_keywords"])
_register("file_keyword_flag", ["has_file_keywords"])
_register("database_keyword_flag", ["has_database_keywords"])
_register("comment_flag", ["has_comment"])
_register("comparison_count", ["c_comparison"])
_register("tautology_flag", ["has_tautology"])
_register(
    "character_counts",
    ["c_num", "c_upper", "c_space", "c_arith", "c_square_brackets", "c_round_brackets", "c_curly_brackets", "c_special"],
)
_register("arithmetic_count", ["c_arith"])
_register("multiline_comment_flag", ["has_multiline_comment"])


@query(
    "escape_counts",
    rf"""WITH t AS (SELECT row_id, CONCAT(full_query, '\x4f\u00e9') AS full_query FROM ({TEXTS}))
SELECT row_id, {_n(r"\\x[0-9a-fA-F]{2}")} AS c_hex, {_n(r"\\u[0-9a-fA-F]{4}")} AS c_unicode FROM t""",
)
def escape_counts(spark, sf_dir):
    escaped = texts(spark, sf_dir).withColumn("full_query", F.concat("full_query", F.lit("\\x4f\\u00e9")))
    return L.escape_counts(escaped).select("row_id", "c_hex", "c_unicode")


# Words one by one, minus one for each NOT phrase (two entries, one hit), plus each
# exclamation mark between word characters. Delimiters are doubled first so that
# neighbouring matches do not share one.
_SINGLE = [w.lower() for w in core_lexicon() if " " not in w and w != "!"]
KEYWORD_SQL = f"""(len(list_filter({_SPLIT}, lambda w: list_contains({_list(_SINGLE)}, w)))
 - len(regexp_extract_all(regexp_replace(CONCAT(' ', lower(full_query), ' '), '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g'),
       '[^\\p{{L}}\\p{{N}}_]not  (between|exists|in|like|regexp)[^\\p{{L}}\\p{{N}}_]'))
 + len(regexp_extract_all(regexp_replace(full_query, '([\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g'),
       '[\\p{{L}}\\p{{N}}_]![\\p{{L}}\\p{{N}}_]')))"""


@query(
    "keyword_count",
    f"WITH t AS ({TEXTS}) SELECT row_id, CAST({KEYWORD_SQL} AS INT) AS c_sqlkywds FROM t",
)
def keyword_count(spark, sf_dir):
    return keyword_counts(texts(spark, sf_dir)).select("row_id", "c_sqlkywds")
