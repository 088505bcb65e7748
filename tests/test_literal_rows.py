"""Small literal rows with known results."""

import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querysentry import registry
from querysentry.functions import text as X
from querysentry.operators import lexical, selection, traces, tree
from querysentry.operators import metrics as M
from querysentry.operators.scoring import score_table
from querysentry.plans import evaluation
from querysentry.plans.evaluation import anomaly_score
from querysentry.sources import dimensions, sinks, tables

LOG = "stmt_id long, seq int, query_id long, n_terminal long, n_nonterminal long, is_syntax_error int, semantic_tree string, depth long"


def test_log_text(spark, tmp_path):
    path = tmp_path / "a.log"
    header = ",".join(registry.LOG_COLUMNS)
    path.write_text(f"{header}\n42,3,1,0,NODE||-||EDGE,2\n43,0,0,1,,0\n")
    rows = tables.read_trace_log(spark, str(path)).orderBy("query_id").collect()
    assert [r.query_id for r in rows] == [42, 43]
    assert [r.semantic_tree for r in rows] == ["NODE||-||EDGE", "||-||"]
    assert [r.is_syntax_error for r in rows] == [0, 1]
    empty = tmp_path / "b.log"
    empty.write_text(header + "\n")
    assert tables.read_trace_log(spark, str(empty)).count() == 0
    shuffled = tmp_path / "c.log"
    shuffled.write_text("depth,query_id,semantic_tree\n5,7,\nx,8,A||-||B\n")
    rows = tables.read_trace_log(spark, str(shuffled), header_from_file=True).orderBy("query_id").collect()
    assert [(r.depth, r.query_id, r.semantic_tree) for r in rows] == [(5, 7, "||-||"), (None, 8, "A||-||B")]


def test_merge(spark):
    log = spark.createDataFrame(
        [
            (1, 1, 1, 2, 1, 0, "NODEA||-||EDGEA", 3),
            (1, 2, 2, 1, 0, 1, "||-||", 0),
            (2, 1, 9, 1, 1, 0, "odd||-||tree||-||kept", 1),
            (3, 1, 4, 1, 1, 0, "a|||-||1>2: ", 1),
            (3, 2, 5, 1, 1, 0, "no separator", 1),
            (3, 3, 6, 1, 1, 0, None, 1),
        ],
        LOG,
    )
    rows = {r.stmt_id: r for r in traces.merge_traces(log).collect()}
    one = rows[1]
    assert (one.n_terminal, one.n_nonterminal, one.depth, one.n_parser_invoc) == (3, 1, 3, 2)
    assert (one.semantic_tree, one.is_syntax_error, one.query_id) == ("NODEA||-||EDGEA", 1, 1)
    assert rows[2].semantic_tree == "odd||-||tree||-||kept"
    assert (rows[3].semantic_tree, rows[3].n_parser_invoc) == ("a|||-||1>2: ", 3)


def test_merge_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(traces, "INVOCATIONS_PER_CHUNK", 3)
    log = spark.range(20).select(
        F.lit(1).cast("long").alias("stmt_id"), F.col("id").cast("int").alias("seq"), (F.col("id") + 100).alias("query_id"),
        F.lit(1).cast("long").alias("n_terminal"), F.lit(1).cast("long").alias("n_nonterminal"), F.lit(0).alias("is_syntax_error"),
        F.concat(F.lit("n"), "id", F.lit("|||-||"), "id", F.lit(">1: ")).alias("semantic_tree"), F.lit(1).cast("long").alias("depth"),
    ).repartition(7)
    row = traces.merge_traces(log).first()
    assert row.semantic_tree == "".join(f"n{i}|" for i in range(20)) + "||-||" + "".join(f"{i}>1: " for i in range(20))
    assert (row.query_id, row.n_parser_invoc) == (100, 20)


def test_alignment_and_failures(spark):
    keys = [(i * 7919) % 10007 for i in range(16)]
    queries = spark.createDataFrame([(k, f"SELECT {i} FROM t WHERE x = {3 * i}", "train") for i, k in enumerate(keys)], "row_id long, full_query string, split string")
    done = spark.createDataFrame([(k, i, f"tree{i}", 1) for i, k in enumerate(keys) if i % 3][::-1], "row_id long, query_id long, semantic_tree string, n_parser_invoc int")
    rows = {r.row_id: r for r in traces.fill_failed_traces(queries, done).collect()}
    for i, k in enumerate(keys):
        expected = (f"tree{i}", 1) if i % 3 else ("||-||", 0)
        assert (rows[k].semantic_tree, rows[k].n_parser_invoc) == expected
    assert traces.pending(queries, done).count() == 6
    with pytest.raises(ValueError, match="split 'train'"):
        traces.assert_one_to_one(queries, done)
    traces.assert_one_to_one(queries, queries.select("row_id"))


def test_duplicate_statements_get_their_own_key(spark):
    df = tables.with_row_id(spark.createDataFrame([("a",)] * 20, "full_query string"))
    assert df.select("row_id").distinct().count() == 20


def test_split_routing(spark):
    df = spark.createDataFrame([("Q0", "train"), ("Q1", "test"), ("Q2", "val"), ("Q3", "train"), ("Q4", "x")], "q string, split string")
    routed = {s: sorted(r.q for r in selection.filter_split(df, s).collect()) for s in registry.SPLITS}
    assert routed == {"train": ["Q0", "Q3"], "test": ["Q1"], "val": ["Q2"]}
    assert selection.known_splits(df).count() == 4


def test_threshold(spark):
    scores = spark.range(101).select(F.lit("m").alias("model"), F.col("id").cast("double").alias("score"))
    at = M.threshold(scores, 0.01)
    assert at.first().threshold == 99
    assert M.exceedance(scores, at).first().n_above == 1
    assert M.threshold(scores, 0.10).first().threshold < 99


def test_sign(spark):
    df = spark.createDataFrame([(1.0,), (-2.0,), (3.0,)], "score double")
    assert [r.score for r in anomaly_score(df).collect()] == [-1, 2, -3]


def test_model_and_vocabulary_selection():
    models, groups = {"svm": 1, "ae": 2, "ae_ruleid": 3}, {"tags": ["svm", "ae"]}
    assert evaluation.select_models(["tags"], models, groups) == {"svm": 1, "ae": 2}
    assert evaluation.select_models(["all", "x"], models) == models
    with pytest.warns(UserWarning, match="novel"):
        assert evaluation.select_models(["novel", "ae"], models) == {"ae": 2}
    with pytest.warns(UserWarning):
        assert evaluation.select_vocabularies(["a", "b", "claude"]) == ["claude"]
    assert evaluation.select_vocabularies(["all"])[0] == "expert"


def test_batches_equal_whole(spark):
    df = spark.range(10).select(F.col("id").alias("row_id"), F.array(F.col("id").cast("double")).alias("features"))
    seen = [
        sorted((r.row_id, r.score) for r in score_table(df, lambda d: d, lambda x: 10 * x[:, 0], size).collect())
        for size in (3, None)
    ]
    assert seen[0] == seen[1] == [(i, 10.0 * i) for i in range(10)]


def test_edges(spark):
    df = spark.createDataFrame([(1, "||-||1>2:3 2>4 "), (2, "x||-||1>2: 1>3: 7>"), (3, "none")], "row_id int, semantic_tree string")
    rows = tree.explode_edges(df, ["row_id"]).orderBy("row_id", "pos").collect()
    assert [(r.row_id, r.parent, r.child) for r in rows] == [(1, 1, 2), (1, 1, 3), (1, 2, 4), (2, 1, 2), (2, 1, 3)]
    lists = {(r.row_id, r.parent): r.children for r in tree.children(df, ["row_id"]).collect()}
    assert lists == {(1, 1): [2, 3], (1, 2): [4], (2, 1): [2, 3]}


def test_named_edges_both_ways(spark, monkeypatch):
    """Repeated order numbers, missing ends and unnamed kinds; in the row and by join."""
    rows = [(1, "1:10::::|2:11::::|2:12::::|||-||1>2:3 2>1 "), (2, "1:99::::|2:10::::|||-||1>2: ")]
    df = spark.createDataFrame(rows, "row_id int, semantic_tree string")
    kinds = spark.createDataFrame([(10, "ten"), (12, "twelve")], "kind int, name string")
    expected = [(1, 0, 1, 2, "ten", "twelve"), (1, 2, 2, 1, "twelve", "ten"), (2, 0, 1, 2, None, "ten")]
    assert sorted(map(tuple, tree.named_edges(df, kinds, ["row_id"]).collect())) == expected
    monkeypatch.setattr(tree, "IN_ROW_TREE", 30)
    assert sorted(map(tuple, tree.named_edges(df, kinds, ["row_id"]).collect())) == expected
    monkeypatch.setattr(tree, "IN_ROW_TREE", 0)
    assert sorted(map(tuple, tree.named_edges(df, kinds, ["row_id"]).collect())) == expected


def test_symbol_kinds_last_entry(spark, tmp_path):
    path = tmp_path / "enum.txt"
    path.write_text("enum kind\n{\n  YYSYMBOL_YYEMPTY = -2,\n  YYSYMBOL_opt_x = 1843,   /* opt_x  */\n  YYSYMBOL_last = 1844  /* last */\n};\n")
    rows = dimensions.read_symbol_kinds(spark, str(path)).orderBy("kind").collect()
    assert [tuple(r) for r in rows] == [(-2, "YYEMPTY", True), (1843, "opt_x", True), (1844, "last", False)]


def test_unknown_tag_is_an_error(spark):
    df = spark.createDataFrame([(1, "1:840:1:NOPE:TABLE:x|||-||")], "row_id int, semantic_tree string")
    with pytest.raises(KeyError, match="NOPE"):
        tree.assert_known_tags(df, "expert", ["row_id"])
    with pytest.raises(ValueError, match="Unknown mode"):
        tree.trace_features(df, "novel")


def test_missing_tree_has_zero_features(spark):
    df = spark.createDataFrame([(1, None), (2, "||-||"), (3, "a:b:c|")], "row_id int, semantic_tree string")
    rows = tree.trace_features(df, "ruleid").collect()
    assert all(r.CREATE == r.A_NONE == r.O_NONE == r.max_c_sqlkywds == 0 and r.avg_c_sqlkywds == 0.0 for r in rows)
    assert all(r.symbkinds == [] and r.kind_counts == {} for r in rows)


def test_escapes_stay_unless_asked(spark):
    df = spark.createDataFrame([(1, "1:840:1:READ::SELECTG_SEMICOLONFROM|||-||")], "row_id int, semantic_tree string")
    assert tree.literal_keyword_stats(df, ["row_id"]).first().max_c_sqlkywds == 0
    assert tree.literal_keyword_stats(df, ["row_id"], unescape=True).first().max_c_sqlkywds == 2


@pytest.mark.parametrize(
    "text,expected",
    [
        ("a NOT IN (1)", 1),
        ("x not like y and z", 2),
        ("NOT INT", 2),
        ("selecting union", 1),
        ("élike like", 1),
        ("a!b", 1),
        ("! select", 1),
        ("a MEMBER OF b", 1),
        ("x SOUNDS LIKE y", 1),
        ("not not in", 2),
        ("", 0),
    ],
)
def test_keyword_count(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(X.keyword_count(F.col("t")).alias("a"), X.keyword_count_by_pattern(F.col("t")).alias("b")).first()
    assert (row.a, row.b) == (expected, expected)


def _plain_lexical(text: str) -> dict:
    """The rules of the character and operator counts, written out plainly."""
    kinds = dict.fromkeys(["c_num", "c_upper", "c_space", "c_special", "c_square_brackets", "c_round_brackets", "c_curly_brackets"], 0)
    for c in text:
        if c.isdigit():
            kinds["c_num"] += 1
        elif c.isupper():
            kinds["c_upper"] += 1
        elif c.isspace():
            kinds["c_space"] += 1
        elif c in "+-*/":
            pass
        elif c in "[]":
            kinds["c_square_brackets"] += 1
        elif c in "()":
            kinds["c_round_brackets"] += 1
        elif c in "{}":
            kinds["c_curly_brackets"] += 1
        elif not c.isalnum():
            kinds["c_special"] += 1
    kinds["c_arith"] = len(re.findall(r"[-+]|/(?!\*)|\*(?!/)", text))
    kinds["c_comparison"] = sum(text.count(o) for o in registry.COMPARISON_OPERATORS)
    kinds["has_tautology"] = int(re.search(r"(\w+)=\1", text) is not None)
    kinds["len_query"] = len(text)
    return kinds


TEXTS = [
    "SELECT * FROM t WHERE a<=1 AND b<>2 OR 1=1 -- x",
    "a/*b*/c*d /*/ ++ --",
    "x=ab a=xa éa=éa",
    "ab=ba", "abc=bcd", "a= a", "==", "a==a", "w=\nw", "_=_",
    "² ① ٣ Ⅷ Ⓐ ǅ ß  \x1c\x85\t　",
    "[a](b){c} {{}} 'q' \"r\" _ \\ | \U0001f600",
    "<>= >=< !== <=>",
    "",
    "ÀÉ é ñ 日本 ½ 一",
]


def test_lexical_counts_match_plain_rules(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "row_id int, full_query string")
    for row in lexical.lexical_features(df).collect():
        expected = _plain_lexical(TEXTS[row.row_id])
        assert {k: row[k] for k in expected} == expected, TEXTS[row.row_id]


def test_labelled_queries_keep_line_breaks(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text(",".join(registry.STATEMENT_COLUMNS) + '\n"SELECT ""a"",\n 1",1,a,,,,S,T1,,union,train\n"x",0,,,,,,,,,test\n')
    rows = tables.read_labelled_queries(spark, str(path)).orderBy("row_id").collect()
    assert [r.full_query for r in rows] == ['SELECT "a",\n 1', "x"]
    assert [r.label for r in rows] == [1, 0] and rows[1].attack_technique is None
    assert rows[0].row_id != rows[1].row_id


def test_materialize_depends_on_content(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "row_id int, v string")
    root = str(tmp_path / "store")
    sinks.materialize(df, root, "1", "expert")
    # A second table with the same source is not computed at all.
    broken = df.withColumn("v", F.raise_error(F.lit("computed again")).cast("string"))
    again = sinks.materialize(broken, root, "1", "expert", source=df.repartition(3))
    assert sorted(r.v for r in again.collect()) == ["a", "b"]
    other = sinks.materialize(df.filter("row_id = 1"), root, "1", "expert")
    assert other.count() == 1


def test_missing_model(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="nowhere"):
        sinks.load_model(spark, "nowhere", [str(tmp_path)])


def test_null_normalised(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text('id,name,size\n1,"",2.5\n,"a, b",\n')
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("size", T.DoubleType())])
    rows = tables.read_null_normalised_csv(spark, str(path), schema).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(1, None, 2.5), (None, "a, b", None)], key=str)


def test_shuffled_first_n_too_few(spark):
    df = spark.range(5).withColumnRenamed("id", "row_id")
    with pytest.raises(ValueError):
        selection.shuffled_first_n(df, 6, F.col("row_id"), "d")
    assert selection.shuffled_first_n(df, 3, F.col("row_id"), "d").count() == 3
