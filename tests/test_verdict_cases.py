"""Cases that once gave wrong or size-dependent results."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from querysentry import session
from querysentry.operators import curves as C
from querysentry.operators import metrics as M
from querysentry.operators import quantiles as Q
from querysentry.operators import reports as R
from querysentry.operators import tree as TREE
from querysentry.operators import traces
from querysentry.plans.evaluation import model_report
from querysentry.sources import sinks, tables
from querysentry.streaming import merging


def odd_scores(spark):
    """Models a and null, and a NaN score."""
    n = F.col("id")
    score = F.when(n == 7, float("nan")).otherwise(F.round((n * 37 % 101) / 7, 3))
    return spark.range(600).select(
        n.alias("row_id"), F.when(n % 3 > 0, "a").alias("model"), score.alias("score"), (n % 4 == 0).cast("int").alias("label"),
        F.lit("t").alias("attack_technique"), F.lit("s").alias("statement_type"),
    )


def test_plans_agree_on_null_groups(spark, monkeypatch):
    scores = odd_scores(spark).filter("not isnan(score)").cache()

    def everything():
        found = [
            Q.exact_quantile(scores, "score", 0.37, ["model"]), C.curve_areas(scores).select("model", F.round("auprc", 12), F.round("auroc", 12)),
            C.pr_curve(scores), C.roc_curve(scores),
        ]
        return [sorted(map(str, df.collect())) for df in found]

    simple = everything()
    assert any("None" in row for row in simple[0])
    monkeypatch.setattr(session, "SMALL_GROUP_ROWS", 1)
    assert everything() == simple


def test_plans_agree_on_nan(spark, monkeypatch):
    counts = C.score_counts(odd_scores(spark)).cache()
    simple = sorted(map(str, Q.running_totals(counts, ["model"], "score", ["pos"]).collect()))
    monkeypatch.setattr(session, "SMALL_GROUP_ROWS", 1)
    assert sorted(map(str, Q.running_totals(counts, ["model"], "score", ["pos"], buckets=9).collect())) == simple


def test_model_without_threshold(spark):
    scores = odd_scores(spark).filter("not isnan(score)")
    with pytest.raises(Exception, match="No threshold"):
        M.predict(scores, M.threshold(scores.filter("model = 'a'"))).collect()
    with pytest.raises(Exception, match="No threshold"):
        model_report(scores, scores.filter("model = 'a'")).collect()
    assert model_report(scores, scores).count() == 2


def test_named_edges_plans_agree(spark, monkeypatch):
    trees = ["1:900::::|2:901::::|||-||1>2: ", "1:900::::|2:901::::|||-||2>1: ", "1:900::::|||-||1>9: "]
    rows = spark.createDataFrame([(None, trees[0]), (5, trees[0]), (5, trees[1]), (6, trees[2])], "k long, semantic_tree string")
    kinds = spark.createDataFrame([(900, "A"), (901, "B")], "kind int, name string")

    def found():
        return sorted(map(str, [*TREE.named_edges(rows, kinds, ["k"]).collect(), *TREE.dangling_edges(rows, ["k"]).collect()]))

    inside = found()
    assert len(inside) == 4 and sum("parent_name='A', child_name='B'" in r for r in inside) == 2
    assert TREE.dangling_edges(rows, ["k"]).collect()[0][:] == (6, 0, 1, 9, True, False)
    monkeypatch.setattr(TREE, "IN_ROW_TREE", 0)
    assert found() == inside


def test_fingerprint_sees_nulls_and_names(spark, tmp_path):
    one = spark.createDataFrame([("x", None)], "a string, b string")
    two = spark.createDataFrame([(None, "x")], "a string, b string")
    three = one.toDF("c", "d")
    for df in (one, two, three):
        assert sinks.materialize(df, str(tmp_path), "1", "m").collect() == df.collect()


def test_header_orders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("query_id,n_terminal,n_nonterminal,is_syntax_error,semantic_tree,depth\n1,2,3,0,T,5\n")
    (tmp_path / "b.csv").write_text("depth,semantic_tree,query_id,n_terminal,n_nonterminal,is_syntax_error\n5,U,2,2,3,0\n")
    (tmp_path / "c.csv").write_text("")
    rows = tables.read_trace_log(spark, str(tmp_path), header_from_file=True).orderBy("query_id").collect()
    assert [(r.query_id, r.semantic_tree, r.depth) for r in rows] == [(1, "T", 5), (2, "U", 5)]
    with pytest.raises(Exception):
        tables.read_trace_log(spark, str(tmp_path)).collect()


def test_white_space_is_stripped(spark):
    df = spark.createDataFrame([("SELECT ab;", "ab\t"), ("SELECT cd;", "\n cd "), ("SELECT e", "zz"), ("S", None)], "full_query string, user_inputs string")
    assert sorted(r.template for r in R.extract_templates(df).collect()) == ["SELECT {value};", "SELECT {value};"]


def test_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Session())


def test_missing_counters_add_nothing(spark):
    log = spark.createDataFrame(
        [(1, 1, 5, None, None, 0, "a|||-||b", None), (1, 2, 6, None, 2, 0, None, None)],
        "stmt_id long, seq int, query_id long, n_terminal long, n_nonterminal long, is_syntax_error int, semantic_tree string, depth long",
    )
    for merged in (traces.merge_traces(log), traces.merge_trace_counters(log), TREE.statement_features(log, "expert")):
        row = merged.first()
        assert (row.n_terminal, row.n_nonterminal, row.depth, row.n_parser_invoc) == (0, 2, 0, 2)


def test_stream_merges_across_borders(spark, tmp_path):
    """Two runs over one folder: a statement crosses the hour, one is finished by the flush, a null key is one too."""
    columns = "stmt_id long, seq int, query_id long, n_terminal long, n_nonterminal long, is_syntax_error int, semantic_tree string, depth long, ts timestamp"

    def arrive(rows):
        made = [(k, n, n, 1, 1, 0, f"n{n}|||-||{n}>1: ", 1, datetime.fromisoformat(at)) for k, n, at in rows]
        spark.createDataFrame(made, columns).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run(flush):
        found = merging.stream_merge_invocations(spark.readStream.schema(columns).parquet(f"{tmp_path}/in"), f"{tmp_path}/work", flush=flush)
        return sorted((str(r.stmt_id), r.n_parser_invoc, r.semantic_tree) for r in found.collect())

    arrive([(1, 1, "2024-01-01 09:50:00"), (1, 2, "2024-01-01 10:20:00"), (None, 3, "2024-01-01 10:00:00"), (2, 4, "2024-01-01 13:00:00")])
    first = [("1", 2, "n1|n2|||-||1>1: 2>1: "), ("None", 1, "n3|||-||3>1: ")]
    assert run(False) == first
    arrive([(2, 5, "2024-01-01 13:59:00"), (2, 6, "2024-01-01 14:10:00")])
    assert run(False) == first
    assert run(True) == sorted([*first, ("2", 3, "n4|n5|n6|||-||4>1: 5>1: 6>1: ")])


def test_features_of_open_node_texts_equal_the_merged_form(spark):
    """Without a closing sign two nodes run into each other where texts are joined; keys may be null."""
    node = "1:840:1:create:db:select"
    trees = {
        1: [f"{node}||-||1>2: ", f"{node}|{node}|||-||1>2: ", f"{node}||-||"],
        2: [f"{node}|||-||1>2: ", f"{node}|||-||"],
        3: [f"{node}||-||"],
        None: [f"{node}||-||", "no tree", f"|||-||", f"{node}|||-||"],
    }
    rows = [(k, i, f"q{k}", 1, 2, 0, 3, t) for k, ts in trees.items() for i, t in enumerate(ts)]
    log = spark.createDataFrame(
        rows, "stmt_id long, seq long, query_id string, n_terminal long, n_nonterminal long, is_syntax_error int, depth long, semantic_tree string"
    )
    for mode in ("expert", "claude"):
        direct = TREE.statement_features(log, mode)
        merged = TREE.trace_features(traces.merge_traces(log), mode).select(*direct.columns)
        assert sorted(map(str, direct.collect())) == sorted(map(str, merged.collect()))
