"""The plans for large groups give the same results as the simple ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from querysentry import session
from querysentry.operators import curves as C
from querysentry.operators import metrics as M
from querysentry.operators import neighbours as NN
from querysentry.operators import quantiles as Q
from querysentry.operators import selection as S
from querysentry.operators import tree
from querysentry.session import GroupProfile


def skewed_scores(spark):
    """Three models; one holds most rows, and a third of all scores is one value."""
    row = F.col("id")
    return spark.range(20_000).select(
        row.alias("row_id"),
        F.when(row % 10 < 8, "big").when(row % 10 == 8, "mid").otherwise("low").alias("model"),
        F.when(row % 3 == 0, 5.0).otherwise(F.round(F.rand(7) * 10, 3)).alias("score"),
        (F.rand(11) < 0.3).cast("int").alias("label"),
    ).repartition(8, "row_id")


@pytest.fixture(scope="module")
def scores(spark):
    return skewed_scores(spark).cache()


@pytest.fixture
def distributed(monkeypatch):
    monkeypatch.setattr(session, "SMALL_GROUP_ROWS", 1)


@pytest.mark.parametrize("groups", [10_000, 1])
def test_quantile(scores, monkeypatch, groups):
    monkeypatch.setattr(session, "SMALL_GROUP_ROWS", 1)
    monkeypatch.setattr(session, "MAX_BROADCAST_GROUPS", groups)
    pdf = scores.toPandas()
    for q in (0.0, 0.001, 0.333, 0.5, 0.999, 1.0):
        got = {r.model: r.quantile for r in Q.exact_quantile(scores, "score", q, ["model"]).collect()}
        for model, part in pdf.groupby("model"):
            assert got[model] == pytest.approx(np.quantile(part.score, q), abs=1e-12)


def test_global_quantile_and_rank(scores, distributed):
    values = np.sort(scores.toPandas().score)
    assert Q.exact_quantile(scores, "score", 0.42).first().quantile == pytest.approx(np.quantile(values, 0.42))
    for rank in (0, 1, 777, len(values) - 1):
        assert Q.order_statistic(scores, "score", rank) == values[rank]


def test_running_totals(scores, distributed):
    counts = C.score_counts(scores)
    pdf = counts.toPandas().sort_values(["model", "score"], ascending=[True, False])
    pdf["cum"] = pdf.groupby("model").pos.cumsum()
    pdf["nxt"] = pdf.groupby("model").neg.shift(-1)
    got = Q.running_totals(counts, ["model"], "score", ["pos", "neg"], descending=True, following=True, buckets=37).toPandas()
    both = pdf.merge(got, on=["model", "score"])
    assert len(both) == len(pdf) == len(got)
    assert (both.cum == both.cum_pos).all()
    assert (both.nxt.fillna(-1) == both.next_neg.fillna(-1)).all()


def test_curves_and_areas(scores, monkeypatch):
    def everything():
        areas = sorted(map(tuple, C.curve_areas(scores).select("model", F.round("auprc", 9), F.round("auroc", 9)).collect()))
        roc = C.roc_curve(scores).groupBy("model").agg(F.count("*"), F.round(F.sum("tpr"), 6)).collect()
        pr = C.pr_curve(scores).groupBy("model").agg(F.count("*"), F.round(F.sum("precision"), 6)).collect()
        return areas, sorted(map(tuple, roc)), sorted(map(tuple, pr))

    simple = everything()
    monkeypatch.setattr(session, "SMALL_GROUP_ROWS", 1)
    assert everything() == simple
    pdf = scores.toPandas()
    for model, _, auroc in simple[0]:
        part = pdf[pdf.model == model]
        ranks = part.score.rank()
        n1 = part.label.sum()
        n0 = len(part) - n1
        wilcoxon = (ranks[part.label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
        assert auroc == pytest.approx(wilcoxon, abs=1e-8)


def test_tied_top_score_uses_the_end_point(spark):
    df = spark.createDataFrame([("m", 0.9, 0), ("m", 0.9, 1), ("m", 0.7, 1), ("m", 0.6, 0)], "model string, score double, label int")
    # Points (0,1), (1/2,1/2), (1,2/3), (1,1/2): 3/8 + 7/24.
    assert C.auprc(df).first().auprc == pytest.approx(3 / 8 + 7 / 24)


def test_thresholds_without_attacks(spark):
    df = spark.createDataFrame([("m", 0.5, 0), ("m", 0.2, 0)], "model string, score double, label int")
    predicted = M.predict(df, M.threshold(df, 0.1))
    row = M.basic_metrics(predicted).first()
    assert (row.precision, row.recall, row.f1) == (0, 0, 0)
    assert M.recall_by(predicted.withColumn("t", F.lit("x")), "t").count() == 0


def test_exact_validation_split(spark, distributed):
    df = spark.range(1003).select(F.col("id").alias("row_id"), F.when(F.col("id") < 903, "train").otherwise("test").alias("split"))
    counts = {r.split: r["count"] for r in S.validation_split(df, 0.1, 3, exact=True).groupBy("split").count().collect()}
    assert counts == {"train": 812, "val": 91, "test": 100}


def test_sampling_ignores_partitioning(spark):
    df = spark.range(5000).withColumnRenamed("id", "row_id")
    first = sorted(r.row_id for r in S.sample_n(df, 100).collect())
    assert first == sorted(r.row_id for r in S.sample_n(df.repartition(13), 100).collect())
    assert 350 < S.sample_fraction(df, 10).count() < 650


@pytest.mark.parametrize("width,rows_per_block", [(3, 40), (12, 100), (2, 5000)])
def test_nearest_neighbours_equal_brute_force(spark, width, rows_per_block):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, width))
    x[:200] = x[0]  # a third of the rows are copies of one
    x[200:400] = x[200:400] * 0.05 + 4
    y = np.concatenate([rng.normal(size=(50, width)) * 3, x[:10]])
    train = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>")
    asked = spark.createDataFrame([(i + 10_000, v.tolist()) for i, v in enumerate(y)], "row_id long, features array<double>")
    near = NN.nearest_neighbours(asked, train, 7, rows_per_block=rows_per_block).collect()
    got = {(r.row_id, r.rank): (r.neighbour, r.distance) for r in near}
    assert len(got) == 7 * len(y)
    for i, v in enumerate(y):
        d = np.sqrt(((x - v) ** 2).sum(1))
        order = np.lexsort((np.arange(len(x)), d))[:7]
        assert [got[(i + 10_000, r + 1)][0] for r in range(7)] == order.tolist()
        assert [got[(i + 10_000, r + 1)][1] for r in range(7)] == pytest.approx(d[order].tolist())


def test_outlier_factor_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x, k = rng.normal(size=(150, 4)), 10
    new = np.concatenate([rng.normal(size=(20, 4)), np.full((1, 4), 9.0)])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    near = d.argsort(axis=1)[:, :k]
    reach = np.take_along_axis(d, near, 1)
    k_distance = reach[:, -1]
    density = 1 / (np.maximum(reach, k_distance[near]).mean(1) + 1e-10)
    dn = np.sqrt(((new[:, None] - x[None]) ** 2).sum(2))
    nn = dn.argsort(axis=1)[:, :k]
    own = 1 / (np.maximum(np.take_along_axis(dn, nn, 1), k_distance[nn]).mean(1) + 1e-10)
    expected = (density[nn] / own[:, None]).mean(1) - 1.5
    train = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(new)], "row_id long, features array<double>")
    model = NN.fit_lof(train, k, rows_per_block=32)
    got = {r.row_id: r.score for r in NN.score_lof(rows, train, model, k, rows_per_block=32).collect()}
    assert [got[i] for i in range(len(new))] == pytest.approx(expected.tolist())
    assert max(got, key=got.get) == 20


def test_brackets_that_miss_are_widened(spark, monkeypatch):
    """A coarse sketch with a margin below its error misses ranks; the result is exact all the same."""
    monkeypatch.setattr(Q, "SKETCH_ACCURACY", 20)
    values = spark.range(4001).select(
        (F.col("id") % 3).alias("g"), F.when(F.col("id") % 7 == 0, 5.0).otherwise(F.pow(F.col("id") * 37 % 4001, 1.5)).alias("_v")
    ).repartition(9).cache()
    exact = {}
    for g, v in values.collect():
        exact.setdefault(g, []).append(v)
    attempts = []
    plain = Q._in_bracket
    monkeypatch.setattr(Q, "_in_bracket", lambda *a: attempts.append(a[-1]) or plain(*a))
    for q in (0.03, 0.37, 0.5, 0.999):
        at = F.floor((F.col("n") - 1) * F.lit(q))
        for row in Q._at_ranks(values, ["g"], q, at, at, GroupProfile(3, 10**9), margin=1e-6).collect():
            assert row.low == row.high == sorted(exact[row.g])[int((row.n - 1) * q)]
    assert max(attempts) > 1e-6


@pytest.mark.parametrize("following", [False, True])
def test_running_totals_over_levels_of_buckets(spark, following):
    """Buckets beyond the bound are split again; nulls and repeats of the ends don't hang."""
    counts = spark.range(3000).select(
        F.when(F.col("id") < 2000, "a").when(F.col("id") < 2999, "b").alias("g"), F.when(F.col("id") % 1000 > 0, F.col("id") ** 2.0).alias("v"), F.col("id").alias("c")
    ).repartition(7)
    plain = sorted(map(str, Q.running_totals(counts, ["g"], "v", ["c"], True, following).collect()))
    levels = Q.running_totals(counts, ["g"], "v", ["c"], True, following, buckets=4, profile=GroupProfile(3, 3000, 40))
    got = sorted(map(str, levels.collect()))
    # Rows of one value (null) may come in any order.
    def known(rows):
        return [r for r in rows if "v=None" not in r]

    assert len(got) == 3000 and known(got) == known(plain)


def test_kind_columns_by_place(spark):
    """Columns of any rules are those of the sparse counts."""
    rows = [{}, None, {832: 1}, {1844: 2}, {832: 3, 1844: 4, 1000: 5}, {1000: 1, 900: 2, 901: 7}]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, kind_counts map<int,int>")
    for kinds in (None, [1000, 900], [901]):
        wide = tree.widen_kinds(df, kinds)
        assert wide.columns[:2] == df.columns and "try_element_at" not in wide._jdf.queryExecution().analyzed().toString()
        for row in wide.collect():
            assert all(row[f"kind_{k}"] == (rows[row.id] or {}).get(k, 0) for k in kinds or range(832, 1845))


def test_many_symbols_sort_no_edges(spark, monkeypatch):
    """Edges meet a symbol table that is too large to be sent by hash; names stay the same."""
    text = "1:7::::|2:8::::|3:99::::|||-||1>2:3 2>3: "
    df = spark.createDataFrame([(k, text) for k in range(40)], "row_id int, semantic_tree string")
    kinds = spark.createDataFrame([(7, "a"), (8, "b"), (None, "none")], "kind int, name string")
    sent = sorted(map(str, tree.named_edges(df, kinds, ["row_id"]).collect()))
    monkeypatch.setattr(tree, "broadcast_if_small", lambda side: side)
    made = tree.named_edges(df, kinds, ["row_id"])
    assert "ShuffledHashJoin" in made._jdf.queryExecution().sparkPlan().toString()
    assert sorted(map(str, made.collect())) == sent and len(sent) == 120


def test_statements_of_all_sizes(spark, monkeypatch):
    """Large statements, null ones too, are combined apart; the features stay the same and tasks go with the rows."""
    text = "1:840::READ:TABLE:select a from t|2:8::::|||-||1>2: "
    rows = [(None if k % 3 == 0 else k % 5, 1, 2, k % 2, text, 3) for k in range(60)]
    log = spark.createDataFrame(rows, "stmt_id int, n_terminal long, n_nonterminal long, is_syntax_error int, semantic_tree string, depth long")
    whole = sorted(map(str, tree.statement_features(log, "expert").collect()))
    dealt = []
    monkeypatch.setattr(tree, "task_count", lambda df: dealt.append(df) or 7)
    assert sorted(map(str, tree.statement_features(log, "expert").collect())) == whole and dealt
    assert tree._summed_features(log, "expert", "stmt_id", None).rdd.getNumPartitions() == 7
    monkeypatch.setattr(tree, "SMALL_GROUP_ROWS", 10)
    assert sorted(map(str, tree.statement_features(log, "expert").collect())) == whole
