"""Queries over feature vectors and models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from querysentry import registry
from querysentry.operators import autoencoder as AE
from querysentry.operators import forest as FO
from querysentry.operators import neighbours as NN
from querysentry.operators import one_class as OC
from querysentry.operators import scaling as S
from querysentry.operators import scoring as SC
from querysentry.operators import tree as TREE
from querysentry.operators.fitting import fit_plans
from querysentry.operators.lexical import lexical_features
from querysentry.plans import evaluation as E
from querysentry.session import shared_path
from querysentry.sources import sinks
from querysentry.workload.bindings import TEXTS, invocations, planted, table, texts, vectors
from querysentry.workload.registry import query
from querysentry.workload.traces import _features_sql

_VECTORS = "SELECT vec_id AS row_id, list_transform(embedding, lambda v: v::DOUBLE) AS x, label FROM embeddings"
_PLANTED = f"""SELECT row_id, CASE WHEN row_id % 50 = 0 THEN list_transform(x, lambda v: v * 8) ELSE x END AS x,
CAST(row_id % 50 = 0 AS INT) AS label FROM ({_VECTORS})"""
_LONG = f"SELECT row_id, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS pos FROM ({_VECTORS})"


def _long(df):
    """Vectors as rows, rounded, to compare them with SQL."""
    return df.select("row_id", F.posexplode("features").alias("pos", "value")).withColumn("value", F.round("value", 9))


@query(
    "standard_scale",
    f"""WITH l AS ({_LONG}), s AS (SELECT pos, AVG(v) AS m, stddev_pop(v) AS d FROM l GROUP BY pos)
SELECT row_id, CAST(l.pos AS INT) AS pos, ROUND((v - m) / d, 9) AS value FROM l JOIN s ON s.pos = l.pos""",
)
def standard_scale(spark, sf_dir):
    df = vectors(spark, sf_dir)
    return _long(S.apply_scaler(df, S.fit_standard(df)))


@query(
    "max_abs_scale",
    f"""WITH l AS ({_LONG}), s AS (SELECT pos, MAX(abs(v)) AS d FROM l GROUP BY pos)
SELECT row_id, CAST(l.pos AS INT) AS pos, ROUND(v / d, 9) AS value FROM l JOIN s ON s.pos = l.pos""",
)
def max_abs_scale(spark, sf_dir):
    df = vectors(spark, sf_dir)
    return _long(S.apply_scaler(df, S.fit_max_abs(df)))


_ORDER = registry.feature_order("expert")


@query(
    "assemble_features",
    f"""WITH f AS ({_features_sql("expert")}), v AS (SELECT stmt_id, [{", ".join(f'"{c}"::DOUBLE' for c in _ORDER)}] AS x FROM f)
SELECT stmt_id, CAST(unnest(range(1, len(x) + 1)) - 1 AS INT) AS pos, unnest(x) AS value FROM v""",
)
def assemble_features(spark, sf_dir):
    table = TREE.statement_features(invocations(spark, sf_dir), "expert")
    return S.assemble(table, _ORDER, ["stmt_id"]).select("stmt_id", F.posexplode("features").alias("pos", "value"))


# --- Autoencoder with fixed weights --------------------------------------------------------


def fixed_model(width: int = 64) -> dict:
    """Weights by rule, no biases, tanh head."""
    sizes = AE.layer_sizes(width)
    layers = []
    for n_in, n_out in zip(sizes, sizes[1:]):
        i, j = np.meshgrid(np.arange(n_in), np.arange(n_out), indexing="ij")
        layers.append((((7 * i + 3 * j) % 11 - 5) / 50.0, np.zeros(n_out)))
    return {
        "model_name": "fixed",
        "kind": "autoencoder",
        "parameters": {"head": "tanh"},
        "feature_columns": [f"v{i}" for i in range(width)],
        "scaler": None,
        "weights": AE.pack(layers),
    }


def _layer(source: str, n_in: int, n_out: int, function: str) -> str:
    product = f"list_dot_product({source}, list_transform(range(0, {n_in}), lambda i: ((7 * i + 3 * j) % 11 - 5) / 50.0::DOUBLE))"
    return f"list_transform(range(0, {n_out}), lambda j: {function.format(product)})"


_RELU, _TANH = "greatest({}, 0.0)", "(1 - 2 / (exp(2 * {}) + 1))"
_OUTPUT = f"""SELECT row_id, x, {_layer('h3', 42, 64, _TANH)} AS y FROM (
SELECT row_id, x, {_layer('h2', 21, 42, _RELU)} AS h3 FROM (
SELECT row_id, x, {_layer('h1', 42, 21, _RELU)} AS h2 FROM (
SELECT row_id, x, {_layer('x', 64, 42, _RELU)} AS h1 FROM ({_VECTORS}))))"""


@query(
    "score_autoencoder",
    f"""WITH o AS ({_OUTPUT}), e AS (SELECT row_id, unnest(x) - unnest(y) AS d FROM o)
SELECT row_id, ROUND(AVG(d * d), 9) AS score FROM e GROUP BY row_id""",
)
def score_autoencoder(spark, sf_dir):
    return AE.score_autoencoder(vectors(spark, sf_dir), fixed_model()).select("row_id", F.round("score", 9).alias("score"))


@query(
    "reconstruction_error_by_feature",
    f"""WITH o AS ({_OUTPUT}), e AS (SELECT unnest(x) - unnest(y) AS d, unnest(range(0, 64)) AS pos FROM o)
SELECT CAST(pos AS INT) AS pos, CONCAT('v', pos) AS feature, ROUND(AVG(d * d), 9) AS mse FROM e GROUP BY pos""",
)
def reconstruction_error_by_feature(spark, sf_dir):
    errors = AE.reconstruction_error_by_feature(vectors(spark, sf_dir), fixed_model())
    return errors.withColumn("mse", F.round("mse", 9))


@query(
    "score_table",
    f"SELECT row_id, ROUND(list_sum(list_transform(x, lambda v: v * v)), 9) AS score FROM ({_VECTORS})",
)
def score_table(spark, sf_dir):
    """A user's own score function, in batches of three rows."""
    scored = SC.score_table(vectors(spark, sf_dir), lambda df: df, lambda x: (x * x).sum(axis=1), batch_size=3)
    return scored.withColumn("score", F.round("score", 9))


@query("throughput", "SELECT 'fixed' AS model, COUNT(*) AS n_samples, TRUE AS measured FROM embeddings")
def throughput(spark, sf_dir):
    scored = AE.score_autoencoder(vectors(spark, sf_dir), fixed_model())
    return SC.throughput(scored, "fixed").select("model", "n_samples", (F.col("elapsed_seconds") > 0).alias("measured"))


@query("save_model", "SELECT 'fixed' AS model_name, 'autoencoder' AS kind, 'tanh' AS head, COUNT(*) AS n_scored FROM embeddings")
def save_model(spark, sf_dir):
    """A stored model, found in the second folder searched, scores the table."""
    root = shared_path(spark, "models")
    sinks.save_model(spark, fixed_model(), root)
    model = sinks.load_model(spark, "fixed", [root + "-missing", root])
    scored = AE.score_autoencoder(vectors(spark, sf_dir), model)
    return scored.agg(F.count("score").alias("n_scored")).select(
        F.lit(model["model_name"]).alias("model_name"), F.lit(model["kind"]).alias("kind"),
        F.lit(model["parameters"]["head"]).alias("head"), "n_scored",
    )


# --- Trained models: no SQL twin -----------------------------------------------------------


def _names(width: int) -> list[str]:
    return [f"v{i}" for i in range(width)]


@query("fit_autoencoder")
def fit_autoencoder(spark, sf_dir):
    """Trained on all vectors, applied to the ones with planted outliers."""
    model = AE.fit_autoencoder(vectors(spark, sf_dir), "ae", _names(64), "sigmoid")
    return AE.score_autoencoder(planted(spark, sf_dir), model).select("row_id", "label", "score")


@query("fit_autoencoder_tanh")
def fit_autoencoder_tanh(spark, sf_dir):
    """Embedding vectors in -1..1, unscaled, tanh head."""
    model = AE.fit_autoencoder(vectors(spark, sf_dir), "ae", _names(64), "tanh", False)
    return AE.score_autoencoder(planted(spark, sf_dir), model).select("row_id", "label", "score")


@query("fit_lexical_autoencoder")
def fit_lexical_autoencoder(spark, sf_dir):
    df = texts(spark, sf_dir)
    model = AE.fit_lexical_autoencoder(df)
    scored = S.assemble(lexical_features(df), registry.LEXICAL, ["row_id"])
    return AE.score_autoencoder(scored, model)


@query("fit_one_class_svm")
def fit_one_class_svm(spark, sf_dir):
    model = OC.fit_one_class_svm(vectors(spark, sf_dir), "svm", _names(64))
    return OC.score_one_class_svm(planted(spark, sf_dir), model).select("row_id", "label", "score")


def _outliers(scored):
    """Whether a row is among as many of the highest scores as there are planted outliers."""
    wanted = scored.agg(F.sum("label")).first()[0]
    # One number, whatever the rows.
    border = scored.orderBy(F.desc("score")).limit(wanted).agg(F.min("score")).first()[0]
    return scored.select("row_id", "label", (F.col("score") >= border).cast("int").alias("found"))


_FOUND = f"SELECT row_id, label, label AS found FROM ({_PLANTED})"


@query("autoencoder_finds_outliers", _FOUND)
def autoencoder_finds_outliers(spark, sf_dir):
    return _outliers(fit_autoencoder_tanh(spark, sf_dir))


@query("one_class_svm_finds_outliers", _FOUND)
def one_class_svm_finds_outliers(spark, sf_dir):
    return _outliers(fit_one_class_svm(spark, sf_dir))


@query(
    "autoencoder_training",
    f"""SELECT head, 100 AS epochs, TRUE AS falls, TRUE AS alike, (SELECT COUNT(*) FROM embeddings) AS n_rows
FROM (VALUES ('relu'), ('sigmoid'), ('tanh')) AS h(head)""",
)
def autoencoder_training(spark, sf_dir):
    """All heads trained together, twice: in tasks, and in lockstep over other partitions. Losses fall and models are equal."""
    rows = vectors(spark, sf_dir)
    plans = {h: AE.AutoencoderPlan(h, _names(64), h, h == "sigmoid", batch=256) for h in AE.HEADS}
    one = fit_plans({h: (rows, p) for h, p in plans.items()})
    two = fit_plans({h: (rows.repartition(5), p._replace(epochs=3)) for h, p in plans.items()}, small_values=0)
    n, made = rows.count(), []
    for head in sorted(plans):
        losses, again = (m[head]["parameters"]["losses"] for m in (one, two))
        made.append((head, len(losses), losses[-1] < losses[0], bool(np.allclose(losses[:3], again, rtol=1e-9)), n))
    return spark.createDataFrame(made, "head string, epochs int, falls boolean, alike boolean, n_rows long")


@query(
    "lexical_autoencoder_training",
    "SELECT 32 AS width, 100 AS epochs, TRUE AS falls, TRUE AS finite, COUNT(*) AS n_rows FROM ("
    + TEXTS + ") t",
)
def lexical_autoencoder_training(spark, sf_dir):
    df = texts(spark, sf_dir)
    model = AE.fit_lexical_autoencoder(df)
    losses = model["parameters"]["losses"]
    scored = AE.score_autoencoder(S.assemble(lexical_features(df), registry.LEXICAL, ["row_id"]), model)
    return scored.agg(
        F.lit(len(model["feature_columns"])).alias("width"), F.lit(len(losses)).alias("epochs"), F.lit(losses[-1] < losses[0]).alias("falls"),
        F.min((F.col("score") >= 0) & (F.col("score") < float("inf"))).alias("finite"), F.count(F.lit(1)).alias("n_rows"),
    )


_PAIRS = """SELECT q.row_id, t.row_id AS neighbour, list_distance(q.x, t.x) AS distance,
ROW_NUMBER() OVER (PARTITION BY q.row_id ORDER BY list_distance(q.x, t.x), t.row_id) AS rank FROM {q} q, v t {where}"""
_FITTED = f"""v AS MATERIALIZED ({_VECTORS}),
n AS (SELECT * FROM ({_PAIRS.format(q='v', where='WHERE q.row_id <> t.row_id')}) WHERE rank <= 20),
k AS (SELECT row_id, MAX(distance) AS k_distance FROM n GROUP BY row_id),
m AS (SELECT n.row_id, 1 / (AVG(greatest(distance, k_distance)) + 1e-10) AS density FROM n JOIN k ON k.row_id = n.neighbour GROUP BY n.row_id)"""


@query(
    "nearest_neighbours",
    f"""WITH v AS MATERIALIZED ({_VECTORS})
SELECT row_id, neighbour, ROUND(distance, 9) AS distance, CAST(rank AS INT) AS rank
FROM ({_PAIRS.format(q='v', where='WHERE q.row_id <> t.row_id')}) WHERE rank <= 20""",
)
def nearest_neighbours(spark, sf_dir):
    near = NN.nearest_neighbours(vectors(spark, sf_dir), vectors(spark, sf_dir), 20, True, rows_per_block=256)
    return near.withColumn("distance", F.round("distance", 9))


@query("nearest_by_forest", "SELECT 20 * COUNT(*) AS n_pairs, TRUE AS enough FROM embeddings")
def nearest_by_forest(spark, sf_dir):
    """At least nine tenths of the exact neighbours of every vector."""
    train = vectors(spark, sf_dir)
    exact = NN.nearest_neighbours(train, train, 20, True, rows_per_block=1024)
    return FO.recall(FO.nearest_by_forest(train, train, 20, True), exact).select("n_pairs", (F.col("recall") >= 0.9).alias("enough"))


@query(
    "fit_lof",
    f"""WITH {_FITTED} SELECT k.row_id, ROUND(k_distance, 6) AS k_distance, ROUND(density, 6) AS density
FROM k JOIN m ON m.row_id = k.row_id""",
)
def fit_lof(spark, sf_dir):
    model = NN.fit_lof(vectors(spark, sf_dir), rows_per_block=1024)
    return model.select("row_id", F.round("k_distance", 6).alias("k_distance"), F.round("density", 6).alias("density"))


@query(
    "score_lof",
    f"""WITH {_FITTED}, p AS MATERIALIZED ({_PLANTED}),
q AS (SELECT * FROM ({_PAIRS.format(q='p', where='')}) WHERE rank <= 20)
SELECT q.row_id, ROUND(AVG(m.density) / (1 / (AVG(greatest(distance, k_distance)) + 1e-10)) - 1.5, 6) AS score
FROM q JOIN k ON k.row_id = q.neighbour JOIN m ON m.row_id = q.neighbour GROUP BY q.row_id""",
)
def score_lof(spark, sf_dir):
    train = vectors(spark, sf_dir)
    scored = NN.score_lof(planted(spark, sf_dir), train, NN.fit_lof(train, rows_per_block=1024), rows_per_block=1024)
    return scored.withColumn("score", F.round("score", 6))


_TECHNIQUES = "o_orderpriority"


def _grid_sql(models: list[str]) -> str:
    return f"""WITH o AS (SELECT o.* FROM orders o WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
c AS (SELECT COUNT(*) FILTER (o_orderkey % 10 >= 7) AS n_test, COUNT(*) FILTER (o_orderkey % 10 BETWEEN 5 AND 6) AS n_val,
 COUNT(*) FILTER (o_orderkey % 10 >= 7 AND o_orderstatus = 'F') AS n_odd,
 COUNT(DISTINCT CASE WHEN o_orderkey % 10 >= 7 AND o_orderstatus = 'F' THEN {_TECHNIQUES} END) AS n_techniques FROM o)
SELECT m.model, n_test, n_val, n_odd, n_techniques, TRUE AS rate_held, TRUE AS consistent, TRUE AS in_range
FROM c, (SELECT unnest([{", ".join(f"'{m}'" for m in models)}]) AS model) m"""


@query("evaluate_grid", _grid_sql([f"{m}-{v}" for v in registry.VOCABULARIES for m in ("ae", "svm", "lof")]))
def evaluate_grid(spark, sf_dir):
    """Three classifiers on the trace and lexical features of all vocabularies."""
    return _grid(spark, sf_dir, registry.VOCABULARIES, True, {"ae": _ae, "svm": _svm})


@query("evaluate_grid_ruleid", _grid_sql(["ae_ruleid", "svm_ruleid"]))
def evaluate_grid_ruleid(spark, sf_dir):
    """Two classifiers on the counts of 1,013 rules."""
    return _grid(spark, sf_dir, [], False, {"ae_ruleid": _ae, "svm_ruleid": _svm})


def _ae(mode):
    return AE.AutoencoderPlan(f"ae-{mode}", registry.feature_order(mode, True))


def _svm(mode):
    return OC.OneClassPlan(f"svm-{mode}", registry.feature_order(mode, True))


def _grid(spark, sf_dir, vocabularies, with_lof, plans):
    """A grid with full epochs and steps.

    The report's numbers have no SQL twin, so it is returned as what must hold: counts, the
    rate of validation rows above the threshold, F1 from precision and recall, areas and
    rates in range.
    """

    def features(mode):
        log = invocations(spark, sf_dir, registry.vocabulary_of(mode))
        rows = TREE.statement_features(log, mode, "stmt_id")
        if mode == "ruleid":
            kinds = TREE.statement_kind_counts(log).groupBy("stmt_id").agg(
                F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("kind_counts")
            )
            rows = rows.join(kinds, "stmt_id", "left").withColumn(
                "kind_counts", F.coalesce("kind_counts", F.create_map().cast("map<int,bigint>"))
            )
        statement = F.concat(
            F.lit("SELECT * FROM t WHERE c="), F.col("o_custkey").cast("string"), F.lit(" AND p = '"), F.col("o_orderpriority"),
            F.when(F.col("o_orderstatus") == "F", "' OR 1=1 -- ").otherwise("'"),
        )
        orders = table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("stmt_id"),
            statement.alias("full_query"),
            (F.col("o_orderstatus") == "F").cast("int").alias("label"),
            F.col(_TECHNIQUES).alias("attack_technique"),
            F.col("o_orderstatus").alias("statement_type"),
            F.when(F.col("o_orderkey") % 10 < 5, "train").when(F.col("o_orderkey") % 10 < 7, "val").otherwise("test").alias("split"),
        )
        keep = ["stmt_id", "label", "attack_technique", "statement_type", "split"]
        joined = S.assemble_mode(lexical_features(rows.join(orders, "stmt_id")), mode, True, keep, sparse=mode == "ruleid")
        return joined.withColumnRenamed("stmt_id", "row_id")

    def lof(train, rows, mode):
        scaled = S.apply_scaler(train, scaler := S.fit_max_abs(train))
        return NN.score_lof(S.apply_scaler(rows, scaler), scaled, NN.fit_lof(scaled))

    report, scores = E.evaluate_grid(features, {"lof": lof} if with_lof else {}, vocabularies, plans=plans)
    counts = scores.groupBy("model").agg(
        F.count_if(F.col("split") == "test").alias("n_test"),
        F.count_if(F.col("split") == "val").alias("n_val"),
        F.count_if((F.col("split") == "test") & (F.col("label") == 1)).alias("n_odd"),
    )
    joined = scores.join(report, "model")
    above = joined.filter("split = 'val'").groupBy("model").agg(F.count_if(F.col("score") > F.col("threshold")).alias("above"))
    p, r = F.col("precision"), F.col("recall")
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    ranged = F.lit(True)
    for c in ("f1", "accuracy", "precision", "recall", "fpr", "auprc", "auroc", "balanced_accuracy"):
        ranged = ranged & F.col(c).between(0, 1)
    return report.join(counts, "model").join(above, "model").select(
        "model", "n_test", "n_val", "n_odd",
        F.size("recall_by_technique").cast("long").alias("n_techniques"),
        (F.col("above") <= registry.MAX_FALSE_POSITIVE_RATE * F.col("n_val") + 1).alias("rate_held"),
        (F.abs(F.col("f1") - f1) < 1e-9).alias("consistent"),
        ranged.alias("in_range"),
    )
