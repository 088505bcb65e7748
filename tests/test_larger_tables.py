"""Tables that come as folders of files, and work that grows with its tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from querysentry import session
from querysentry.operators import autoencoder as AE
from querysentry.operators import neighbours as NN
from querysentry.operators import training as TR
from querysentry.operators.fitting import fit_plans
from querysentry.operators.vectors import unpack
from querysentry.streaming import logs
from querysentry.workload import traces


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_of_files_is_a_stream(spark, tmp_path, files):
    """The file or the folder of a table's name is read, other tables are not."""
    rows = spark.range(30).withColumn("name", F.concat(F.lit("n"), "id"))
    if files == 1:
        rows.toPandas().to_parquet(tmp_path / "rows.parquet")
    else:
        rows.repartition(files).write.parquet(str(tmp_path / "rows.parquet"))
    spark.range(7).write.parquet(str(tmp_path / "others.parquet"))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for _ in range(2):
        logs.run_available(logs.stream_parquet(spark, str(tmp_path), "rows", rows.schema), out, checkpoint)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(30))


@pytest.mark.parametrize("leg_bytes", [1 << 26, 6_000, 1])
def test_models_do_not_depend_on_the_size_of_the_table(spark, monkeypatch, leg_bytes):
    """beyond all limits a model is still what a plain loop over all batches makes, with one leg or many."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 6)) @ rng.normal(size=(6, 6)) / 4
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_id long, features array<double>")
    names, epochs = [f"f{i}" for i in range(6)], 10
    for limit, value in (("SHARD_VALUES", 1_000), ("LARGE_REQUEST", 1), ("LEG_BYTES", leg_bytes)):
        monkeypatch.setattr(TR, limit, value, raising=False)
    plans = {h: AE.AutoencoderPlan(h, names, h, False, rate=0.01, epochs=epochs, batch=25) for h in ("tanh", "relu")}
    models = [fit_plans({h: (df, p) for h, p in plans.items()}, small_values=0), fit_plans({"tanh": (df.repartition(7), plans["tanh"])})]
    dealt = {}
    rows = df.select(F.lit("s").alias("source"), "features", "row_id")
    stored = sorted(TR.blocks(rows, 25, "row_id").collect(), key=lambda r: r.slot)
    for r in stored:
        dealt.setdefault(r.batch, []).append(unpack(r.x))
    dealt = {b: np.concatenate(parts) for b, parts in dealt.items()}
    batches = max(dealt) + 1
    leg = max(1, min(batches, leg_bytes * batches // sum(len(r.x) for r in stored)))
    legs = -(-batches // leg)
    assert legs == {1 << 26: 1, 6_000: 6, 1: 24}[leg_bytes]
    weights, losses, t = AE.initial_weights(6), [], 0
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for epoch in range(epochs):
        loss, visited = 0, []
        order = np.random.default_rng([2, epoch]).permutation(batches)
        for now in np.random.default_rng([2, epoch, legs]).permutation(legs):
            visited += [b for b in order if b // leg == now]
        assert sorted(visited) == list(range(batches))
        for b in visited:
            if b in dealt:
                error, g = AE._gradient(dealt[b], weights, "tanh")
                t, loss = t + 1, loss + error * len(dealt[b])
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                weights = weights - 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        losses.append(loss / len(x))
    for made in models:
        np.testing.assert_allclose(made["tanh"]["parameters"]["losses"], losses, rtol=1e-9)
        np.testing.assert_allclose(made["tanh"]["weights"], weights, atol=1e-9)
    assert losses[-1] < losses[0] and models[0]["relu"]["parameters"]["losses"][-1] < models[0]["relu"]["parameters"]["losses"][0]


def test_tasks_go_with_the_rows(spark, tmp_path):
    """A table of twice the rows gets twice the tasks once cores are busy; equal keys are one tree in whatever task."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(1_000).write.parquet(str(tmp_path / "few"))
    few = spark.read.parquet(str(tmp_path / "few")).coalesce(1)
    assert session.task_count(few) == cores and session.task_count(few, 10) == 100
    spark.range(64).coalesce(1).write.parquet(str(tmp_path / "one"))
    spread = session.spread_small_input(spark.read.parquet(str(tmp_path / "one")), "id", rows_per_task=2)
    assert spread.rdd.getNumPartitions() == 32 and spread.count() == 64
    items = [(o, 1 + o % 3, 10 + o % 2, 5, 1.0, "A", 2.0) for o in range(20)] * 2 + [(None, 1, 10, 5, 1.0, "A", 2.0)] * 2
    spark.createDataFrame(
        items, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_extendedprice double"
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    trees = traces._distinct_trees(spark, str(tmp_path)).collect()
    assert len(trees) == 21 and all(t.semantic_tree.startswith(f"1:{t.part}::::|2:{t.supplier}:") for t in trees)


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_neighbours_over_many_chunks(spark, monkeypatch, spread):
    """Exact with many small chunks and parts, with and without useful cells, repeated vectors included; a query is sent once to a chunk."""
    monkeypatch.setattr(NN, "CHUNK_ROWS", 70)
    monkeypatch.setattr(NN, "ROWS_AT_ONCE", 16)
    monkeypatch.setattr(NN, "QUERIES_AT_ONCE", 32)
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(8, 3)), 50, axis=0) + rng.normal(size=(400, 3)) * spread
    x[100:130] = x[99]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_id long, features array<double>").repartition(5)
    sent = []
    group = type(df).groupBy

    def spied(frame, *columns):
        if columns == ("chunk", "split") and "cells" in frame.columns:
            sent.append(group(frame, "row_id", "chunk").count().agg(F.max("count")).first()[0])
        return group(frame, *columns)

    monkeypatch.setattr(type(df), "groupBy", spied)
    for own in (True, False):
        got = NN.nearest_neighbours(df, df, 6, own, rows_per_block=20).orderBy("row_id", "rank").collect()
        apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        if own:
            np.fill_diagonal(apart, np.inf)
        order = np.stack([np.lexsort((np.arange(400), row)) for row in apart])[:, :6]
        assert [r.neighbour for r in got] == order.ravel().tolist()
        np.testing.assert_allclose([r.distance for r in got], np.take_along_axis(apart, order, 1).ravel(), atol=1e-12)
    assert sent == [1, 1]
