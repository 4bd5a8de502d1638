"""Columns without spread, without positives, zero vectors; averages over classes; dense batches and back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import metrics
from tessera.operators import collate, labels, pairs, splits


def test_regression_metrics_of_degenerate_columns(spark):
    m = metrics.regression()
    rows = spark.createDataFrame([("constant", 1.0, 2.0), ("constant", 3.0, 2.0), ("zero", 0.0, 0.0), ("zero", 0.0, 0.0)], "k string, pred double, target double")
    got = {r["k"]: r for r in rows.groupBy("k").agg(*[v.alias(k) for k, v in m.items()]).collect()}
    assert got["constant"]["r2"] is None and got["zero"]["cosine"] is None and got["constant"]["mae"] == 1.0


def test_pr_curve_without_positives(spark):
    rows = spark.createDataFrame([(0.5, 0.0), (0.2, 0.0)], "pred double, target double")
    got = metrics.pr_curve(rows).collect()
    assert len(got) == 2 and all(r["recall"] is None and r["precision"] == 0 for r in got)


def test_normalising_a_constant_column(spark):
    rows = spark.createDataFrame([(1.0,), (1.0,), (None,)], "x double")
    for how in ("normal", "unit"):
        assert [r["x"] for r in labels.normalised_by(rows, "x", how, F.lit(True)).collect()] == [None] * 3
    split = spark.createDataFrame([(0.0, "train"), (2.0, "train"), (10.0, "val")], "x double, s string")
    got = labels.normalised_by(split, "x", "normal", F.col("s") == "train").collect()
    assert sorted(r["x"] for r in got) == [-1.0, 1.0, 9.0]


def test_weights_without_positives(spark):
    for v in (0, 1):
        rows = spark.createDataFrame([(v,), (v,)], "y int")
        assert [r["weight"] for r in labels.balance_weights(rows, "y").collect()] == [None, None]


def test_class_counts_against_numpy(spark):
    r = np.random.default_rng(3)
    scores, target = r.integers(0, 6, (300, 4)).astype(float), r.integers(0, 4, 300)
    rows = spark.createDataFrame([(s.tolist(), int(t)) for s, t in zip(scores, target, strict=True)] + [([1.0, 0.0, 0.0, 0.0], None)], "scores array<double>, target int")
    for k in (1, 2):
        for ignored in (None, 2):
            use = np.ones(300, bool) if ignored is None else target != ignored
            best = np.argsort(-scores[use], axis=1, kind="stable")[:, :k]
            chosen = np.zeros((use.sum(), 4), bool)
            np.put_along_axis(chosen, best, True, axis=1)
            true = np.eye(4, dtype=bool)[target[use]]
            got = {x["class"]: x for x in metrics.class_counts(rows, k, ignored).collect()}
            for c in range(4):
                want = [(chosen & true)[:, c].sum(), (chosen & ~true)[:, c].sum(), (~chosen & true)[:, c].sum(), (~chosen & ~true)[:, c].sum()]
                assert [got[c][n] for n in ("tp", "fp", "fn", "tn")] == want
    with pytest.raises(ValueError):
        metrics.averaged(metrics.class_counts(rows), "all")


def test_dense_and_back(spark):
    nodes = spark.createDataFrame([(1, 0, 5.0), (1, 1, None), (2, 0, 7.0)], "graph_id long, node_id int, x double")
    dense = {(r["graph_id"], r["slot"]): (r["x"], r["mask"]) for r in collate.to_dense(nodes, ["x"], 2, -1.0).collect()}
    assert dense == {(1, 0): (5.0, True), (1, 1): (None, True), (2, 0): (7.0, True), (2, 1): (-1.0, False)}
    back = collate.from_dense(collate.to_dense(nodes, ["x"], 3), ["x"])
    assert sorted(back.collect(), key=str) == sorted(nodes.collect(), key=str)
    with pytest.raises(Exception, match="more than 1 nodes"):
        collate.to_dense(nodes, ["x"], 1).collect()


def test_hops_of_any_length(spark):
    nodes = spark.createDataFrame([(1, k) for k in range(9)] + [(2, 0), (2, 1)], "graph_id long, node_id int")
    edges = spark.createDataFrame([(1, a, b) for k in range(8) for a, b in ((k, k + 1), (k + 1, k))], "graph_id long, src int, dst int")
    got = {(r["graph_id"], r["i"], r["j"]): r["hops"] for r in pairs.hop_distance(nodes, edges).collect()}
    assert all(got[1, i, j] == abs(i - j) for i in range(9) for j in range(9)) and got[2, 0, 1] is None and got[2, 1, 1] == 0
    assert {r["hops"] for r in pairs.hop_distance(nodes, edges, 2).collect()} == {0, 1, 2, None}


def test_share_of_rows_and_overlap(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    assert splits.sub_sample(rows, 0.25, "k").count() == 250
    got = splits.split_overlap_to_train(rows, rows.where("k < 100"), "k", 0.2, 0.1)
    assert got.where("k < 100 and split <> 'train'").count() == 0 and got.where("k >= 100 and split = 'val'").count() == 180
