"""Weighted and partial areas, sample and multi-dimensional averages, weights over labels, rare columns, kept results, pooled encoders, local-global block."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import metrics
from tessera.operators import encoders, labels, message
from tessera.sources import readers


def test_weighted_partial_area_against_steps(spark):
    r = np.random.default_rng(1)
    rows = [("a", float(r.integers(0, 8)), float(r.integers(0, 2)), float(r.random() + 0.1)) for _ in range(80)] + [("b", 0.5, 1.0, 1.0), ("b", 0.4, None, 1.0)]
    df = spark.createDataFrame(rows, "task string, pred double, target double, weight double")
    own = [x for x in rows if x[0] == "a"]
    p, n = sum(w for *_, t, w in own if t), sum(w for *_, t, w in own if not t)
    for most in (1.0, 0.4, 0.05):
        points = [(0.0, 0.0)]
        for s in sorted({x[1] for x in own}, reverse=True):
            points.append((sum(w for _, v, t, w in own if v >= s and not t) / n, sum(w for _, v, t, w in own if v >= s and t) / p))
        area = 0.0  # where several points have one false positive rate, the curve goes straight up
        for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
            if x1 > x0 and x0 < most:
                f = min((most - x0) / (x1 - x0), 1)
                area += f * (x1 - x0) * (y0 + f * (y1 - y0) / 2)
        want = area if most == 1 else 0.5 * (1 + (area - most**2 / 2) / (most - most**2 / 2))
        got = {x["task"]: x["auroc"] for x in metrics.weighted_auroc(df, "task", max_fpr=most).collect()}
        assert abs(got["a"] - want) < 1e-9 and got["b"] is None
    even = {x["task"]: x["auroc"] for x in metrics.weighted_auroc(df.withColumn("weight", F.lit(1.0)), "task").collect()}
    assert abs(even["a"] - {x["task"]: x["auroc"] for x in metrics.auroc(metrics.present(df), "task").collect()}["a"]) < 1e-12
    with pytest.raises(ValueError, match="max_fpr"):
        metrics.weighted_auroc(df, "task", max_fpr=0)


def test_samples_and_multidimensional_averages(spark):
    rows = [(1, 0.9, 1.0), (1, 0.8, 0.0), (1, 0.1, 1.0), (2, 0.9, 1.0), (2, 0.2, 0.0), (3, 0.9, None)]
    got = metrics.sample_averages(spark.createDataFrame(rows, "k int, pred double, target double"), "k").first()
    assert (round(got["precision"], 9), round(got["recall"], 9), round(got["accuracy"], 9)) == (0.75, 0.75, round((1 / 3 + 1) / 2, 9))
    many = [(1, [0.7, 0.3], 0), (1, [0.6, 0.4], 1), (2, [0.2, 0.8], 1), (2, [0.1, 0.9], 1)]
    df = spark.createDataFrame(many, "k int, scores array<double>, target int")
    each = metrics.multidim_averages(df, "k", "samplewise", "macro").first()
    # sample 1: class 0 has precision 1/2 and recall 1, class 1 none; sample 2: class 1 is perfect
    assert (each["precision"], each["recall"]) == ((0.25 + 1) / 2, (0.5 + 1) / 2)
    assert metrics.multidim_averages(df, "k", "samplewise", "micro").first()["recall"] == 0.75
    assert metrics.multidim_averages(df, "k", "global", "micro").first()["recall"] == 0.75
    with pytest.raises(ValueError, match="samplewise"):
        metrics.multidim_averages(df, "k", "each")


def test_weights_over_labels_and_rare_columns(spark):
    rows = [(0, 1, 0, 1), (1, 0, 0, 1), (2, 0, None, 1), (3, 0, 1, 1)]
    df = spark.createDataFrame(rows, "k int, a int, b int, c int")
    got = {r["k"]: r["weight"] for r in labels.balance_weights_all(df, ["a", "b", "c"]).collect()}
    raw = {0: 4 * (1 / 3), 1: 0.25 / 3, 2: 0.25, 3: 0.25 * 3}
    assert all(abs(got[k] - v / max(raw.values())) < 1e-12 for k, v in raw.items())
    with pytest.raises(Exception, match="not binary"):
        labels.balance_weights_all(df.withColumn("a", F.lit(2)), ["a"]).collect()
    kept, gone = labels.drop_rare(df, ["a", "b", "c"], 2)
    assert kept.columns == ["k", "c"] and gone == ["a", "b"] and labels.drop_rare(df.limit(0), ["a"], 1)[1] == ["a"]


def test_results_are_kept_by_run(spark, tmp_path):
    with pytest.raises(ValueError, match="no results"):
        readers.kept_results(spark, f"{tmp_path}/r")
    table = spark.createDataFrame([("mae", 0.5), ("r2", 0.9)], "metric string, value double")
    one = readers.keep_results(table, f"{tmp_path}/r", {"lr": 0.1})
    assert readers.keep_results(table.limit(1), f"{tmp_path}/r", {"lr": 0.1}) == one
    readers.keep_results(table.withColumn("step", F.lit(3)), f"{tmp_path}/r", {"lr": 0.2})
    got = readers.kept_results(spark, f"{tmp_path}/r")
    assert got.count() == 3 and got.where(F.col("run") == one).count() == 1 and got.where("step = 3").count() == 2


def test_pooled_outputs(spark):
    make = lambda rows: spark.createDataFrame(rows, "graph_id long, node_id int, x array<double>")
    a, b = make([(1, 0, [1.0, 5.0]), (1, 1, [2.0, 2.0])]), make([(1, 0, [3.0, 1.0])])
    base = make([(1, 0, [9.0]), (1, 2, [8.0])])
    for how, first in (("sum", [4.0, 6.0]), ("mean", [2.0, 3.0]), ("max", [3.0, 5.0])):
        got = {r["node_id"]: r["h"] for r in encoders.pool_outputs([a, b], 2, how, base).collect()}
        assert got == {0: [9.0, *first], 1: [0.0, 2.0, 2.0], 2: [8.0, 0.0, 0.0]}
    with pytest.raises(ValueError, match="pooled by"):
        encoders.pool_outputs([a], 2, "median")


def test_local_global_block_against_numpy(spark):
    r = np.random.default_rng(5)
    n, w, heads = 7, 4, 2
    x = r.normal(size=(n, w))
    ends = [(int(a), int(b)) for a, b in r.integers(0, n, (12, 2))]
    mats = {c: r.normal(size=(w, w)) for c in "qkvo"}
    f1, f2 = r.normal(size=(3, w)), r.normal(size=(w, 3))
    nodes = spark.createDataFrame([(1, i, [float(v) for v in x[i]], i == 2) for i in range(n)], "graph_id long, node_id long, x array<double>, masked boolean")
    edges = message.with_ends(spark.createDataFrame([(1, a, b) for a, b in ends], "graph_id long, src long, dst long"), nodes, "x")
    local = np.zeros((n, w))
    for a, b in ends:
        local[b] += x[a]
    q, k, v = (x @ mats[c].T for c in "qkv")
    seen = np.zeros((n, w))
    keys = [i for i in range(n) if i != 2]
    for h in range(heads):
        s = slice(2 * h, 2 * h + 2)
        e = np.exp(q[:, s] @ k[keys][:, s].T * 0.5)
        seen[:, s] = e / e.sum(axis=1, keepdims=True) @ v[keys][:, s]
    h = local + x + seen @ mats["o"].T
    want = h + np.maximum(h @ f1.T, 0) @ f2.T
    out = encoders.gps(nodes, edges, w, heads, {c: m.tolist() for c, m in mats.items()}, [(f1.tolist(), None, "relu"), (f2.tolist(), None, "none")], tile=3)
    got = {g["node_id"]: g["h"] for g in out.collect()}
    assert all(np.allclose(got[i], want[i]) for i in range(n))
