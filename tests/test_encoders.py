"""Sign-free encoders, staged fingerprints and the matrix sink."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import encoders, encodings, positional
from tessera.sources import npy

PHI, RHO = [([[0.5, 1.0], [1.0, -2.0]], [0.2, 0.1], "tanh")], [([[1.0, 1.0], [0.5, -1.0]], None, "none")]


def eigen(spark, pad):
    a = np.zeros((6, 6))
    for i, j in ((0, 1), (1, 2), (2, 3), (0, 3), (4, 5)):  # a ring of four, which has a repeated eigenvalue, and a pair
        a[i, j] = a[j, i] = 1
    nodes = spark.createDataFrame([(1, i) for i in range(6)], "graph_id long, node_id int")
    edges = spark.createDataFrame([(1, int(i), int(j)) for i, j in zip(*np.nonzero(a), strict=True)], "graph_id long, src int, dst int")
    spec = {"values": {"type": "laplacian_eigval", "num_pos": 3, "pad": pad}, "vectors": {"type": "laplacian_eigvec", "num_pos": 3, "pad": pad}, "spaces": {"type": "laplacian_projection", "num_spaces": 3}}
    return a, edges, positional.encode_all(nodes, edges, spec).select("graph_id", "node_id", "pe.*")


def rows_of(df, column="h"):
    return np.array([r[column] for r in df.orderBy("node_id").collect()])


def test_encoders_do_not_see_signs(spark):
    _, edges, pe = eigen(spark, float("nan"))
    turned = pe.withColumn("vectors", F.transform("vectors", lambda v, k: F.when(k % 2 == 0, -v).otherwise(v)))
    assert all(r["vectors"][2] is None for r in pe.where("node_id >= 4").collect())
    assert np.allclose(rows_of(encoders.laplacian_encoder(pe, PHI, RHO)), rows_of(encoders.laplacian_encoder(turned, PHI, RHO)))
    gin = [[([[1.0], [-0.5]], [0.1, 0.3], "tanh")], [([[0.4, 1.0]], [0.2], "relu")]]
    rho = [([[1.0, 0.5, -1.0]], [0.0], "none")]
    assert np.allclose(rows_of(encoders.sign_net(pe, edges, gin, rho, 3)), rows_of(encoders.sign_net(turned, edges, gin, rho, 3)))
    given = rows_of(encoders.laplacian_encoder(pe, PHI, RHO, signs="given"))
    assert not np.allclose(given, rows_of(encoders.laplacian_encoder(turned, PHI, RHO, signs="given")))
    flipped = [rows_of(encoders.laplacian_encoder(pe, PHI, RHO, signs="random", seed=s)) for s in range(6)]
    assert np.allclose(flipped[0], rows_of(encoders.laplacian_encoder(pe, PHI, RHO, signs="random", seed=0))) and any(not np.allclose(flipped[0], f) for f in flipped)
    with pytest.raises(ValueError, match="signs"):
        encoders.laplacian_encoder(pe, PHI, RHO, signs="none")


def test_encoders_against_numpy(spark):
    a, edges, pe = eigen(spark, float("nan"))
    got = pe.orderBy("node_id").collect()
    want = []
    for r in got:
        total = np.zeros(2)
        for w, v in zip(r["values"], r["vectors"], strict=True):
            if v is not None:
                total += sum(np.tanh(np.array(PHI[0][0]) @ [w, s * v] + PHI[0][1]) for s in (1, -1))
        want.append(np.array(RHO[0][0]) @ total)
    assert np.allclose(rows_of(encoders.laplacian_encoder(pe, PHI, RHO)), want)
    x = np.array([[0.0 if v is None else v for v in r["vectors"]] for r in got])
    h = {s: np.tanh((s * (x + a @ x))[:, :, None] * np.array([1.0, -0.5]) + [0.1, 0.3]) for s in (1, -1)}
    there = np.array([[v is not None for v in r["vectors"]] for r in got])
    flat = (np.where(there[:, :, None], h[1] + h[-1], 0)).reshape(6, -1)
    rho = [[1.0, 2.0, 0.5, -1.0, 0.3, 0.7]]
    assert np.allclose(rows_of(encoders.sign_net(pe, edges, [[([[1.0], [-0.5]], [0.1, 0.3], "tanh")]], [(rho, None, "none")], 3)), flat @ np.array(rho).T)


def test_projections_do_not_see_bases_of_repeated_eigenvalues(spark):
    _, _, pe = eigen(spark, 0.0)
    got = rows_of(pe, "spaces")
    assert np.allclose(got[:4], [[0.25, 0.5, 0.25]] * 4) and np.allclose(got[4:], [[0.5, 0.5, 0.0]] * 2)
    r = np.random.default_rng(3)
    order = r.permutation(6)
    a, _, _ = eigen(spark, 0.0)
    moved = a[np.ix_(order, order)]
    g = positional.Graph(6, *np.nonzero(moved))
    assert np.allclose(positional._projections(g, 3), got[order])
    assert encodings.components(a).tolist() == [0, 0, 0, 0, 4, 4]


def test_fingerprints_stop_at_the_last_stage_asked_for(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 1, [3.0, 5.0]), (2, 0, [4.0, 0.0])], "graph_id long, node_id int, x array<double>")
    ran = []

    def stage(name, f):
        def run(df):
            ran.append(name)
            return df.select("graph_id", "node_id", f(F.col("x")).alias("x"))

        return name, run

    stages = [stage("a", lambda x: x), stage("b", lambda x: F.array(F.get(x, F.lit(0)) * 10)), stage("c", lambda x: x)]
    got = {r["graph_id"]: r["fingerprint"] for r in encoders.fingerprints(rows, stages, {"b": ("sum",), "a": ("max", "mean")}, {"a": 2, "b": 1}).collect()}
    assert got == {1: [40.0, 3.0, 5.0, 2.0, 3.5], 2: [40.0, 4.0, 0.0, 4.0, 0.0]} and ran == ["a", "b"]
    for at in ({"z": ("sum",)}, {}):
        with pytest.raises(ValueError, match="stages are"):
            encoders.fingerprints(rows, stages, at, {"z": 1})


def test_matrices_are_written_and_read_back(spark, tmp_path):
    npy.register(spark)
    rows = [(k, [k * 0.5, -k * 1.0, float("nan") if k == 3 else 1.0]) for k in range(500)]
    df = spark.createDataFrame(rows, "graph_id long, fingerprint array<double>").repartition(4)
    folder = f"{tmp_path}/m"
    df.write.format("npy").option("path", folder).mode("overwrite").save()
    read = lambda: {r["key"]: r["fingerprint"] for r in spark.read.format("npy").option("path", folder).load().collect()}
    assert set(read()) == set(range(500)) and read()[7] == [3.5, -7.0, 1.0] and read()[3][2] != read()[3][2]
    assert not [f for f in os.listdir(folder) if f.startswith("_run")]
    df.select((F.col("graph_id") + 1000).alias("graph_id"), "fingerprint").write.format("npy").option("path", folder).mode("append").save()
    assert len(read()) == 1000
    df.limit(0).write.format("npy").option("path", folder).mode("overwrite").save()
    assert read() == {} and [f for f in os.listdir(folder) if f.startswith("part-")] == []


def test_a_failed_run_leaves_nothing(spark, tmp_path):
    npy.register(spark)
    good = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(100)], "k long, v array<double>")
    folder = f"{tmp_path}/m"
    good.write.format("npy").option("path", folder).mode("overwrite").save()
    before = sorted(os.listdir(folder))
    for bad in ([(1, [1.0])], [(1, None)], [(1, [None, 2.0])]):
        mixed = good.union(spark.createDataFrame(bad, "k long, v array<double>"))
        with pytest.raises(Exception, match="rows"):
            mixed.write.format("npy").option("path", folder).mode("overwrite").save()
        assert sorted(os.listdir(folder)) == before
    assert spark.read.format("npy").option("path", folder).load().count() == 100
    with pytest.raises(Exception, match="no committed"):
        spark.read.format("npy").option("path", f"{tmp_path}/none").load().count()
    with pytest.raises(Exception, match="long key"):
        good.select("v", "k").write.format("npy").option("path", folder).mode("append").save()
