"""The encoding driver, power series with a stored start, and bases of directional messages, against numpy."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import directional, encodings, graphs, positional


def random_graphs():
    r = np.random.default_rng(11)
    for g, n in enumerate((1, 2, 6, 9, 12)):
        a = np.triu(r.random((n, n)) < 0.35, 1)
        if g == 3:
            a[:4, 4:] = False  # two components at least
        yield g, (a + a.T).astype(float)


@pytest.fixture(scope="module")
def tables(spark):
    nodes, edges = [], []
    for g, a in random_graphs():
        nodes += [(g, i) for i in range(len(a))]
        edges += [(g, int(i), int(j)) for i, j in zip(*np.nonzero(a), strict=True)]
    return spark.createDataFrame(nodes, "graph_id long, node_id int").repartition(3), spark.createDataFrame(edges, "graph_id long, src int, dst int").repartition(3)


def test_all_encodings_from_one_gather(spark, tables):
    specs = {
        "val": {"type": "laplacian_eigval", "num_pos": 4}, "vec": {"type": "laplacian_eigvec", "num_pos": 3}, "rw": {"type": "rw_return_probs", "ksteps": [1, 3, 4]}, "rw_again": {"type": "rw_return_probs", "ksteps": [2], "space_dim": 2},
        "walk": {"type": "rw_transition_probs", "ksteps": [2, 3]}, "electro": {"type": "electrostatic"}, "commute": {"type": "commute"}, "hops": {"type": "graphormer"},
        "electro_node": {"type": "electrostatic", "level": "node"}, "rw_pair": {"type": "rw_return_probs", "ksteps": [2], "level": "nodepair"}, "rw_edge": {"type": "rw_return_probs", "ksteps": [2], "level": "edge"}, "commute_edge": {"type": "commute", "level": "edge"},
    }
    out = positional.encode_all(*tables, specs)
    got = {(r["graph_id"], r["node_id"]): r["pe"] for r in out.collect()}
    assert len(got) == sum(len(a) for _, a in random_graphs())
    nan = lambda rows: np.array([[np.nan if x[0] is None else x[0] for x in row] for row in rows])
    for g, a in random_graphs():
        n = len(a)
        rows = [got[g, i] for i in range(n)]
        assert np.allclose([r["val"] for r in rows], np.abs(encodings.laplacian_eigen(a, 4)[0]), atol=1e-9)
        back = encodings.walk_return(a, [1, 3, 4])
        assert np.allclose([r["rw"] for r in rows], back)
        assert np.allclose([r["rw_again"] for r in rows], encodings.walk_return(a, [2], 2))
        p = encodings.normalised(a, a, "inv")
        assert np.allclose(np.array([r["walk"] for r in rows])[:, :, 1], np.linalg.matrix_power(p, 3))
        e = encodings.electrostatic(a)
        assert np.allclose(nan([r["electro"] for r in rows]), e, atol=1e-8)
        assert np.allclose(nan([r["commute"] for r in rows]), encodings.commute(a), atol=1e-6)
        h = nan([r["hops"] for r in rows])
        want = np.full((n, n), np.nan)
        reach = np.eye(n)
        for k in range(n + 1):
            want[(reach > 0) & np.isnan(want)] = k
            reach = reach @ (a + np.eye(n))
        assert np.allclose(h, want, equal_nan=True)
        assert np.allclose([r["electro_node"] for r in rows], np.stack([f(e, axis=k) for k in (0, 1) for f in (np.min, np.mean, np.std)], axis=1), atol=1e-8)
        two = encodings.walk_return(a, [2])[:, 0]
        assert np.allclose(np.array([r["rw_pair"] for r in rows]), np.stack([two[:, None] + two[None], np.abs(two[:, None] - two[None])], axis=2))
        c = encodings.commute(a)
        for i, r in enumerate(rows):
            assert [x["dst"] for x in r["rw_edge"]] == [int(j) for j in np.flatnonzero(a[i])]
            assert all(np.allclose(x["v"], [two[i] + two[x["dst"]], abs(two[i] - two[x["dst"]])]) for x in r["rw_edge"])
            assert all(abs(x["v"][0] - c[i, x["dst"]]) < 1e-6 for x in r["commute_edge"])


def test_driver_errors_come_before_any_work(tables):
    for specs, error in (({"x": {"type": "fourier"}}, ValueError), ({"x": {"level": "node"}}, ValueError), ({"x": {"type": "commute", "level": "graph"}}, ValueError)):
        with pytest.raises(error):
            positional.encode_all(*tables, specs)
    with pytest.raises(Exception, match="more than 5 nodes"):
        positional.encode_all(*tables, {"x": {"type": "graphormer"}}, max_nodes=5).collect()


def test_power_series_goes_on_from_a_stored_power(spark, tables, tmp_path):
    whole = {tuple(r)[:4]: r["p"] for r in positional.walk_powers(*tables, [1, 2, 5, 8]).collect()}
    for g, a in random_graphs():
        p = encodings.normalised(a, a, "inv")
        for k in (1, 2, 5, 8):
            m = np.linalg.matrix_power(p, k)
            assert all(abs(m[i, j] - whole.get((g, i, j, k), 0)) < 1e-12 for i in range(len(a)) for j in range(len(a)))
    positional.walk_powers(*tables, [5]).select("graph_id", "i", "j", "p").write.parquet(f"{tmp_path}/p5")
    stored = spark.read.parquet(f"{tmp_path}/p5")
    rest = {tuple(r)[:4]: r["p"] for r in positional.walk_powers(*tables, [6, 8], stored, 5).collect()}
    assert all(abs(rest[x] - whole[x]) < 1e-12 for x in whole if x[3] == 8)
    # what is stored is used: a doubled start gives doubled powers
    twice = {tuple(r)[:4]: r["p"] for r in positional.walk_powers(*tables, [8], stored.withColumn("p", F.col("p") * 2), 5).collect()}
    assert twice and all(abs(v - 2 * whole[x]) < 1e-12 for x, v in twice.items())
    with pytest.raises(ValueError, match="rise"):
        positional.walk_powers(*tables, [4, 2])


def test_breadth_first_hops_of_large_graphs():
    n = 400
    a = np.zeros((n, n))
    a[np.arange(n - 1), np.arange(1, n)] = 1
    assert (encodings.hops(a + a.T) == np.abs(np.arange(n)[:, None] - np.arange(n)[None])).all()
    one_way = encodings.hops(a)
    assert one_way[0, n - 1] == n - 1 and np.isnan(one_way[1, 0])


def test_spherical_bases_are_orthonormal_over_the_ball(spark):
    cutoff, orders, count = 2.0, 3, 3
    d = (np.arange(400) + 0.5) / 400 * cutoff
    t = (np.arange(60) + 0.5) / 60 * math.pi
    grid = spark.createDataFrame([(float(x), float(y)) for x in d for y in t], "d double, t double")
    basis = directional.spherical(F.col("d"), F.col("t"), cutoff, orders, count)
    volume = F.col("d") * F.col("d") * F.sin("t") * (2 * math.pi * cutoff / 400 * math.pi / 60)
    n = len(basis)
    rows = grid.select(*[b.alias(f"b{k}") for k, b in enumerate(basis)], volume.alias("w"))
    got = rows.agg(*[F.sum(F.col(f"b{i}") * F.col(f"b{j}") * F.col("w")).alias(f"g{i}_{j}") for i in range(n) for j in range(n)]).first()
    assert np.allclose(np.array(got).reshape(n, n), np.eye(n), atol=0.01)


def test_bessel_zeros_and_small_arguments(spark):
    assert np.allclose(directional.zeros(1, 3), [4.493409458, 7.725251837, 10.904121659]) and np.allclose(directional.zeros(2, 2), [5.763459197, 9.095011330])
    x = spark.createDataFrame([(v,) for v in (1e-6, 0.01, 0.19, 0.39, 0.59, 0.61, 0.79, 0.81)], "x double")
    got = x.select("x", *[directional.bessel(l, F.col("x")).alias(f"j{l}") for l in range(4)]).collect()
    for r in got:
        for l in range(4):
            want = sum((-1) ** k * r["x"] ** (2 * k + l) / (2**k * math.factorial(k) * math.prod(range(1, 2 * (l + k) + 2, 2))) for k in range(12))
            assert abs(r[f"j{l}"] - want) < 1e-9 * max(abs(want), 1e-3)
    ends = x.select(directional.envelope(F.lit(0.0), 2.0).alias("a"), directional.envelope(F.lit(1.999), 2.0).alias("b"), directional.envelope(F.lit(2.5), 2.0).alias("c"), directional.radial(F.lit(0.0), 2.0, 2)[1].alias("d")).first()
    assert ends["a"] == 1 and abs(ends["b"]) < 1e-6 and ends["c"] == 0 and abs(ends["d"] - 2 * math.pi / 2) < 1e-12


@pytest.mark.parametrize("most", [1, 3, 10_000])
def test_hubs_are_dealt_over_keys_without_losing_a_triplet(spark, most):
    ends = [(k, 0) for k in range(1, 9)] + [(0, k) for k in range(1, 12)] + [(3, 4), (4, 3)]
    edges = spark.createDataFrame([(7, a, b, float(a)) for a, b in ends], "graph_id long, src int, dst int, x double")
    got = sorted((r["k"], r["j"], r["i"], r["kj_x"], r["ji_x"]) for r in directional.line_graph(edges, ["x"], most).collect())
    assert got == sorted((a, b, d, float(a), float(b)) for a, b in ends for c, d in ends if b == c and a != d)


def test_directional_sums_against_numpy(spark):
    r = np.random.default_rng(4)
    pos, n = r.normal(size=(6, 3)), 6
    ends = [(a, b) for a in range(n) for b in range(n) if a != b and (a + b) % 3]
    x = r.normal(size=(len(ends), 2))
    rows = [(1, a, b, *map(float, pos[b] - pos[a]), [float(v) for v in x[k]]) for k, (a, b) in enumerate(ends)]
    edges = spark.createDataFrame(rows, "graph_id long, src int, dst int, dx double, dy double, dz double, x array<double>")
    cutoff, weights = 6.0, r.normal(size=(2, 2, 2))  # orders 0 and 1, one zero each
    z0, z1 = directional.zeros(0, 1)[0], directional.zeros(1, 1)[0]

    def basis(d, t):
        j0, j1 = np.sin(z0 * d / cutoff) / (z0 * d / cutoff), np.sin(z1 * d / cutoff) / (z1 * d / cutoff) ** 2 - np.cos(z1 * d / cutoff) / (z1 * d / cutoff)
        return np.array([math.sqrt(2 / cutoff**3) / abs(directional._j(1, z0)) * j0 * math.sqrt(1 / (4 * math.pi)), math.sqrt(2 / cutoff**3) / abs(directional._j(2, z1)) * j1 * math.sqrt(3 / (4 * math.pi)) * np.cos(t)])

    got = {(g["src"], g["dst"]): g["h"] for g in directional.directional(edges, weights.tolist(), cutoff, 2, 1, most=2).collect()}
    assert len(got) == len(ends)
    for j, i in ends:
        want = np.zeros(2)
        for e, (k, m) in enumerate(ends):
            if m == j and k != i:
                a, b = pos[j] - pos[i], pos[k] - pos[i]
                t = math.atan2(np.linalg.norm(np.cross(a, b)), a @ b)
                want += np.einsum("osc,s,c->o", weights, basis(np.linalg.norm(pos[j] - pos[k]), t), x[e])
        assert np.allclose(got[j, i], want, atol=1e-9)


def test_equal_graphs_are_encoded_once_a_task(spark):
    calls = spark.sparkContext.accumulator(0)

    def kernel(a):
        calls.add(1)
        return a.sum(axis=1)[:, None] + a[:, [0]]

    nodes = spark.createDataFrame([(g, i) for g in range(300) for i in range(3)], "graph_id long, node_id int")
    ends = [[(0, 1), (1, 0), (1, 2), (2, 1)], [(2, 1), (1, 2), (0, 1), (1, 0)], [(0, 1), (1, 0), (0, 1), (1, 0)], []]
    edges = spark.createDataFrame([(g, a, b) for g in range(300) for a, b in ends[g % 4]], "graph_id long, src int, dst int")
    got = {(x["graph_id"], x["node_id"]): x["pe"] for x in encodings.encode(nodes, edges, kernel).collect()}
    want = [[1.0, 3.0, 1.0], [1.0, 3.0, 1.0], [2.0, 4.0, 0.0], [0.0, 0.0, 0.0]]
    assert got == {(g, i): [want[g % 4][i]] for g in range(300) for i in range(3)}
    assert calls.value <= 60  # three kinds of graphs, by far fewer tasks than graphs


def test_order_graphs_are_dealt_by_their_rows(spark, monkeypatch):
    """F7, F8, F9, F13, F14: a task's rows stay as many when the table grows."""
    monkeypatch.setattr(graphs, "_ROWS", 50)
    rows = spark.range(2000).selectExpr("id div 4 AS l_orderkey", "int(id % 4) AS l_linenumber", "id AS l_partkey", "id AS l_suppkey", "1.0D AS l_quantity", "2.0D AS l_extendedprice", "0.1D AS l_discount", "0.0D AS l_tax", "'A' AS l_returnflag")
    nodes = graphs.order_nodes(rows)
    assert nodes.rdd.getNumPartitions() == 40 and nodes.count() == 2000
    steps = {(r.graph_id, r.src, r.dst) for r in graphs.path_steps(nodes).collect()}
    assert steps == {(g, i, j) for g in range(500) for i in range(4) for j in (i - 1, i + 1) if 0 <= j < 4}


def test_rows_of_equal_graphs_are_copied(spark):
    """F7, F8, F9, F13, F14: a batch puts a result's rows together once, whatever the number of graphs that have it."""
    waiting, made = encodings.Batch(), [np.arange(3.0), np.arange(2.0) + 10]
    for g in range(100):
        waiting.add(g, made[g % 2], 3)
    assert len(waiting.made) == 2
    out = waiting.rows(np.array([3, 2]), [pa.array(np.concatenate(made))], ["v"]).to_pydict()
    assert out["graph_id"] == [g for g in range(100) for _ in made[g % 2]] and out["v"] == [x for g in range(100) for x in made[g % 2]]
