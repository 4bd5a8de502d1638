"""Attention, cells, vector messages and directional messages against numpy, for tiles and hubs of every size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import attention, graphs, message, nearest, nn, pairs
from tessera.plans import registry


def plain_attention(q, k, v, masked, position, heads, hd, vd, bias, scale):
    n = len(q)
    out, near = np.full((n, heads * vd), np.nan), np.zeros((n, len(bias.centres) if bias else 0))
    keys = np.flatnonzero(~masked)
    for i in range(n):
        if not len(keys):
            continue
        for h in range(heads):
            s = np.array([scale * q[i, h * hd : (h + 1) * hd] @ k[j, h * hd : (h + 1) * hd] for j in keys])
            if bias:
                for x, (c, w) in enumerate(zip(bias.centres, bias.widths, strict=True)):
                    sigma = abs(w) + 0.01
                    g = np.array([np.exp(-0.5 * ((np.linalg.norm(position[i] - position[j]) - c) / sigma) ** 2) / (np.sqrt(2 * np.pi) * sigma) for j in keys])
                    g = np.where(np.isnan(g), 0, g)
                    s = s + bias.weights[x][h] * g
                    near[i, x] = g.sum()
            e = np.exp(s - s.max())
            out[i, h * vd : (h + 1) * vd] = e @ v[keys, h * vd : (h + 1) * vd] / e.sum()
    return out, near


@pytest.mark.parametrize("tile", [1, 3, 256])
def test_attention_for_tiles_of_every_size(spark, tile):
    r = np.random.default_rng(2)
    bias = attention.DistanceBias([0.0, 1.0], [0.5, -1.0], [[2.0, -1.0, 0.5], [0.3, 1.0, -2.0]])
    rows, want = [], {}
    for g, n in enumerate((1, 7, 4, 10)):
        q, k, v, p = (r.normal(0, 3, (n, w)) for w in (6, 6, 3, 3))
        masked = r.random(n) < 0.4 if g != 2 else np.ones(n, bool)
        if g == 3:
            p[:] = np.nan
        if g == 1:
            p[2] = np.nan
        ids = np.sort(r.choice(30, n, replace=False)) + 5
        h, near = plain_attention(q, k, v, masked, p, 3, 2, 1, bias, 0.5)
        for i in range(n):
            rows.append((g, int(ids[i]), *[[float(c) for c in x[i]] for x in (q, k, v)], None if np.isnan(p[i, 0]) else [float(c) for c in p[i]], bool(masked[i]) or None, "x"))
            want[g, int(ids[i])] = (h[i], near[i])
    nodes = spark.createDataFrame(rows, "graph_id long, node_id int, q array<double>, k array<double>, v array<double>, position array<double>, masked boolean, tile string").repartition(3)
    got = attention.attend(nodes, heads=3, head_dim=2, value_dim=1, bias=bias, tile=tile).collect()
    assert len(got) == len(want)
    for x in got:
        h, near = want[x["graph_id"], x["node_id"]]
        assert (x["h"] is None) == bool(np.isnan(h).all())
        assert x["h"] is None or np.allclose(x["h"], h)
        assert np.allclose(x["near"], near)
    plain = attention.attend(nodes.drop("position"), heads=3, head_dim=2, value_dim=1, tile=tile)
    assert plain.columns == ["graph_id", "node_id", "h"] and plain.count() == len(want)


def test_attention_scores_far_apart_stay_finite(spark):
    nodes = spark.createDataFrame([(0, i, [float(900 * i)], [float(i)], [float(i)], False) for i in range(5)], "graph_id long, node_id long, q array<double>, k array<double>, v array<double>, masked boolean")
    got = {x["node_id"]: x["h"][0] for x in attention.attend(nodes, 1, 1, 1, tile=2).collect()}
    assert got[0] == 2.0 and all(abs(got[i] - 4) < 1e-9 for i in range(1, 5))
    assert attention.attend(nodes.limit(0), 1, 1, 1).count() == 0


def test_radius_join_by_cells_equals_all_pairs(spark):
    r = np.random.default_rng(5)
    points = [(g, i, *map(float, p)) for g in range(3) for i, p in enumerate(r.normal(0, 1, (60, 3)))]
    points += [(3, i, x, 0.0, 0.0) for i, x in enumerate((0.0, 0.1, 0.2, 0.3, -0.1, 0.3))] + [(4, 0, float("nan"), 0.0, 0.0), (4, 1, None, 0.0, 0.0), (4, 2, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(points, "graph_id long, node_id int, x double, y double, z double")
    for cutoff, most in ((0.1, 3), (0.7, 5), (5.0, 100)):
        want = []
        for g in range(5):
            own = [p for p in points if p[0] == g and p[2] is not None and p[2] == p[2]]
            for a in own:
                near = sorted((round(d, 9), b[1], d) for b in own if b[1] != a[1] and (d := np.sqrt((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2)) <= cutoff)
                want += [(g, a[1], j) for _, j, _ in near[:most]]
        got = pairs.radius_join(df, ["x", "y", "z"], cutoff, most).select("graph_id", "i", "j").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_attention_tiles_are_full_whatever_the_numbers_of_nodes(spark):
    nodes = spark.createDataFrame([(g, 1000 * i + g, [1.0]) for g in range(2) for i in range(200)], "graph_id long, node_id long, q array<double>")
    own = attention.tiles(nodes, ["q"], 50).collect()
    assert len(own) == 8 and sorted(i for x in own for i in x["ids"]) == sorted(1000 * i + g for g in range(2) for i in range(200))


def test_radius_join_of_points_that_all_lie_within_the_cutoff_meets_few_tiles(spark, monkeypatch):
    r = np.random.default_rng(11)
    spread = r.normal(0, 0.1, (3000, 2)).round(3)
    points = [(7, i, *map(float, p)) for i, p in enumerate(spread)] + [(7, 3000 + i, 0.01, 0.02) for i in range(2000)] + [(8, 1, 0.0, float("inf")), (8, 2, 0.0, 0.0)]
    df = spark.createDataFrame(points, "graph_id int, node_id long, x double, y double")
    seen, own = [], nearest._met
    monkeypatch.setattr(nearest, "TILE", 64)
    monkeypatch.setattr(nearest, "_met", lambda tiles, axes: seen.append((tiles, own(tiles, axes))) or seen[-1][1])
    got = pairs.radius_join(df, ["x", "y"], 2.0, 4)
    assert [f.dataType.simpleString() for f in got.schema] == ["int", "bigint", "bigint", "double"]
    found = {}
    for x in got.collect():
        found.setdefault((x["graph_id"], x["i"]), []).append((round(x["dist"], 9), x["j"]))
    tiles, met = seen[0]
    size = tiles.count()
    assert size < 60 and met.count() < size * size / 2  # every point lies within the cutoff of every other, and 2000 at one place
    at = np.array([p[2:] for p in points[:-2]])
    assert len(found) == 5000
    for i in range(0, 5000, 37):
        apart = np.sqrt(((at - at[i]) ** 2).sum(axis=1)).round(9)
        assert sorted(found[7, i]) == sorted((float(apart[j]), j) for j in np.lexsort((np.arange(5000), apart)) if j != i)[:4]


@pytest.mark.parametrize(("gather_from", "gather_how", "scatter_to", "scatter_how"), [("both", "concat", "both", "concat"), ("senders", "sum", "both", "sum"), ("receivers", "concat", "receivers", "concat"), ("both", "sum", "senders", "sum")])
def test_mpnn_plus_against_numpy(spark, gather_from, gather_how, scatter_to, scatter_how):
    r = np.random.default_rng(7)
    n, x = 9, r.normal(size=(9, 2))
    ends = [(int(a), int(b)) for a, b in r.integers(0, 8, (25, 2))] + [(0, k) for k in range(8)]
    e = r.normal(size=(len(ends), 1))
    nodes = spark.createDataFrame([(1, i, [float(c) for c in x[i]]) for i in range(n)], "graph_id long, node_id int, x array<double>")
    edges = spark.createDataFrame([(1, a, b, [float(e[k, 0])]) for k, (a, b) in enumerate(ends)], "graph_id long, src int, dst int, e array<double>")
    parts = {"senders": lambda a, b: [x[a]], "receivers": lambda a, b: [x[b]], "both": lambda a, b: [x[a], x[b]]}[gather_from]
    made = []
    for k, (a, b) in enumerate(ends):
        both = parts(a, b)
        both = both[0] if len(both) == 1 else np.concatenate(both) if gather_how == "concat" else both[0] + both[1]
        made.append(np.concatenate([both, e[k]]))
    made = np.array(made)
    w = r.normal(size=(2, made.shape[1]))
    m = np.maximum(made @ w.T, 0)
    stats = {"sum": lambda v: v.sum(axis=0), "mean": lambda v: v.mean(axis=0), "min": lambda v: v.min(axis=0), "std": lambda v: np.sqrt(v.var(axis=0) + 1e-5)}
    want = {}
    for i in range(n):
        sides = []
        for s in {"senders": ["src"], "receivers": ["dst"], "both": ["dst", "src"]}[scatter_to]:
            own = m[[k for k, (a, b) in enumerate(ends) if (a if s == "src" else b) == i]]
            sides.append(np.concatenate([f(own) if len(own) else np.full(2, np.sqrt(1e-5) if name == "std" else 0) for name, f in stats.items()]))
        want[i] = sides[0] if len(sides) == 1 else np.concatenate(sides) if scatter_how == "concat" else sides[0] + sides[1]
    out = message.mpnn_plus(nodes, message.with_ends(edges, nodes, "x"), 2, edge_feature="e", edge_width=2, edge_model=lambda c: nn.linear(c, w.tolist(), None, "relu"), gather_from=gather_from, gather_how=gather_how, scatter_to=scatter_to, scatter_how=scatter_how, aggregators=tuple(stats))
    got = {g["node_id"]: g["h"] for g in out.collect()}
    assert len(got) == n and all(np.allclose(got[i], want[i], atol=1e-7) for i in range(n))


def test_mpnn_plus_plan_has_few_exchanges(spark):
    from tessera.plans import vector_queries

    plan = vector_queries.mpnn_vectors(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and plan.count("FileScan") <= 2
    with pytest.raises(ValueError, match="none of"):
        message.mpnn_plus(spark.range(1), spark.range(1), 1, gather_from="edges")
    with pytest.raises(ValueError, match="edge_width"):
        message.mpnn_plus(spark.range(1), spark.range(1), 1, edge_feature="e")


def test_ends_of_paths(spark):
    nodes = spark.createDataFrame([(1, i, [float(i)], "a" if i < 2 else "b") for i in range(4)], "graph_id long, node_id int, x array<double>, flag string")
    got = sorted((r["src"], r["dst"], r["x_src"][0], r["x_dst"][0], r["same_flag"]) for r in graphs.path_ends(nodes).collect())
    assert got == sorted((a, b, float(a), float(b), {a, b} != {1, 2}) for i in range(3) for a, b in ((i, i + 1), (i + 1, i)))


def _order_lines(spark):
    return spark.range(400).selectExpr("id div 4 AS l_orderkey", "int(id % 4) AS l_linenumber", "id AS l_partkey", "id AS l_suppkey", "double(id % 50) AS l_quantity", "2.0D AS l_extendedprice", "(id % 11) / 100D AS l_discount", "0.0D AS l_tax", "'A' AS l_returnflag")


def _plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


@pytest.mark.parametrize("name", ["mpnn_vectors", "mpnn_summed"])
def test_nodes_and_messages_meet_without_a_join(spark, tmp_path, capsys, name):
    """F11, F16"""
    _order_lines(spark).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert "Join" not in _plan(registry.queries()[name](spark, str(tmp_path)), capsys)


def test_edges_without_a_node_and_null_keys_change_no_node(spark):
    """F11, F16: only nodes come out, each once, and a null key meets nothing."""
    nodes = spark.createDataFrame([(1, 0, [1.0]), (1, 1, None), (None, 0, [2.0])], "graph_id long, node_id int, x array<double>")
    edges = spark.createDataFrame([(1, 0, 1, [3.0], [4.0]), (1, 7, 8, [3.0], [4.0]), (None, 0, 0, [3.0], [4.0])], "graph_id long, src int, dst int, x_src array<double>, x_dst array<double>")
    out = message.mpnn_plus(nodes, edges, 1, gather_from="senders", scatter_to="receivers", node_model=lambda v: v)
    assert sorted(((r.graph_id, r.node_id, r.h) for r in out.collect()), key=repr) == sorted([(1, 0, [1.0, 0.0]), (1, 1, None), (None, 0, [2.0, 0.0])], key=repr)


def test_fingerprint_stages_are_pooled_without_a_join(spark, tmp_path, capsys):
    """F20"""
    _order_lines(spark).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert "Join" not in _plan(registry.queries()["fingerprint_stages"](spark, str(tmp_path)), capsys)


def test_attention_sorts_nodes_not_pairs(spark, tmp_path, capsys):
    """no window stands above the join that makes the pairs."""
    _order_lines(spark).write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = _plan(registry.queries()["attention_single_head"](spark, str(tmp_path)), capsys)
    assert plan.index("Join") < plan.index("Window")


def test_attention_of_any_sign_equals_softmax(spark, tmp_path):
    """the largest score is that of an end also where discounts are below 0."""
    _order_lines(spark).withColumn("l_discount", F.expr("l_discount * 100 - 5")).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.graph_id, r.node_id): r.h for r in registry.queries()["attention_single_head"](spark, str(tmp_path)).collect()}
    d, q = [x % 11 - 5.0 for x in range(400)], [x % 50 for x in range(400)]
    for (g, i), h in got.items():
        s = np.array([10 * d[4 * g + i] * d[4 * g + j] for j in range(4)])
        w = np.exp(s - s.max())
        assert abs(h - (w * q[4 * g : 4 * g + 4]).sum() / w.sum()) < 1e-3
    assert len(got) == 400
