"""Packed batches: round trips, padding, limits, masks, and the estimate of the largest pack, against plain versions."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import collate, packed


@pytest.fixture(scope="module")
def tables(spark):
    r = np.random.default_rng(6)
    sizes = {g: int(r.integers(1, 9)) for g in range(40)}
    nodes = [(g, i, float(100 * g + i)) for g, n in sizes.items() for i in range(n)]
    edges = [(g, i, i + 1) for g, n in sizes.items() for i in range(n - 1)]
    frame = spark.createDataFrame(list(sizes.items()), "graph_id long, n long")
    packs = collate.pack_fast(frame, "graph_id", "n", 6, 3).select("graph_id", "n", "pack_id")
    return sizes, spark.createDataFrame(nodes, "graph_id long, node_id int, q double").repartition(3), spark.createDataFrame(edges, "graph_id long, src int, dst int").repartition(3), packs


def layout(packs):
    """graph -> (pack, start), by hand."""
    out, used = {}, {}
    for r in sorted(packs.collect(), key=lambda r: r["graph_id"]):
        out[r["graph_id"]] = (r["pack_id"], used.get(r["pack_id"], 0))
        used[r["pack_id"]] = used.get(r["pack_id"], 0) + r["n"]
    return out, used


def test_places_dense_packs_and_back(spark, tables):
    sizes, nodes, _, packs = tables
    at, used = layout(packs)
    got = packed.index(nodes, packs).collect()
    assert len(got) == sum(sizes.values()) and all((r["pack_id"], r["place"]) == (at[r["graph_id"]][0], at[r["graph_id"]][1] + r["node_id"]) for r in got)
    size = packed.largest(packs)
    assert size == max(used.values()) and packed.largest(packs, 10) % 10 == 0 and packed.largest(packs.limit(0)) == 0
    dense = packed.to_packed(packed.index(nodes, packs), ["q"], size, -5.0)
    rows = dense.collect()
    assert len(rows) == size * len(used) and sum(r["mask"] for r in rows) == sum(sizes.values()) and {r["q"] for r in rows if not r["mask"]} <= {-5.0}
    assert sorted(map(tuple, packed.from_packed(dense, ["q"]).collect())) == sorted(map(tuple, nodes.collect()))
    with pytest.raises(Exception, match="more than"):
        packed.to_packed(packed.index(nodes, packs), ["q"], size - 1).collect()
    with pytest.raises(Exception, match="beyond its graph"):
        packed.index(nodes, packs.withColumn("n", F.lit(1))).collect()


def test_dense_packs_look_no_slot_up_among_all_nodes(spark, tables):
    nodes, packs = tables[1], tables[3]
    placed = packed.index(nodes, packs)
    assert "element_at" not in packed.to_packed(placed, ["q"], 99)._jdf.queryExecution().optimizedPlan().toString()
    gaps = placed.where("place <> 2").collect()
    dense = {(r["pack_id"], r["slot"]): r for r in packed.to_packed(placed.where("place <> 2"), ["q"], 99, -5.0).collect()}
    assert len(dense) == 99 * 6 and sum(r["mask"] for r in dense.values()) == len(gaps)
    assert all(dense[r["pack_id"], r["place"]]["q"] == r["q"] for r in gaps) and all(dense[k, 2]["q"] == -5.0 for k in range(6))
    with pytest.raises(Exception, match="one place"):
        packed.to_packed(placed.union(placed), ["q"], 99).collect()


def test_masks_hide_other_graphs_only(spark, tables):
    sizes, _, _, packs = tables
    at, used = layout(packs)
    size = packed.largest(packs) + 3
    owner = {(p, s + i): g for g, (p, s) in at.items() for i in range(sizes[g])}
    rows = packed.attention_rows(packs, size).collect()
    assert len(rows) == sum(sizes.values())
    for r in rows:
        assert r["masked"] == [owner.get((r["pack_id"], j)) != owner[r["pack_id"], r["place"]] for j in range(size)]


def test_masks_run_no_function_a_slot(tables):
    """A row's mask is three runs of one value; a lambda over its slots would be interpreted for each of them."""
    assert "lambda" not in packed.attention_rows(tables[3], 64)._jdf.queryExecution().optimizedPlan().toString()


def test_combined_batches_are_padded_to_one_shape(spark, tables):
    sizes, nodes, edges, packs = tables
    at, used = layout(packs)
    labelled = packs.withColumn("y", F.col("graph_id") * 2.0).withColumn("tile", F.lit("x"))
    b = packed.combined(nodes, edges, labelled, ["q"], 60, 70, 9, ["y"], node_fill=-1.0)
    n, e, g = b.nodes.collect(), b.edges.collect(), b.graphs.collect()
    assert (len(n), len(e), len(g)) == (60 * len(used), 70 * len(used), 9 * len(used))
    assert {(r["pack_id"], r["place"], r["q"]) for r in n if r["node_is_true"]} == {(p, s + i, float(100 * k + i)) for k, (p, s) in at.items() for i in range(sizes[k])}
    assert all(r["q"] == -1 for r in n if not r["node_is_true"])
    assert sorted((r["pack_id"], r["src"], r["dst"]) for r in e if r["edge_is_true"]) == sorted((p, s + i, s + i + 1) for k, (p, s) in at.items() for i in range(sizes[k] - 1))
    assert all(r["src"] == r["dst"] == 59 for r in e if not r["edge_is_true"])
    assert {(r["pack_id"], r["graph_id"], r["n"], r["y"]) for r in g if r["graph_is_true"]} == {(at[k][0], k, sizes[k], 2.0 * k) for k in sizes}
    for p in used:
        own = [r for r in g if r["pack_id"] == p]
        assert sum(r["n"] for r in own) == 60 and sum(r["n"] > 0 and not r["graph_is_true"] for r in own) == 1 and all(r["y"] is None for r in own if not r["graph_is_true"])
    for limits, text in (((30, 70, 9), "nodes"), ((60, 20, 9), "edges"), ((60, 70, 5), "graphs"), ((packed.largest(packs), 70, 9), "no node for them")):
        with pytest.raises(Exception, match=text):
            short = packed.combined(nodes, edges, packs, ["q"], *limits)
            short.nodes.collect(), short.graphs.collect()
        if text != "nodes":
            with pytest.raises(Exception, match=text):
                short.edges.collect()
    alone = packed.combined(nodes.where("graph_id = 0"), edges.limit(0), packs.where("graph_id = 0"), ["q"], 10, 4, 2)
    assert alone.edges.count() == 4 and alone.graphs.count() == 2 and alone.nodes.where("node_is_true").count() == sizes[0]


def test_pair_rows_are_padded(spark):
    rows = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0]]), (2, [])], "k int, r array<array<double>>")
    got = {r["k"]: r["p"] for r in rows.select("k", packed.pad_pairs(F.col("r"), 3).alias("p")).collect()}
    assert got == {1: [[1.0, 2.0], [3.0, 4.0], [0.0, 0.0]], 2: [[], [], []]}
    with pytest.raises(Exception, match="more than 1 nodes"):
        rows.select(packed.pad_pairs(F.col("r"), 1)).collect()


def test_largest_pack_estimate_against_plain_version(spark):
    r = np.random.default_rng(9)
    sizes = [(k, int(v)) for k, v in enumerate(r.integers(1, 30, 150))]
    md5 = lambda *x: hashlib.md5("|".join(map(str, x)).encode()).hexdigest()
    want = {}
    for trial in range(3):
        order = sorted((md5(4, trial, k), k, n) for k, n in sizes)
        tops = []
        for a in range(0, len(order) - 39, 40):
            lot, total = sorted((n, k, t) for t, k, n in order[a : a + 40]), [0] * 5
            for s in range(0, 40, 5):
                for p, (_, _, n) in enumerate(sorted((md5(4, t), k, n) for n, k, t in lot[s : s + 5])):
                    total[p] += n
            tops.append(max(total))
        want[trial] = (len(tops), max(tops))
    got = packed.estimate_largest(spark.createDataFrame(sizes, "k long, n long"), "k", "n", 8, 40, 3, 4).collect()
    assert {r["trial"]: (r["n_batches"], r["largest"]) for r in got} == want
    assert packed.estimate_largest(spark.createDataFrame(sizes[:20], "k long, n long"), "k", "n", 8, 40, 3).count() == 0
    assert math.gcd(40, 8) == 8
    with pytest.raises(ValueError, match="whole number"):
        packed.estimate_largest(spark.createDataFrame(sizes, "k long, n long"), "k", "n", 7, 40, 3)
