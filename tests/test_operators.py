"""Operators on small hand-made tables: named graphs, missing values, ties, errors, round trips, streams."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import metrics, nanstats
from tessera.operators import collate, encodings, graphs, labels, message, nn, packs, pairs, splits
from tessera.sources import readers, sdf, smiles
from tessera.streaming import events

NAMED = {
    "ring": (6, [(k, (k + 1) % 6) for k in range(6)], 3), "path": (5, [(k, k + 1) for k in range(4)], 4), "clique": (4, [(a, b) for a in range(4) for b in range(a)], 1),
    "barbell": (8, [(a, b) for s in (0, 4) for a in range(s, s + 4) for b in range(s, a)] + [(3, 4)], 3),
}


def dense(name):
    n, e, _ = NAMED[name]
    return encodings.adjacency(n, np.array([a for a, _ in e] + [b for _, b in e]), np.array([b for _, b in e] + [a for a, _ in e]))


@pytest.mark.parametrize("name", NAMED)
def test_encodings_of_named_graphs(name):
    a, longest = dense(name), NAMED[name][2]
    h, c, e = encodings.hops(a), encodings.commute(a), encodings.electrostatic(a)
    assert h.max() == longest and (h == h.T).all() and np.allclose(c, c.T) and np.allclose(np.diag(e), 0)
    p = encodings.normalised(a, a, "inv")
    for k in (2, 4, 6):
        q = np.linalg.matrix_power(p, k)
        assert np.allclose(q.sum(axis=1), 1) and q.min() >= -1e-12
    assert np.allclose(encodings.walk_return(a, [2, 4])[:, 0], np.diag(p @ p))


def test_disconnected_graphs():
    two = np.zeros((6, 6))
    for s in (0, 3):
        two[s : s + 3, s : s + 3] = 1 - np.eye(3)
    full = 1 - np.eye(6)
    assert np.allclose(2 * encodings.laplacian_eigen(two, 3)[0], encodings.laplacian_eigen(full, 3)[0])
    assert np.isnan(encodings.hops(two)[0, 4]) and encodings.components(two).tolist() == [0, 0, 0, 3, 3, 3]
    assert encodings.walk_return(np.zeros((1, 1)), [1, 2]).tolist() == [[1, 1]]
    with pytest.raises(ValueError):
        encodings.normalised(two, two, "other")


@pytest.fixture(scope="module")
def named(spark):
    nodes, edges = [], []
    for g, (n, e, _) in enumerate(NAMED.values()):
        nodes += [(g, k, float(k * k % 7)) for k in range(n)]
        edges += [(g, a, b) for a, b in e] + [(g, b, a) for a, b in e]
    nodes += [(9, 0, 3.0)]
    return spark.createDataFrame(nodes, "graph_id long, node_id int, q double"), spark.createDataFrame(edges, "graph_id long, src int, dst int")


def test_encode_and_frontier_joins_agree(named):
    nodes, edges = named
    want = {(r["graph_id"], r["i"], r["j"]): r["v"] for r in encodings.encode(nodes, edges, encodings.hops, "nodepair").collect()}
    got = {(r["graph_id"], r["i"], r["j"]): r["hops"] for r in pairs.hop_distance(nodes, edges, 4).collect()}
    assert got == want
    walk = {(r["graph_id"], r["i"]): r["p"] for r in pairs.walk(edges, nodes, 2).where("i = j").collect()}
    pe = {(r["graph_id"], r["node_id"]): r["pe"][0] for r in encodings.encode(nodes, edges, lambda a: encodings.walk_return(a, [2])).collect()}
    assert all(abs(walk[k] - pe[k]) < 1e-9 for k in walk) and pe[9, 0] == 1
    with pytest.raises(Exception, match="more than 3 nodes"):
        encodings.encode(nodes, edges, encodings.hops, "nodepair", max_nodes=3).collect()


def test_message_passing_against_matrices(named):
    nodes, edges = named
    x = {(r["graph_id"], r["node_id"]): r["q"] for r in nodes.collect()}
    near = {}
    for r in edges.collect():
        near.setdefault((r["graph_id"], r["dst"]), []).append(x[r["graph_id"], r["src"]])
    h = {(r["graph_id"], r["node_id"]): r["h"] for r in message.gcn(nodes, edges).collect()}
    assert h == {k: sum(near.get(k, [])) for k in x} and h[9, 0] == 0
    p = {(r["graph_id"], r["node_id"]): r for r in message.pna(nodes, edges, scalers=("identity", "linear")).collect()}
    for k in x:
        v = near.get(k, [])
        assert abs(p[k]["mean"] - (np.mean(v) if v else 0)) < 1e-9 and abs(p[k]["var"] - (np.var(v) if v else 0)) < 1e-9
        assert abs(p[k]["max_linear"] - (max(v) if v else 0) * max(len(v), 1)) < 1e-9
    got = {(r["graph_id"], r["k"], r["j"], r["i"]) for r in message.triplets(edges).collect()}
    e = {(r["graph_id"], r["src"], r["dst"]) for r in edges.collect()}
    assert got == {(g, a, b, d) for g, a, b in e for h_, c, d in e if g == h_ and b == c and a != d}
    with pytest.raises(ValueError):
        message.aggregator("mode", F.col("q"))


def test_level_transfers(named):
    nodes, edges = named
    direct = sorted(tuple(r) for r in pairs.node_to_edge(nodes, edges, "q").select("graph_id", "src", "dst", "apart").collect())
    through = sorted(tuple(r) for r in pairs.nodepair_to_edge(pairs.node_to_nodepair(nodes, "q"), edges, "apart").collect())
    assert direct == through
    for a, b in (("node", "graph"), ("edge", "node"), ("edge", "graph"), ("nodepair", "graph")):
        with pytest.raises(NotImplementedError):
            graphs.transfer(a, b)
    with pytest.raises(ValueError):
        graphs.transfer("atom", "node")


def test_nan_statistics(spark):
    rows = [("odd", x) for x in (3.0, 1.0, 2.0, math.nan)] + [("even", x) for x in (1.0, 2.0, 3.0, 10.0)] + [("one", 5.0)] + [("none", math.nan)]
    x = F.col("x")
    out = {r["k"]: r for r in spark.createDataFrame(rows, "k string, x double").groupBy("k").agg(nanstats.nan_mean(x).alias("mean"), nanstats.nan_median("x").alias("median"), nanstats.nan_var(x).alias("var"), nanstats.nan_count(x).alias("n")).collect()}
    assert out["odd"]["mean"] == 2 and out["odd"]["median"] == 2 and out["even"]["median"] == 2 and out["one"]["var"] is None and out["none"]["mean"] is None and out["none"]["n"] == 0
    with pytest.raises(Exception, match="NaN"):
        spark.createDataFrame(rows, "k string, x double").select(nanstats.mask_non_finite(x, "raise")).collect()
    assert spark.createDataFrame(rows, "k string, x double").select(nanstats.mask_non_finite(x, 0.0).alias("x")).where(F.isnan("x")).count() == 0


def test_metrics_with_ties_and_missing_targets(spark):
    r = random.Random(3)
    rows = [(k, r.randint(0, 9) / 10, r.choice([0.0, 1.0, None, math.nan])) for k in range(200)]
    df = spark.createDataFrame(rows, "row_id long, pred double, target double")
    known = [(p, t) for _, p, t in rows if t is not None and not math.isnan(t)]
    pos, neg = [p for p, t in known if t == 1], [p for p, t in known if t == 0]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    ok = metrics.present(df)
    assert ok.count() == len(known) and abs(metrics.auroc(ok).first()["auroc"] - want) < 1e-12
    ap, tp, last = 0.0, 0, 0
    for s in sorted({p for p, _ in known}, reverse=True):
        tp += sum(p == s and t == 1 for p, t in known)
        seen = sum(p >= s for p, _ in known)
        ap, last = ap + (tp - last) / len(pos) * tp / seen, tp
    assert abs(metrics.average_precision(ok).first()["ap"] - ap) < 1e-12
    assert metrics.present(df, 1.5).where("target = 1.5").count() == 200 - len(known)
    assert df.select(metrics.threshold(F.col("target"), 0.5).alias("x")).where("x is null").count() == sum(t is None for _, _, t in rows)
    with pytest.raises(ValueError):
        metrics.hybrid_ce(F.array(), F.lit(0), 3, alpha=2)


def test_multitask_cases(spark):
    t = lambda ids, base: spark.createDataFrame([(k, i, float(base + k)) for k, i in enumerate(ids)], "row_ord long, mol_id string, label double")
    same = labels.merge_tasks({"a": t("wxyz", 0), "b": t("wxyz", 10), "c": t("wxyz", 20)})
    assert same.count() == 4
    apart = labels.merge_tasks({"a": t([str(k) for k in range(200)], 0), "b": t([str(k) for k in range(200, 400)], 0), "c": t([str(k) for k in range(400, 750)], 0)})
    assert apart.count() == 750
    part = {r["mol_id"]: r for r in labels.merge_tasks({"a": t("0123", 0), "b": t("1234", 10), "c": t("345", 20)}).collect()}
    assert len(part) == 6 and part["0"]["b"] is None and part["3"]["c"] == 20
    again = labels.merge_tasks({"a": t(["x", "x", None], 0)}).collect()
    assert [(r["mol_id"], r["a"], r["n_rows"]) for r in again] == [("x", 1.0, 2)]


def test_labels(spark):
    one = spark.range(1)
    v = lambda c: one.select(c.alias("v")).first()["v"]
    d = lambda *x: F.array(*[F.lit(y).cast("double") for y in x])
    assert v(labels.padded(d(1, 2), 4)) == [1, 2, None, None] and v(labels.padded(d(1, 2, 3), 2)) == [1, 2] and v(labels.padded(F.lit(None).cast("array<double>"), 1)) == [None]
    assert v(labels.fits(d(1, None), F.lit(5))) and not v(labels.fits(d(1, 2), F.lit(5)))
    assert v(labels.one_of_k(F.lit("z"), ["a", "b"])) == [0, 0, 1] and v(labels.one_of_k(F.lit("b"), ["a", "b"])) == [0, 1, 0]
    assert [v(labels.bucket(F.lit(x), [-6, -3, 3, 6])) for x in (-9, -6, -5, 0, 3, 4, 7)] == [0, 0, 1, 2, 2, 3, 4]
    with pytest.raises(ValueError):
        labels.normalised(F.lit(1), {}, "other")


def test_splits(spark):
    rows = spark.range(100).withColumnRenamed("id", "k")
    out = splits.random_split(rows, "k", 0.2, 0.2, 19)
    assert {r["split"]: r["n"] for r in out.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 60, "val": 20, "test": 20}
    assert sorted(r["k"] for r in out.collect()) == list(range(100)) and sorted(map(tuple, out.collect())) == sorted(map(tuple, splits.random_split(rows.repartition(7), "k", 0.2, 0.2, 19).collect()))
    assert splits.sub_sample(rows, 10, "k").count() == 10 and splits.sub_sample(rows, 0.25, "k").count() == 25 and splits.sub_sample(rows, 500, "k").count() == 100 and splits.sub_sample(rows, None, "k") is rows
    with pytest.raises(ValueError):
        splits.sub_sample(rows, "ten", "k")
    wide = spark.createDataFrame([(0, 8.0, 9.0), (1, math.nan, None), (2, None, None)], "train int, val double, test double")
    assert {(r["k"], r["split"]) for r in splits.file_split(rows, wide, "k").collect()} == {(0, "train"), (1, "train"), (2, "train"), (8, "val"), (9, "test")}
    seen = splits.split_unseen(rows, spark.createDataFrame([(5,), (5,)], "k long"), "k", 0.1, 0.1)
    assert seen.where("split = 'test_seen'").count() == 1 and seen.count() == 100


def test_packing():
    rng = np.random.default_rng(0)
    for n, packs_ in ((64, 8), (130, 16), (7, 7), (50, 4)):
        sizes = np.abs(rng.gamma(2, 20, n)).astype(int)
        for how in (packs.smart, packs.fast, packs.hybrid):
            pack = how(sizes, packs_)
            count = np.bincount(pack, minlength=packs_)
            assert len(pack) == n and count.max() - count.min() <= 2
        spread = np.bincount(packs.smart(sizes, packs_), weights=sizes, minlength=packs_)
        dealt = np.bincount(rng.permutation(np.arange(n) % packs_), weights=sizes, minlength=packs_)
        assert spread.max() <= dealt.max() + sizes.max() * 0.2


def test_numbering_is_total(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1009).alias("k"), F.lit(1).alias("n"))
    got = [r["k"] for r in collate.batched(rows, "k", 64, "n").orderBy("rn").collect()]
    assert got == sorted(got) and len(got) == 1000
    with pytest.raises(Exception, match="more than 5 nodes"):
        collate.filler(rows.select(F.lit(1).alias("p")), "p", 5).collect()


def test_layers(spark):
    rng = np.random.default_rng(1)
    w, b = rng.normal(size=(3, 4)), rng.normal(size=3)
    rows = spark.createDataFrame([(k, rng.normal(size=4).tolist()) for k in range(20)] + [(20, None)], "k long, x array<double>")
    wide = {r["k"]: r["y"] for r in nn.mlp(rows, "x", [(w, b, "silu")], "y").collect()}
    small = {r["k"]: r["y"] for r in rows.where("x is not null").select("k", nn.linear(F.col("x"), w.tolist(), b.tolist(), "silu").alias("y")).collect()}
    assert wide[20] is None and all(np.allclose(wide[k], small[k]) for k in small)
    members = [(rng.normal(size=(2, 4)).tolist(), [0.0, 1.0]) for _ in range(3)]
    got = {(r["k"], r["slot"]): r["v"] for r in nn.ensemble(rows.where("k < 5"), "k", "x", members).collect()}
    x = {r["k"]: np.array(r["x"]) for r in rows.where("k < 5").collect()}
    assert all(abs(v - np.mean([np.array(m) @ x[k] + np.array(c) for m, c in members], axis=0)[s]) < 1e-9 for (k, s), v in got.items())
    with pytest.raises(ValueError):
        nn.activation("nope")


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([(f"C{k}", k / 2, k) for k in range(10)], "SMILES string, SA double, idx int").coalesce(1)
    for k in (1, 2):
        rows.write.option("header", True).csv(f"{tmp_path}/shard_{k}.csv")
        rows.write.option("header", True).option("sep", "\t").csv(f"{tmp_path}/shard_{k}.tsv")
        rows.write.parquet(f"{tmp_path}/shard_{k}.parquet")
    for kind in ("csv", "tsv", "parquet"):
        got = readers.read_table(spark, f"{tmp_path}/shard_*.{kind}", columns=["SMILES", "SA"])
        assert got.count() == 20 and got.distinct().count() == 10 and readers.columns_of(spark, f"{tmp_path}/shard_1.{kind}") == rows.columns
    with pytest.raises(FileNotFoundError):
        readers.read_table(spark, f"{tmp_path}/none_*.csv")
    with pytest.raises(ValueError):
        readers.read_table(spark, f"{tmp_path}/shard_1.csv", columns=["nope"])
    rows.drop("idx").write.parquet(f"{tmp_path}/shard_3.parquet")
    with pytest.raises(ValueError):
        readers.read_table(spark, f"{tmp_path}/shard_*.parquet")
    assert readers.choose_columns(["a_x", "b_x", "c"], ["*_x"]) == ["a_x", "b_x"] and readers.choose_columns(["a", "b"], None, "b") == ["a"]
    assert readers.smiles_column(["id", "my_SMILES"]) == "my_SMILES" and readers.format_of("x.csv.gz") == "csv"
    built = []
    for _ in range(2):
        out = readers.cached(spark, f"{tmp_path}/kept", {"a": 1}, lambda: built.append(1) or rows)
    assert out.count() == 10 and len(built) == 1


def test_smiles(spark):
    atoms, bonds = smiles.parse("c1ccccc1")
    assert len(atoms) == 6 and len(bonds) == 6 and {o for _, _, o in bonds} == {1.5} and {a["hydrogens"] for a in atoms} == {1}
    atoms, bonds = smiles.parse("CC(=O)[O-]")
    assert [a["charge"] for a in atoms] == [0, 0, 0, -1] and [a["hydrogens"] for a in atoms] == [3, 0, 0, 0]
    assert len(smiles.parse("C%10CC%10")[1]) == 3 and smiles.in_ring(4, smiles.parse("C1CC1C")[1]) == [True, True, True, False]
    for bad in ("", "XXX", "C(", "C1CC", "C)", "[C", "C=", "1CC"):
        with pytest.raises(ValueError):
            smiles.parse(bad)
    ids = [smiles.canonical_id(*smiles.parse(s)) for s in ("OCC", "CCO", "C(C)O", "CCN")]
    assert len(set(ids[:3])) == 1 and ids[3] != ids[0]
    rows = spark.createDataFrame([(0, "CCO"), (1, None), (2, "XXX"), (3, "CCO")], "k long, s2 string")
    got = {r["k"]: r for r in smiles.with_graphs(rows, "s2").collect()}
    assert got[0]["num_nodes"] == 3 and got[1]["error"] == "no string" and got[2]["mol_id"] is None and got[3]["mol_id"] == got[0]["mol_id"]
    edges = smiles.directed_edges(smiles.with_graphs(rows.where("k = 0"), "s2"), "k").orderBy("edge_id").collect()
    assert [(e["edge_id"], e["src"], e["dst"]) for e in edges] == [(0, 0, 1), (1, 1, 0), (2, 1, 2), (3, 2, 1)]
    with pytest.raises(Exception):
        smiles.with_graphs(rows, "s2", "raise").collect()


def test_sdf(spark, tmp_path):
    block = "water\n  x\n\n  3  2  0  0  0  0  0  0  0  0999 V2000\n" + "".join(f"{x:10.4f}{0:10.4f}{0:10.4f} {s:<3} 0  0\n" for x, s in ((0, "O"), (1, "H"), (-1, "H"))) + "  1  2  1\n  1  3  1\nM  END\n> <score>\n1.5\n\n"
    (tmp_path / "a.sdf").write_text(block + "$$$$\n" + "broken\n\n\nxx\n$$$$\n")
    got = {r["name"]: r for r in sdf.read_sdf(spark, str(tmp_path / "a.sdf")).collect()}
    assert got["water"]["symbols"] == ["O", "H", "H"] and got["water"]["positions"][1][0] == 1 and got["water"]["properties"] == {"score": "1.5"} and got["broken"]["error"]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"2024-01-0{1 + k % 3} 0{k % 9}:00:00", k % 5, "ab"[k % 2], float(k)) for k in range(200)], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    rows.repartition(4).write.parquet(f"{tmp_path}/e")
    got = events.drained(events.windowed(events.event_stream(spark, f"{tmp_path}/e")), "tumbling", f"{tmp_path}/c")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, events.windowed(rows).collect()))
