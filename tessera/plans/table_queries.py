"""Queries over sources, joins between tables, dense encodings, packing, layers and windows of events, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import encodings, graphs, labels, nn, packs, positional
from tessera.plans.graph_queries import NODES
from tessera.plans.registry import query
from tessera.sources import readers, smiles
from tessera.streaming import events


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return readers.read_table(spark, f"{d}/{name}.parquet")


def _path_graphs(spark, d):
    nodes = graphs.order_nodes(_read(spark, d, "lineitem"))
    return nodes, graphs.path_steps(nodes)


_SIZE = f"{NODES}, n AS (SELECT *, CAST(count(*) OVER (PARTITION BY graph_id) AS DOUBLE) AS size FROM nodes)"
_K = "CASE WHEN size > {k} THEN round(2 - 2 * cos(pi() * {k} / size), 5) ELSE 0 END"


@query(f"WITH {_SIZE} SELECT graph_id, node_id, abs({_K.format(k=0)}) AS v0, {_K.format(k=1)} AS v1, {_K.format(k=2)} AS v2, {_K.format(k=3)} AS v3 FROM n")
def laplacian_eigvals_path(spark, d):
    """The four lowest eigenvalues; those of a path have the closed form 2 - 2 cos(pi k / n)."""
    pe = encodings.encode(*_path_graphs(spark, d), lambda a: encodings.laplacian_eigen(a, 4)[0])
    return pe.select("graph_id", "node_id", *[F.abs(F.round(F.col("pe")[k], 5)).alias(f"v{k}") for k in range(4)])


@query()
def laplacian_eigvecs(spark, d):
    pe = encodings.encode(*_path_graphs(spark, d), lambda a: encodings.laplacian_eigen(a, 3, "sym")[1])
    return pe.select("graph_id", "node_id", *[F.round(F.col("pe")[k], 4).alias(f"e{k}") for k in range(3)])


_PAIR = f"{_SIZE}, r AS (SELECT a.graph_id, a.node_id AS i, b.node_id AS j, a.size, abs(a.node_id - b.node_id) AS dist FROM n a JOIN n b ON a.graph_id = b.graph_id)"


@query(f"WITH {_PAIR} SELECT graph_id, i, j, round(2 * (size - 1) * dist, 5) AS v FROM r")
def commute_path(spark, d):
    return encodings.encode(*_path_graphs(spark, d), encodings.commute, "nodepair").withColumn("v", F.abs(F.round("v", 5)))


# in a path of n nodes, the hops from node i to all others are i (i + 1) / 2 to the left and (n - 1 - i) (n - i) / 2 to the right
_MEAN = "(({0} * ({0} + 1) + (size - 1 - {0}) * (size - {0})) / (2 * size))"


@query(f"WITH {_PAIR} SELECT graph_id, i, j, round(0.5::DOUBLE * ({_MEAN.format('i')} - {_MEAN.format('j')} - dist), 4) + 0.0 AS v FROM r")
def electrostatic_path(spark, d):
    out = encodings.encode(*_path_graphs(spark, d), encodings.electrostatic, "nodepair")
    return out.withColumn("v", F.round("v", 4) + F.lit(0.0))


@query(f"WITH {_PAIR} SELECT graph_id, i, j, CAST(dist AS DOUBLE) AS v FROM r")
def hops_dense(spark, d):
    return encodings.encode(*_path_graphs(spark, d), encodings.hops, "nodepair")


# powers 1, 2, 4, 8 of a path's walk; a graph of one node is always back
_WALK = f"""{_SIZE}, p AS (SELECT a.graph_id, a.node_id AS i, b.node_id AS j, 1.0::DOUBLE / CASE WHEN a.node_id IN (0, a.size - 1) THEN 1 ELSE 2 END AS p FROM n a JOIN n b ON a.graph_id = b.graph_id AND abs(a.node_id - b.node_id) = 1),
    p2 AS (SELECT a.graph_id, a.i, b.j, sum(a.p * b.p) AS p FROM p a JOIN p b ON a.graph_id = b.graph_id AND a.j = b.i GROUP BY ALL), p4 AS (SELECT a.graph_id, a.i, b.j, sum(a.p * b.p) AS p FROM p2 a JOIN p2 b ON a.graph_id = b.graph_id AND a.j = b.i GROUP BY ALL),
    p8 AS (SELECT a.graph_id, a.i, b.j, sum(a.p * b.p) AS p FROM p4 a JOIN p4 b ON a.graph_id = b.graph_id AND a.j = b.i GROUP BY ALL)"""
_BACK = "CASE WHEN n.size = 1 THEN 1.0 ELSE round(coalesce({0}.p, 0.0), 6) END AS {0}"


@query(f"""WITH {_WALK} SELECT n.graph_id, n.node_id, CASE WHEN n.size = 1 THEN 1.0 ELSE 0.0 END AS p1, {", ".join(_BACK.format(f"p{k}") for k in (2, 4, 8))} FROM n
    {" ".join(f"LEFT JOIN p{k} ON p{k}.graph_id = n.graph_id AND p{k}.i = n.node_id AND p{k}.j = n.node_id" for k in (2, 4, 8))}""")
def rw_return_dense(spark, d):
    pe = encodings.encode(*_path_graphs(spark, d), lambda a: encodings.walk_return(a, [1, 2, 4, 8]))
    return pe.select("graph_id", "node_id", *[F.round(F.col("pe")[k], 6).alias(f"p{s}") for k, s in enumerate((1, 2, 4, 8))])


@query(f"WITH {_WALK} SELECT graph_id, i, j, k, round(p, 6) AS p FROM (SELECT *, 1 AS k FROM p UNION ALL SELECT *, 2 FROM p2 UNION ALL SELECT *, 4 FROM p4 UNION ALL SELECT *, 8 FROM p8)")
def walk_power_series(spark, d):
    """Powers 1, 2, 4 and 8 of each graph's random walk from one gather, each continued from the one before."""
    return positional.walk_powers(*_path_graphs(spark, d), [1, 2, 4, 8]).withColumn("p", F.round("p", 6))


_ROWS = f"{_PAIR}, per AS (SELECT graph_id, i AS node_id, any_value(size) AS size, avg(dist) AS mean, stddev_pop(dist) AS std, sum(dist) AS total, max(dist) AS far, sum({_MEAN.format('i')} - {_MEAN.format('j')} - dist) AS charge FROM r GROUP BY ALL)"


@query(f"""WITH {_WALK}, {_ROWS.removeprefix(_SIZE + ", ")} SELECT n.graph_id, n.node_id, {", ".join(f"abs({_K.format(k=k)}) AS v{k}" for k in range(3)).replace("size", "n.size")}, {_BACK.format("p2")}, {_BACK.format("p4")},
        round(2 * (n.size - 1) * mean, 4) AS commute_mean, round(2 * (n.size - 1) * std, 4) AS commute_std, CAST(total AS DOUBLE) AS hops_total, CAST(far AS DOUBLE) AS hops_far, round(0.5::DOUBLE * charge, 4) + 0.0 AS charge FROM n JOIN per ON per.graph_id = n.graph_id AND per.node_id = n.node_id
    {" ".join(f"LEFT JOIN p{k} ON p{k}.graph_id = n.graph_id AND p{k}.i = n.node_id AND p{k}.j = n.node_id" for k in (2, 4))}""")
def positional_encodings(spark, d):
    """Five encodings from one gather a graph: eigenvalues, returns, commute times as node statistics, hops and electrostatics as rows of pairs."""
    specs = {
        "values": {"type": "laplacian_eigval", "num_pos": 3}, "back": {"type": "rw_return_probs", "ksteps": [2, 4]}, "commute": {"type": "commute", "level": "node"},
        "hops": {"type": "graphormer"}, "charge": {"type": "electrostatic"},
    }
    pe = positional.encode_all(*_path_graphs(spark, d), specs)
    row = lambda f: F.transform(f"pe.{f}", lambda x: F.get(x, F.lit(0)))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    at = lambda f, k: F.get(f"pe.{f}", F.lit(k))
    return pe.select(
        "graph_id", "node_id", *[F.abs(F.round(at("values", k), 5)).alias(f"v{k}") for k in range(3)], F.round(at("back", 0), 6).alias("p2"), F.round(at("back", 1), 6).alias("p4"),
        F.round(at("commute", 1), 4).alias("commute_mean"), F.round(at("commute", 2), 4).alias("commute_std"), total(row("hops")).alias("hops_total"), F.array_max(row("hops")).alias("hops_far"), (F.round(total(row("charge")), 4) + F.lit(0.0)).alias("charge"),
    )


def _packed(spark, d, how):
    sizes = _read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).withColumn("grp", F.floor(F.col("l_orderkey") / 512))
    return packs.pack(sizes, "grp", "l_orderkey", "n", 32, how)


@query()
def pack_smart(spark, d):
    return _packed(spark, d, "smart")


@query()
def pack_hybrid(spark, d):
    return _packed(spark, d, "hybrid")


@query("SELECT n_name, p_brand, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE p_name LIKE '%red%' AND p_type IS NOT NULL GROUP BY ALL")
def annotation_join(spark, d):
    """Assay rows with their annotations: small tables are broadcast by their size, filters reach the scans."""
    part = _read(spark, d, "part").where(F.col("p_name").contains("red") & F.col("p_type").isNotNull()).select("p_partkey", "p_brand")
    supplier = _read(spark, d, "supplier").join(_read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    rows = _read(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity").join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("n_name", "p_brand").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT a.l_partkey, a.n AS n_a, b.n AS n_b, c.n AS n_c FROM (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL) a JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL) b USING (l_partkey) JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) c USING (l_partkey)")
def multiway_common(spark, d):
    """Keys that all of several tables have, from one pass: a conditional count for each instead of a join for each."""
    one = lambda f: F.count_if(F.col("l_returnflag") == f).alias(f"n_{c[f]}")
    c = {"A": "a", "N": "b", "R": "c"}
    return _read(spark, d, "lineitem").groupBy("l_partkey").agg(*[one(f) for f in c]).where("n_a > 0 and n_b > 0 and n_c > 0")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def semi_join_common(spark, d):
    big = _read(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return _read(spark, d, "orders").select("o_orderkey").join(big, "o_orderkey", "left_semi")


@query("SELECT count(*) FILTER (s > 1) AS shared, count(*) AS keys FROM (SELECT doc_id, count(DISTINCT s) AS s FROM (SELECT doc_id, doc_id % 3 AS s FROM documents) GROUP BY doc_id)")
def splits_disjoint(spark, d):
    """How many keys are in more than one split: none where splits are disjoint."""
    per = _read(spark, d, "documents").select("doc_id", (F.col("doc_id") % 3).alias("s")).groupBy("doc_id").agg(F.countDistinct("s").alias("s"))
    return per.agg(F.count_if(F.col("s") > 1).alias("shared"), F.count("*").alias("keys"))


@query("SELECT p_partkey, c, v FROM (SELECT p_partkey, unnest(['p_partkey', 'p_retailprice', 'p_size']) AS c, unnest([CAST(p_partkey AS DOUBLE), p_retailprice, CAST(p_size AS DOUBLE)]) AS v FROM part) WHERE c <> 'p_partkey'")
def wildcard_label_columns(spark, d):
    part = _read(spark, d, "part")
    chosen = readers.choose_columns(part.columns, ["*price", "p_siz*"])
    return part.select("p_partkey", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in chosen])).alias("x")).select("p_partkey", "x.*")


@query("SELECT r.r_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region r ON r_regionkey = n_regionkey GROUP BY ALL UNION ALL SELECT r.r_name || '*', count(*) FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region r ON r_regionkey = n_regionkey GROUP BY ALL")
def multi_file_union(spark, d):
    places = _read(spark, d, "nation").join(_read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    rows = _read(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("").alias("mark")).unionByName(_read(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("*").alias("mark")))
    return rows.join(places, F.col("k") == F.col("n_nationkey")).groupBy(F.concat("r_name", "mark").alias("r_name")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_labels(spark, d):
    return _read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT vec_id, round(greatest(0.5::DOUBLE * embedding[1] - 0.25::DOUBLE * embedding[2] + 0.1::DOUBLE, 0), 5) AS h0, round(greatest(embedding[3] + CAST(embedding[4] AS DOUBLE) - 0.2::DOUBLE, 0), 5) AS h1 FROM embeddings")
def fc_layer_tiny(spark, d):
    h = nn.linear(F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, 4), [[0.5, -0.25, 0, 0], [0, 0, 1, 1]], [0.1, -0.2], "relu")
    return _read(spark, d, "embeddings").select("vec_id", *[F.round(h[k], 5).alias(f"h{k}") for k in range(2)])


@query("SELECT epoch, round(CASE WHEN epoch < 10 THEN 0.001::DOUBLE * epoch / 10 ELSE 0.001::DOUBLE * greatest(100 - epoch, 0) / 90 END, 9) AS lr FROM range(0, 101) t(epoch)")
def warmup_lr_schedule(spark, d):
    return spark.range(101).select(F.col("id").alias("epoch"), F.round(nn.warmup_lr(F.col("id"), 0.001, 10, 100), 9).alias("lr"))


@query("SELECT graph_id, v FROM (SELECT l_orderkey AS graph_id, round(sum(l_quantity), 4) AS v FROM lineitem GROUP BY ALL UNION ALL SELECT l_orderkey, round(avg(l_discount), 9) FROM lineitem GROUP BY ALL)")
def encoder_pool_concat(spark, d):
    """Outputs of two encoders under one key, a row each."""
    g = _read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("graph_id")).agg(F.round(F.sum("l_quantity"), 4).alias("a"), F.round(F.avg("l_discount"), 9).alias("b"))
    return g.select("graph_id", F.explode(F.array("a", "b")).alias("v"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, d):
    """Batch form of the windowed stream (the tests run both)."""
    return events.windowed(_read(spark, d, "events")).withColumn("total", F.round("total", 2))


@query()
def smiles_featurize(spark, d):
    """A few molecules through the parser, whatever the tables hold: SMILES are not among them."""
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(("C1=CC=CC=C1", "CC(=O)O", "[NH4+].[Cl-]", "c1ccc2ccccc2c1", "XXX"))], "row_id long, SMILES string")
    return smiles.with_graphs(rows, "SMILES").select("row_id", "SMILES", "error", "num_nodes", F.size("bonds").alias("n_bonds"), F.expr("aggregate(atoms, 0, (a, x) -> a + x.hydrogens)").alias("hydrogens"))


@query("SELECT l_suppkey, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r = 1")
def first_row_survivors(spark, d):
    return labels.keep(_read(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_orderkey", "l_linenumber"), ["l_suppkey"], [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]).select("l_suppkey", "l_partkey", "l_quantity")
