"""Queries over order graphs (an order's line items in a path) and over points from the embeddings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import graphs, message, pairs, pooling
from tessera.plans.registry import query

NODES = """nodes AS (SELECT l_orderkey AS graph_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) - 1 AS node_id,
    l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_tax AS t, l_returnflag AS flag FROM lineitem)"""
EDGES = f"""{NODES}, beside AS (SELECT *, lead(node_id) OVER w AS n1, lead(q) OVER w AS q1, lead(t) OVER w AS t1, lead(flag) OVER w AS f1, lag(node_id) OVER w AS n0, lag(q) OVER w AS q0, lag(t) OVER w AS t0, lag(flag) OVER w AS f0
      FROM nodes WINDOW w AS (PARTITION BY graph_id ORDER BY node_id)),
    edges AS (SELECT graph_id, node_id AS src, n1 AS dst, q AS q_src, d AS d_src, q1 AS q_dst, t1 AS t_dst, flag = f1 AS same_flag FROM beside WHERE n1 IS NOT NULL
      UNION ALL SELECT graph_id, node_id, n0, q, d, q0, t0, flag = f0 FROM beside WHERE n0 IS NOT NULL)"""
PAIRS = f"""{NODES}, pairs AS (SELECT a.graph_id, a.node_id AS i, b.node_id AS j, a.q + b.q AS total, abs(a.q - b.q) AS apart FROM nodes a JOIN nodes b ON a.graph_id = b.graph_id)"""
POINTS = """points AS (SELECT label AS graph_id, vec_id AS node_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"""


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return graphs.order_nodes(_read(spark, d, "lineitem"))


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes = _nodes(spark, d)
    return nodes, graphs.path_edges(nodes)


def _points(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return _read(spark, d, "embeddings").select(F.col("label").alias("graph_id"), F.col("vec_id").alias("node_id"), *[e[k].cast("double").alias(c) for k, c in enumerate("xyz")])


def _r(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"""WITH {EDGES}, h AS (SELECT n.graph_id, n.node_id, coalesce(sum(e.q_src), 0.0) AS h FROM nodes n LEFT JOIN edges e ON e.graph_id = n.graph_id AND e.dst = n.node_id GROUP BY ALL)
    SELECT h.graph_id, CAST(count(*) AS BIGINT) AS n_nodes, round(sum(h), 4) AS h_sum, round(avg(h), 4) AS h_mean, round(avg(h) * ln(count(*)), 4) AS h_logsum,
        round(sqrt(greatest(avg(h * h) - avg(h) * avg(h), 0) + 1e-5), 4) AS h_std, any_value(o_totalprice) AS label FROM h JOIN orders ON o_orderkey = h.graph_id GROUP BY h.graph_id""")
def order_graph_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: message passing, pooling, and the graph's label."""
    h = message.gcn(*_both(spark, d))
    out = h.groupBy("graph_id").agg(F.count("*").alias("n_nodes"), *[message.aggregator(k, F.col("h")).alias(f"h_{k}") for k in ("sum", "mean", "std")], (F.avg("h") * F.log(F.count("*"))).alias("h_logsum"))
    labels = _read(spark, d, "orders").select(F.col("o_orderkey").alias("graph_id"), F.col("o_totalprice").alias("label"))
    return _r(out.join(labels, "graph_id"), 4, "h_sum", "h_mean", "h_std", "h_logsum")


@query(f"WITH {EDGES} SELECT n.graph_id, n.node_id, round(coalesce(sum(e.q_src), 0.0), 4) AS h FROM nodes n LEFT JOIN edges e ON e.graph_id = n.graph_id AND e.dst = n.node_id GROUP BY ALL")
def gcn_sum(spark, d):
    return _r(message.gcn(*_both(spark, d)), 4, "h")


@query(f"WITH {EDGES} SELECT n.graph_id, n.node_id, round(any_value(n.q) + coalesce(sum(e.q_src), 0.0), 4) AS h FROM nodes n LEFT JOIN edges e ON e.graph_id = n.graph_id AND e.dst = n.node_id GROUP BY n.graph_id, n.node_id")
def gin_sum(spark, d):
    return _r(message.gin(*_both(spark, d)), 4, "h")


@query(f"WITH {EDGES} SELECT n.graph_id, n.node_id, round(any_value(n.q) + coalesce(sum(greatest(e.q_src - 100 * e.d_src, 0.0)), 0.0), 4) AS h FROM nodes n LEFT JOIN edges e ON e.graph_id = n.graph_id AND e.dst = n.node_id GROUP BY n.graph_id, n.node_id")
def gine_relu_sum(spark, d):
    return _r(message.gine(*_both(spark, d), edge_value=-100 * F.col("d_src")), 4, "h")


@query(f"""WITH {EDGES}, g AS (SELECT *, 1 / (1 + exp(-(0.02::DOUBLE * q_dst + 0.03::DOUBLE * q_src + CAST(same_flag AS DOUBLE)))) AS s FROM edges)
    SELECT n.graph_id, n.node_id, round(any_value(n.q) + coalesce(sum(s * q_src) / (sum(s) + 1e-5), 0.0), 4) AS h FROM nodes n LEFT JOIN g ON g.graph_id = n.graph_id AND g.dst = n.node_id GROUP BY n.graph_id, n.node_id""")
def gated_mean(spark, d):
    return _r(message.gated(*_both(spark, d)), 4, "h")


_PNA = """coalesce(sum(q_src), 0.0) AS s, coalesce(avg(q_src), 0.0) AS m, coalesce(min(q_src), 0.0) AS lo, coalesce(max(q_src), 0.0) AS hi, coalesce(greatest(avg(q_src * q_src) - avg(q_src) * avg(q_src), 0.0), 0.0) AS v, greatest(count(q_src), 1) AS deg"""


@query(f"""WITH {EDGES}, a AS (SELECT n.graph_id, n.node_id, {_PNA} FROM nodes n LEFT JOIN edges e ON e.graph_id = n.graph_id AND e.dst = n.node_id GROUP BY n.graph_id, n.node_id)
    SELECT graph_id, node_id, round(s, 4) AS sum, round(m, 4) AS mean, round(lo, 4) AS min, round(hi, 4) AS max, round(v, 4) AS var, round(sqrt(v + 1e-5), 4) AS std FROM a""")
def pna_multi_agg(spark, d):
    return _r(message.pna(*_both(spark, d)), 4, *message.AGGREGATORS)


@query(f"""WITH {EDGES}, a AS (SELECT n.graph_id, n.node_id, {_PNA} FROM nodes n LEFT JOIN edges e ON e.graph_id = n.graph_id AND e.dst = n.node_id GROUP BY n.graph_id, n.node_id)
    SELECT graph_id, node_id, round(m * ln(deg + 1) / 1.5::DOUBLE, 4) AS mean_amplification, round(m * 1.5::DOUBLE / ln(deg + 1), 4) AS mean_attenuation, round(m * deg / 2.0::DOUBLE, 4) AS mean_linear, round(m * 2.0::DOUBLE / deg, 4) AS mean_inverse_linear FROM a""")
def pna_scaled(spark, d):
    out = message.pna(*_both(spark, d), aggregators=("mean",), scalers=message.SCALERS[1:], avg_log=1.5, avg_deg=2.0)
    return _r(out, 4, *[f"mean_{s}" for s in message.SCALERS[1:]])


@query(f"""WITH {EDGES}, m AS (SELECT graph_id, src, dst, abs(q_src - q_dst) + q_src AS m FROM edges), r AS (SELECT graph_id, dst AS node_id, sum(m) AS v FROM m GROUP BY ALL), s AS (SELECT graph_id, src AS node_id, sum(m) AS v FROM m GROUP BY ALL)
    SELECT n.graph_id, n.node_id, round(coalesce(r.v, 0.0), 4) AS at_receiver, round(coalesce(s.v, 0.0), 4) AS at_sender FROM nodes n LEFT JOIN r USING (graph_id, node_id) LEFT JOIN s USING (graph_id, node_id)""")
def mpnn_both_dirs(spark, d):
    return _r(message.mpnn(*_both(spark, d)), 4, "at_receiver", "at_sender")


@query(f"WITH {NODES} SELECT graph_id, node_id, round(q + sum(q) OVER (PARTITION BY graph_id), 4) AS h FROM nodes")
def virtual_node_broadcast(spark, d):
    return _r(pooling.virtual_node(_nodes(spark, d), "q"), 4, "h")


@query("SELECT l_orderkey AS graph_id, round(sum(l_extendedprice), 2) AS sum, round(avg(l_extendedprice), 6) AS mean, max(l_extendedprice) AS max, min(l_extendedprice) AS min FROM lineitem GROUP BY ALL")
def pool_sum_mean_max_min(spark, d):
    rows = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("graph_id"), "l_extendedprice")
    return _r(_r(pooling.pool(rows, "l_extendedprice", ("sum", "mean", "max", "min")), 2, "sum"), 6, "mean")


@query("SELECT l_orderkey AS graph_id, round(avg(l_quantity) * ln(count(*)), 4) AS logsum FROM lineitem GROUP BY ALL")
def pool_logsum(spark, d):
    return _r(pooling.pool(_read(spark, d, "lineitem").select(F.col("l_orderkey").alias("graph_id"), "l_quantity"), "l_quantity", ("logsum",)), 4, "logsum")


@query("SELECT l_orderkey AS graph_id, round(sqrt(greatest(avg(l_quantity * l_quantity) - avg(l_quantity) * avg(l_quantity), 0.0) + 1e-5), 4) AS std FROM lineitem GROUP BY ALL")
def pool_std(spark, d):
    return _r(pooling.pool(_read(spark, d, "lineitem").select(F.col("l_orderkey").alias("graph_id"), "l_quantity"), "l_quantity", ("std",)), 4, "std")


@query(f"WITH {EDGES} SELECT graph_id, round(sum(abs(q_src - q_dst)), 4) AS sum, round(avg(abs(q_src - q_dst)), 4) AS mean FROM edges GROUP BY ALL")
def edge_pool(spark, d):
    _, edges = _both(spark, d)
    return _r(pooling.pool(edges.select("graph_id", F.abs(F.col("q_src") - F.col("q_dst")).alias("v")), "v", ("sum", "mean")), 4, "sum", "mean")


@query("""WITH per AS (SELECT o_orderkey, count(l_orderkey) AS n, greatest(2 * (count(l_orderkey) - 1), 0) AS e FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)
    SELECT count(*) AS num_graphs, CAST(sum(n) AS BIGINT) AS total_nodes, min(n) AS min_nodes, max(n) AS max_nodes, round(avg(n), 6) AS mean_nodes, round(stddev_pop(n), 6) AS std_nodes,
        CAST(sum(e) AS BIGINT) AS total_edges, min(e) AS min_edges, max(e) AS max_edges, round(avg(e), 6) AS mean_edges, round(stddev_pop(e), 6) AS std_edges FROM per""")
def graph_stats(spark, d):
    nodes, edges = _both(spark, d)
    return _r(pooling.statistics(_read(spark, d, "orders").select(F.col("o_orderkey").alias("graph_id")), nodes, edges), 6, "mean_nodes", "std_nodes", "mean_edges", "std_edges")


@query("WITH e AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), deg AS (SELECT l_partkey, count(*) AS degree FROM e GROUP BY ALL) SELECT degree, count(*) AS n_parts FROM deg GROUP BY ALL")
def degree_stats(spark, d):
    e = _read(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return e.groupBy("l_partkey").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("n_parts"))


@query(f"WITH {PAIRS} SELECT graph_id, i, j, round(total, 4) AS total, round(apart, 4) AS apart FROM pairs WHERE i < j")
def nodepairs_upper_tri(spark, d):
    return _r(pairs.node_to_nodepair(_nodes(spark, d), "q", upper=True), 4, "total", "apart")


@query(f"WITH {EDGES} SELECT graph_id, src, dst, round(q_src + q_dst, 4) AS total, round(abs(q_src - q_dst), 4) AS apart FROM edges")
def node_to_edge(spark, d):
    return _r(pairs.node_to_edge(*_both(spark, d), "q"), 4, "total", "apart")


@query(f"WITH {PAIRS} SELECT graph_id, i, j, round(total, 4) AS total, round(apart, 4) AS apart FROM pairs")
def node_to_nodepair(spark, d):
    return _r(pairs.node_to_nodepair(_nodes(spark, d), "q"), 4, "total", "apart")


@query(f"""WITH {PAIRS}, a AS (SELECT graph_id, j AS node_id, min(apart) AS min0, avg(apart) AS mean0, stddev_pop(apart) AS std0 FROM pairs GROUP BY ALL), b AS (SELECT graph_id, i AS node_id, min(apart) AS min1, avg(apart) AS mean1, stddev_pop(apart) AS std1 FROM pairs GROUP BY ALL)
    SELECT graph_id, node_id, round(min0, 4) AS min0, round(mean0, 4) AS mean0, round(std0, 4) AS std0, round(min1, 4) AS min1, round(mean1, 4) AS mean1, round(std1, 4) AS std1 FROM a JOIN b USING (graph_id, node_id)""")
def nodepair_to_node(spark, d):
    out = pairs.nodepair_to_node(pairs.node_to_nodepair(_nodes(spark, d), "q"), "apart")
    return _r(out, 4, "min0", "mean0", "std0", "min1", "mean1", "std1")


@query(f"WITH {EDGES} SELECT graph_id, src, dst, round(abs(q_src - q_dst), 4) AS apart FROM edges")
def nodepair_to_edge(spark, d):
    nodes, edges = _both(spark, d)
    return _r(pairs.nodepair_to_edge(pairs.node_to_nodepair(nodes, "q"), edges, "apart"), 4, "apart")


@query(f"WITH {EDGES} SELECT a.graph_id, a.node_id AS i, b.node_id AS j, round(coalesce(e.d_src, 0.0), 4) AS v FROM nodes a JOIN nodes b ON a.graph_id = b.graph_id LEFT JOIN edges e ON e.graph_id = a.graph_id AND e.src = a.node_id AND e.dst = b.node_id")
def edge_to_nodepair(spark, d):
    nodes, edges = _both(spark, d)
    return _r(pairs.edge_to_nodepair(edges, nodes, "d_src"), 4, "v")


@query(f"WITH {NODES} SELECT graph_id, node_id, o_totalprice AS label FROM nodes JOIN orders ON o_orderkey = graph_id")
def graph_to_node(spark, d):
    g = _read(spark, d, "orders").select(F.col("o_orderkey").alias("graph_id"), F.col("o_totalprice").alias("label"))
    return pairs.graph_to_node(g, _nodes(spark, d), "label")


_DEG = "deg AS (SELECT graph_id, src AS node_id, count(*) AS deg FROM edges GROUP BY ALL), p AS (SELECT e.graph_id, e.src AS i, e.dst AS j, CAST(1 AS DOUBLE) / deg AS p FROM edges e JOIN deg ON deg.graph_id = e.graph_id AND deg.node_id = e.src)"


@query(f"WITH {EDGES}, {_DEG} SELECT a.graph_id, a.i AS node_id, round(sum(a.p * b.p), 6) AS p2 FROM p a JOIN p b ON a.graph_id = b.graph_id AND a.j = b.i AND b.j = a.i GROUP BY ALL")
def rw_return_k2(spark, d):
    nodes, edges = _both(spark, d)
    return _r(pairs.walk(edges, nodes, 2).where("i = j").select("graph_id", F.col("i").alias("node_id"), F.col("p").alias("p2")), 6, "p2")


@query(f"WITH {EDGES}, {_DEG} SELECT a.graph_id, a.i, b.j, round(sum(a.p * b.p), 6) AS p FROM p a JOIN p b ON a.graph_id = b.graph_id AND a.j = b.i GROUP BY ALL")
def rw_transition_k2(spark, d):
    nodes, edges = _both(spark, d)
    return _r(pairs.walk(edges, nodes, 2), 6, "p")


@query(f"WITH {NODES} SELECT a.graph_id, a.node_id AS i, b.node_id AS j, CAST(abs(a.node_id - b.node_id) AS INTEGER) AS hops FROM nodes a JOIN nodes b ON a.graph_id = b.graph_id")
def hop_distance(spark, d):
    return pairs.hop_distance(*_both(spark, d))


@query(f"WITH {EDGES}, {_DEG.split(', p AS')[0]} SELECT e.graph_id, e.src, e.dst, round(1 / sqrt(CAST(a.deg AS DOUBLE) * b.deg), 6) AS w FROM edges e JOIN deg a ON a.graph_id = e.graph_id AND a.node_id = e.src JOIN deg b ON b.graph_id = e.graph_id AND b.node_id = e.dst")
def laplacian_sym_edges(spark, d):
    nodes, edges = _both(spark, d)
    return _r(pairs.normalised_edges(edges, nodes, "sym"), 6, "w")


@query(f"WITH {EDGES} SELECT graph_id, unnest([n0, n1]) AS k, node_id AS j, unnest([n1, n0]) AS i FROM beside WHERE n0 IS NOT NULL AND n1 IS NOT NULL")
def triplets(spark, d):
    return message.triplets(_both(spark, d)[1])


@query(f"""WITH {POINTS}, near AS (SELECT a.graph_id, a.node_id AS i, b.node_id AS j, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS dist FROM points a JOIN points b ON a.graph_id = b.graph_id AND a.node_id <> b.node_id)
    SELECT graph_id, i, j, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, i ORDER BY round(dist, 9), j) AS r FROM near WHERE dist <= 1.0) WHERE r <= 8""")
def radius_join(spark, d):
    return _r(pairs.radius_join(_points(spark, d), ["x", "y", "z"], 1.0, 8), 6, "dist")


@query(f"""WITH {POINTS}, n AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) AS r FROM points), t AS (
      SELECT j.graph_id, j.node_id AS j, i.x - j.x AS ax, i.y - j.y AS ay, i.z - j.z AS az, k.x - j.x AS b1, k.y - j.y AS b2, k.z - j.z AS b3
      FROM n j JOIN n i ON i.graph_id = j.graph_id AND i.r = j.r + 1 JOIN n k ON k.graph_id = j.graph_id AND k.r = j.r - 1)
    SELECT graph_id, j, round(atan2(sqrt((ay*b3-az*b2)*(ay*b3-az*b2) + (az*b1-ax*b3)*(az*b1-ax*b3) + (ax*b2-ay*b1)*(ax*b2-ay*b1)), ax*b1+ay*b2+az*b3), 6) AS angle FROM t""")
def triplet_angle(spark, d):
    """Angle at each point between its neighbours in the order of ids: atan2 of the cross product's length and the dot product."""
    w = Window.partitionBy("graph_id").orderBy("node_id")
    p = _points(spark, d).select("graph_id", F.col("node_id").alias("j"), *[f(c, 1).over(w).alias(f"{n}{c}") for c in "xyz" for n, f in (("k", F.lag), ("i", F.lead))], "x", "y", "z")
    p = p.where("kx is not null and ix is not null")
    a, b = ([F.col(f"{n}{c}") - F.col(c) for c in "xyz"] for n in "ik")
    cross = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    return p.select("graph_id", "j", F.round(F.atan2(F.sqrt(sum((c * c for c in cross), F.lit(0.0))), sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))), 6).alias("angle"))


@query(f"""WITH {POINTS} SELECT graph_id, node_id, unnest(range(8)) AS kernel, round(exp(-0.5::DOUBLE * pow((x - unnest(range(8)) * 0.25::DOUBLE) / 0.26::DOUBLE, 2)) / (sqrt(2 * pi()) * 0.26::DOUBLE), 6) AS value FROM points""")
def gaussian_rbf(spark, d):
    """Eight Gaussian kernels with centres 0, 0.25, ... and width |0.25| + 0.01."""
    k = _points(spark, d).select("graph_id", "node_id", "x", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("kernel"))
    z = (F.col("x") - F.col("kernel") * 0.25) / 0.26
    return k.select("graph_id", "node_id", F.col("kernel").cast("long").alias("kernel"), F.round(F.exp(-0.5 * z * z) / (F.sqrt(2 * F.pi()) * 0.26), 6).alias("value"))


@query(f"""WITH {NODES}, s AS (SELECT a.graph_id, a.node_id AS i, b.node_id AS j, a.d * b.d * 10.0::DOUBLE AS score, b.q AS v FROM nodes a JOIN nodes b ON a.graph_id = b.graph_id),
    w AS (SELECT *, exp(score - max(score) OVER (PARTITION BY graph_id, i)) AS e FROM s) SELECT graph_id, i AS node_id, round(sum(e * v) / sum(e), 4) AS h FROM w GROUP BY ALL""")
def attention_single_head(spark, d):
    """Softmax over a graph's nodes of ten times the product of discounts, applied to quantities."""
    graph = Window.partitionBy("graph_id")
    nodes = _nodes(spark, d).withColumns({"lo": F.min("d").over(graph), "hi": F.max("d").over(graph)})
    s = graphs.in_graph_pairs(nodes, {"d": "d", "q": "q", "lo": "lo", "hi": "hi"})
    # a product with d_i rises or falls with d_j, so the largest score is that of an end: no sort of the pairs
    most = F.greatest(F.col("d_i") * F.col("lo_i") * 10.0, F.col("d_i") * F.col("hi_i") * 10.0)
    e = F.exp(F.col("d_i") * F.col("d_j") * 10.0 - most)
    return s.withColumn("e", e).groupBy("graph_id", F.col("i").alias("node_id")).agg(F.round(F.sum(F.col("e") * F.col("q_j")) / F.sum("e"), 4).alias("h"))
