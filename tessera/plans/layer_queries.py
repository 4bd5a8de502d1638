"""Queries over packs, 3D distances, bags of features and recurrent layers, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import graphs, labels, nn
from tessera.plans.graph_queries import NODES, POINTS
from tessera.plans.registry import query


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query(f"WITH {NODES}, z AS (SELECT graph_id, node_id, graph_id // 4 AS pack_id FROM nodes) SELECT a.pack_id, CAST(count(*) FILTER (a.graph_id <> b.graph_id) AS BIGINT) AS masked, CAST(count(*) FILTER (a.graph_id = b.graph_id) AS BIGINT) AS seen FROM z a JOIN z b USING (pack_id) GROUP BY a.pack_id")
def pack_attention_mask(spark, d):
    """Pairs of a pack's nodes that attention must not see (different graphs) and may see. Counted from sizes, without any pair: the sum of a graph's squares against the square of the sum."""
    sizes = graphs.order_nodes(_read(spark, d, "lineitem")).groupBy("graph_id").agg(F.count("*").alias("n")).withColumn("pack_id", F.floor(F.col("graph_id") / 4))
    own = sizes.groupBy("pack_id").agg(F.sum(F.col("n") * F.col("n")).alias("seen"), F.sum("n").alias("all"))
    return own.select("pack_id", (F.col("all") * F.col("all") - F.col("seen")).alias("masked"), "seen")


@query(f"""WITH {POINTS}, r AS (SELECT a.graph_id, a.node_id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS dist FROM points a JOIN points b ON a.graph_id = b.graph_id)
    SELECT graph_id, node_id, round(sum(exp(-0.5::DOUBLE * pow((dist - 1.0::DOUBLE) / 0.51::DOUBLE, 2)) / (sqrt(2 * pi()) * 0.51::DOUBLE)), 5) AS bias FROM r GROUP BY ALL""")
def distance_bias(spark, d):
    """For each point the sum over its graph of one Gaussian kernel (centre 1, width 0.5 + 0.01) of the distance."""
    e = F.col("embedding")
    points = _read(spark, d, "embeddings").select(F.col("label").alias("graph_id"), F.col("vec_id").alias("node_id"), *[e[k].cast("double").alias(c) for k, c in enumerate("xyz")])
    both = graphs.in_graph_pairs(points, {c: c for c in "xyz"})
    dist = F.sqrt(sum(((F.col(f"{c}_i") - F.col(f"{c}_j")) * (F.col(f"{c}_i") - F.col(f"{c}_j")) for c in "xyz"), F.lit(0.0)))
    z = (dist - 1.0) / 0.51
    return both.groupBy("graph_id", F.col("i").alias("node_id")).agg(F.round(F.sum(F.exp(-0.5 * z * z) / (F.sqrt(2 * F.pi()) * 0.51)), 5).alias("bias"))


@query("WITH g AS (SELECT l_orderkey, count(*) AS n, CASE l_orderkey % 5 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM lineitem GROUP BY l_orderkey) SELECT split, max(n) AS max_nodes, 2 * (max(n) - 1) AS max_edges FROM g WHERE split IN ('train', 'val') GROUP BY split")
def max_nodes_by_split(spark, d):
    split = F.when(F.col("l_orderkey") % 5 == 0, "val").when(F.col("l_orderkey") % 5 == 1, "test").otherwise("train")
    g = _read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).withColumn("split", split)
    return g.where(F.col("split").isin("train", "val")).groupBy("split").agg(F.max("n").alias("max_nodes"), (2 * (F.max("n") - 1)).alias("max_edges"))


@query("SELECT member, feature FROM (SELECT member, feature, row_number() OVER (PARTITION BY member ORDER BY md5('5|' || member || '|' || feature), feature) AS r FROM range(0, 4) a(member), range(0, 64) b(feature)) WHERE r <= 16")
def feature_bagging(spark, d):
    """A quarter of the features for each of four ensemble members, by seeded rank."""
    grid = spark.range(4).select(F.col("id").alias("member"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("feature"))
    order = F.md5(F.concat_ws("|", F.lit("5"), F.col("member").cast("string"), F.col("feature").cast("string")))
    return labels.keep(grid, ["member"], [order, F.col("feature")], 16).select("member", "feature")


_S = "1 / (1 + exp(-({})))"


@query(f"WITH x AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS h FROM embeddings), g AS (SELECT *, {_S.format('0.5::DOUBLE * x - 0.25::DOUBLE * h')} AS z, {_S.format('0.3::DOUBLE * x + 0.1::DOUBLE * h')} AS r FROM x) SELECT vec_id, round((1 - z) * tanh(0.7::DOUBLE * x + r * 0.2::DOUBLE * h) + z * h, 6) AS h FROM g")
def gru_step(spark, d):
    """One recurrent update of a state of width one: h' = (1 - z) tanh(w x + r u h) + z h."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    rows = _read(spark, d, "embeddings").select("vec_id", F.get(e, F.lit(0)).alias("x"), F.get(e, F.lit(1)).alias("h0"))
    sigmoid, tanh = nn.activation("sigmoid"), nn.activation("tanh")
    z, r = sigmoid(0.5 * F.col("x") - 0.25 * F.col("h0")), sigmoid(0.3 * F.col("x") + 0.1 * F.col("h0"))
    return rows.select("vec_id", F.round((1 - z) * tanh(0.7 * F.col("x") + r * 0.2 * F.col("h0")) + z * F.col("h0"), 6).alias("h"))


@query("WITH v AS (SELECT vec_id, [CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE), CAST(embedding[3] AS DOUBLE)] AS a FROM embeddings), m AS (SELECT vec_id, a, list_avg(a) AS m, list_avg(list_transform(a, lambda x: x * x)) - pow(list_avg(a), 2) AS s FROM v) SELECT vec_id, round((a[1] - m) / sqrt(s + 1e-5), 4) AS h0, round((a[3] - m) / sqrt(s + 1e-5), 4) AS h2 FROM m")
def layer_norm(spark, d):
    x = F.slice(F.transform("embedding", lambda v: v.cast("double")), 1, 3)
    rows = _read(spark, d, "embeddings").select("vec_id", x.alias("x"))
    return rows.select("vec_id", nn.layer_norm(F.col("x")).alias("h")).select("vec_id", F.round(F.col("h")[0], 4).alias("h0"), F.round(F.col("h")[2], 4).alias("h2"))


@query("SELECT conv_id, turn, round(avg(length(text)) OVER (PARTITION BY conv_id), 6) AS mean_length, length(text) - lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS step FROM conversations")
def sequence_features(spark, d):
    """Conversations as paths of turns: the graph's mean broadcast back, and the difference along each edge."""
    per = Window.partitionBy("conv_id")
    n = F.length("text").cast("long")
    return _read(spark, d, "conversations").select("conv_id", "turn", F.round(F.avg(n).over(per), 6).alias("mean_length"), (n - F.lag(n).over(per.orderBy("turn"))).alias("step"))
