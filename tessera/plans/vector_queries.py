"""Queries of attention, vector message passing and directional messages, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import attention, directional, encoders, graphs, message, nn, pairs, positional
from tessera.plans.graph_queries import EDGES
from tessera.plans.registry import query


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


_BIAS = attention.DistanceBias([0.2, 0.6, 1.0], [0.2, -0.3, 0.4], [[0.5, -0.25], [1.0, 0.5], [-0.5, 0.75]])
_SQL_KERNELS = [f"exp(-0.5::DOUBLE * pow((dist - {c}::DOUBLE) / {abs(w) + 0.01}::DOUBLE, 2)) / (sqrt(2 * pi()) * {abs(w) + 0.01}::DOUBLE)" for c, w in zip(_BIAS.centres, _BIAS.widths, strict=True)]
_SQL_BIAS = ["CASE h " + " ".join(f"WHEN {h} THEN {w}::DOUBLE" for h, w in enumerate(row)) + " END" for row in _BIAS.weights]


@query(f"""WITH p AS (SELECT label AS graph_id, vec_id AS node_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    s AS (SELECT a.graph_id, a.node_id, a.e AS ea, b.e AS eb, list_distance(a.e[1:3], b.e[1:3]) AS dist FROM p a JOIN p b ON a.graph_id = b.graph_id AND NOT b.e[4] > 0.1),
    k AS (SELECT graph_id, node_id, ea, eb, {', '.join(f'{x} AS k{n}' for n, x in enumerate(_SQL_KERNELS))} FROM s),
    t AS (SELECT graph_id, node_id, h, 6.0::DOUBLE * list_dot_product(ea[1 + 4 * h:4 + 4 * h], eb[9 + 4 * h:12 + 4 * h]) + {' + '.join(f'k{n} * ({x})' for n, x in enumerate(_SQL_BIAS))} AS score, eb[17 + 2 * h] AS v0, eb[18 + 2 * h] AS v1, k0, k1, k2 FROM k, (VALUES (0), (1)) x(h)),
    w AS (SELECT *, exp(score - max(score) OVER (PARTITION BY graph_id, node_id, h)) AS x FROM t),
    o AS (SELECT graph_id, node_id, h, sum(x * v0) / sum(x) AS o0, sum(x * v1) / sum(x) AS o1, sum(k0) AS s0, sum(k1) AS s1, sum(k2) AS s2 FROM w GROUP BY ALL),
    r AS (SELECT graph_id, node_id, max(o0) FILTER (h = 0) AS h0, max(o1) FILTER (h = 0) AS h1, max(o0) FILTER (h = 1) AS h2, max(o1) FILTER (h = 1) AS h3, max(s0) AS near0, max(s1) AS near1, max(s2) AS near2 FROM o GROUP BY ALL)
    SELECT CAST(p.graph_id AS BIGINT) AS graph_id, p.node_id, round(h0, 5) AS h0, round(h1, 5) AS h1, round(h2, 5) AS h2, round(h3, 5) AS h3, round(coalesce(near0, 0.0), 4) AS near0, round(coalesce(near1, 0.0), 4) AS near1, round(coalesce(near2, 0.0), 4) AS near2
    FROM p LEFT JOIN r ON p.graph_id = r.graph_id AND p.node_id = r.node_id""")
def attention_two_heads_biased(spark, d):
    """Two heads over vectors, three Gaussian kernels of the distance as bias of either head, masked keys; tiles of 256 ids."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    nodes = _read(spark, d, "embeddings").select(F.col("label").alias("graph_id"), F.col("vec_id").alias("node_id"), e.alias("e"))
    nodes = nodes.select("graph_id", "node_id", F.slice("e", 1, 8).alias("q"), F.slice("e", 9, 8).alias("k"), F.slice("e", 17, 4).alias("v"), F.slice("e", 1, 3).alias("position"), (F.get("e", F.lit(3)) > 0.1).alias("masked"))
    out = attention.attend(nodes, heads=2, head_dim=4, value_dim=2, bias=_BIAS, scale=6.0)
    return out.select("graph_id", "node_id", *[F.round(F.get("h", F.lit(i)), 5).alias(f"h{i}") for i in range(4)], *[F.round(F.get("near", F.lit(i)), 4).alias(f"near{i}") for i in range(3)])


@query("""WITH p AS (SELECT label AS graph_id, vec_id AS node_id, embedding[5]::DOUBLE AS x, embedding[6]::DOUBLE AS y FROM embeddings), n AS (SELECT a.graph_id, a.node_id AS i, b.node_id AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM p a JOIN p b ON a.graph_id = b.graph_id AND a.node_id <> b.node_id)
    SELECT graph_id, i, j, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, i ORDER BY round(dist, 9), j) AS r FROM n WHERE dist <= 0.05) WHERE r <= 6""")
def radius_join_cells(spark, d):
    """Neighbours in the plane within a cutoff that is small against the spread of the points: many cells, few pairs."""
    points = _read(spark, d, "embeddings").select(F.col("label").alias("graph_id"), F.col("vec_id").alias("node_id"), F.get("embedding", F.lit(4)).cast("double").alias("x"), F.get("embedding", F.lit(5)).cast("double").alias("y"))
    return pairs.radius_join(points, ["x", "y"], 0.05, 6).withColumn("dist", F.round("dist", 6))


_W, _B = [[0.02, 0.5, -0.01, 1.0, 0.25], [-0.03, 1.0, 0.02, -2.0, 0.5]], [0.1, -0.2]
_AGG = ("sum", "mean", "max", "std")
_SQL_MESSAGES = ", ".join(f"greatest({w[0]}::DOUBLE * q_src + {w[1]}::DOUBLE * d_src + {w[2]}::DOUBLE * q_dst + {w[3]}::DOUBLE * d_dst + {w[4]}::DOUBLE * same + {b}::DOUBLE, 0.0) AS m{k}" for k, (w, b) in enumerate(zip(_W, _B, strict=True)))
_SQL_AGG = {"sum": "sum({})", "mean": "avg({})", "max": "max({})", "std": "sqrt(greatest(avg({0} * {0}) - avg({0}) * avg({0}), 0.0) + 1e-5)"}
_SQL_CELLS = [(f"{s}_{a}_{k}", f"coalesce({s}.{a}_{k}, {0.0031622776601683794 if a == 'std' else 0.0}::DOUBLE)") for s in ("r", "s") for a in _AGG for k in range(2)]
_PATH = f"{EDGES}, ends AS (SELECT e.graph_id, e.src, e.dst, e.q_src, e.d_src, e.q_dst, o.d AS d_dst, CAST(e.same_flag AS DOUBLE) AS same FROM edges e JOIN nodes o ON o.graph_id = e.graph_id AND o.node_id = e.dst)"


def _vectors(spark, d):
    """Order graphs with the node vector (quantity, discount) and edges that carry it for both ends, from lead and lag alone."""
    nodes = graphs.order_nodes(_read(spark, d, "lineitem")).withColumn("x", F.array("q", "d"))
    return nodes, graphs.path_ends(nodes)


@query(f"""WITH {_PATH}, m AS (SELECT graph_id, src, dst, {_SQL_MESSAGES} FROM ends),
    r AS (SELECT graph_id, dst AS node_id, {', '.join(f'{x.format(f"m{k}")} AS {a}_{k}' for a, x in _SQL_AGG.items() for k in range(2))} FROM m GROUP BY ALL),
    s AS (SELECT graph_id, src AS node_id, {', '.join(f'{x.format(f"m{k}")} AS {a}_{k}' for a, x in _SQL_AGG.items() for k in range(2))} FROM m GROUP BY ALL)
    SELECT n.graph_id, n.node_id, {', '.join(f'round({x}, 4) AS {c}' for c, x in _SQL_CELLS)} FROM nodes n LEFT JOIN r USING (graph_id, node_id) LEFT JOIN s USING (graph_id, node_id)""")
def mpnn_vectors(spark, d):
    """Messages relu(W [x_src, x_dst, e] + b), four aggregators at receivers and at senders, concatenated."""
    nodes, edges = _vectors(spark, d)
    edges = edges.withColumn("e", F.array(F.col("same_flag").cast("double")))
    out = message.mpnn_plus(nodes, edges, 2, edge_feature="e", edge_model=lambda x: nn.linear(x, _W, _B, "relu"), edge_width=2, aggregators=_AGG)
    return out.select("graph_id", "node_id", *[F.round(F.get("h", F.lit(i)), 4).alias(c) for i, (c, _) in enumerate(_SQL_CELLS)])


@query(f"""WITH {_PATH}, t AS (SELECT graph_id, dst AS node_id, avg(q_src + q_dst) AS a0, avg(d_src + d_dst) AS a1 FROM ends GROUP BY ALL UNION ALL SELECT graph_id, src, avg(q_src + q_dst), avg(d_src + d_dst) FROM ends GROUP BY ALL),
    u AS (SELECT graph_id, node_id, sum(a0) AS a0, sum(a1) AS a1 FROM t GROUP BY ALL)
    SELECT n.graph_id, n.node_id, round(n.q + 0.5::DOUBLE * coalesce(a0, 0.0), 4) AS h0, round(n.d + 0.5::DOUBLE * coalesce(a1, 0.0), 4) AS h1 FROM nodes n LEFT JOIN u USING (graph_id, node_id)""")
def mpnn_summed(spark, d):
    """Ends added, means at both directions added, and a node model over [x, h]."""
    nodes, edges = _vectors(spark, d)
    out = message.mpnn_plus(nodes, edges, 2, gather_how="sum", scatter_how="sum", aggregators=("mean",), node_model=lambda x: nn.linear(x, [[1, 0, 0.5, 0], [0, 1, 0, 0.5]]))
    return out.select("graph_id", "node_id", F.round(F.get("h", F.lit(0)), 4).alias("h0"), F.round(F.get("h", F.lit(1)), 4).alias("h1"))


@query(f"WITH {EDGES} SELECT graph_id, src, dst, round(0.02::DOUBLE * q_dst + 0.03::DOUBLE * q_src + CAST(same_flag AS DOUBLE), 5) AS e FROM edges")
def gated_edge_output(spark, d):
    nodes = graphs.order_nodes(_read(spark, d, "lineitem"))
    edges = graphs.path_edges(nodes).select("graph_id", "src", "dst", F.col("q_src").alias("x_src"), F.col("q_dst").alias("x_dst"), F.col("same_flag").cast("double").alias("f"))
    return message.gated_edges(edges, "f").withColumn("e", F.round("e", 5))


_CUT, _ORDERS, _ZEROS = 1.2, 3, 2
_BILINEAR = [[[0.5, -0.2], [0.1, 0.3], [-0.4, 0.6], [0.2, 0.1], [0.7, -0.5], [0.3, 0.2]], [[-0.3, 0.4], [0.6, 0.1], [0.2, -0.2], [0.5, 0.5], [-0.1, 0.3], [0.4, -0.6]]]


def _sql_basis() -> list[str]:
    """The spherical basis as SQL over d and t; zeros and norms are numbers, as they are in the columns."""
    j = ["sin({x}) / ({x})", "(sin({x}) / pow({x}, 2) - cos({x}) / ({x}))", "((3 / pow({x}, 2) - 1) * sin({x}) / ({x}) - 3 * cos({x}) / pow({x}, 2))"]
    p = ["1.0", "cos(t)", "(1.5 * cos(t) * cos(t) - 0.5)"]
    out = []
    for l in range(_ORDERS):
        for z in directional.zeros(l, _ZEROS):
            norm = (2 / _CUT**3) ** 0.5 / abs(directional._j(l + 1, z)) * ((2 * l + 1) / (4 * 3.141592653589793)) ** 0.5
            out.append(f"{norm!r}::DOUBLE * {j[l].format(x=f'{z / _CUT!r}::DOUBLE * d')} * {p[l]}")
    return out


_SQL_SUMS = [f"{' + '.join(f'({w}::DOUBLE) * b{s} * x{c}' for s, row in enumerate(own) for c, w in enumerate(row))}" for own in _BILINEAR]


@query(f"""WITH p AS (SELECT label AS g, vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT a.g, a.id AS i, b.id AS j, a.e[1] - b.e[1] AS dx, a.e[2] - b.e[2] AS dy, a.e[3] - b.e[3] AS dz, b.e[5] AS x0, b.e[6] AS x1,
      sqrt((a.e[1]-b.e[1])*(a.e[1]-b.e[1]) + (a.e[2]-b.e[2])*(a.e[2]-b.e[2]) + (a.e[3]-b.e[3])*(a.e[3]-b.e[3])) AS dist FROM p a JOIN p b ON a.g = b.g AND a.id <> b.id),
    e AS (SELECT g, j AS src, i AS dst, dx, dy, dz, x0, x1 FROM (SELECT *, row_number() OVER (PARTITION BY g, i ORDER BY round(dist, 9), j) AS r FROM n WHERE dist <= {_CUT}) WHERE r <= 4),
    t AS (SELECT b.g, b.src, b.dst, a.x0, a.x1, sqrt(a.dx*a.dx + a.dy*a.dy + a.dz*a.dz) AS d, -b.dx AS ax, -b.dy AS ay, -b.dz AS az, -a.dx - b.dx AS kx, -a.dy - b.dy AS ky, -a.dz - b.dz AS kz FROM e a JOIN e b ON a.g = b.g AND a.dst = b.src AND a.src <> b.dst),
    u AS (SELECT g, src, dst, x0, x1, d, atan2(sqrt(pow(ay*kz - az*ky, 2) + pow(az*kx - ax*kz, 2) + pow(ax*ky - ay*kx, 2)), ax*kx + ay*ky + az*kz) AS t FROM t),
    v AS (SELECT g, src, dst, x0, x1, {', '.join(f'{b} AS b{s}' for s, b in enumerate(_sql_basis()))} FROM u), s AS (SELECT g, src, dst, sum({_SQL_SUMS[0]}) AS h0, sum({_SQL_SUMS[1]}) AS h1 FROM v GROUP BY ALL)
    SELECT e.g AS graph_id, e.src, e.dst, round(coalesce(h0, 0.0), 5) AS h0, round(coalesce(h1, 0.0), 5) AS h1 FROM e LEFT JOIN s ON s.g = e.g AND s.src = e.src AND s.dst = e.dst""")
def directional_messages(spark, d):
    """Triplets over the four nearest points within a cutoff, a basis of three orders and two zeros, a bilinear sum a directed edge."""
    at = [F.get("embedding", F.lit(k)).cast("double") for k in range(6)]
    points = _read(spark, d, "embeddings").select(F.col("label").alias("graph_id"), F.col("vec_id").alias("node_id"), *[c.alias(n) for c, n in zip(at, ("x", "y", "z"), strict=False)], F.array(at[4], at[5]).alias("f"))
    near = pairs.radius_join(points, ["x", "y", "z"], _CUT, 4).select("graph_id", F.col("j").alias("src"), F.col("i").alias("dst"))
    ends = graphs.gather(graphs.gather(near, points, "src", {"x": "xs", "y": "ys", "z": "zs", "f": "x"}), points, "dst", {"x": "xd", "y": "yd", "z": "zd"})
    edges = ends.select("graph_id", "src", "dst", *[(F.col(f"{c}d") - F.col(f"{c}s")).alias(f"d{c}") for c in "xyz"], "x")
    out = directional.directional(edges, _BILINEAR, _CUT, _ORDERS, _ZEROS)
    return out.select("graph_id", "src", "dst", F.round(F.get("h", F.lit(0)), 5).alias("h0"), F.round(F.get("h", F.lit(1)), 5).alias("h1"))


_PHI = [([[0.7, 1.5], [-0.4, 2.0]], [0.1, -0.3], "tanh")]
_RHO = [([[1.0, -0.5], [0.25, 2.0]], [0.0, 0.5], "none")]
_GIN = [[([[1.2], [-0.8]], [0.3, 0.2], "tanh")]]
_SPECS = {"values": {"type": "laplacian_eigval", "num_pos": 3, "pad": float("nan")}, "vectors": {"type": "laplacian_eigvec", "num_pos": 3, "pad": float("nan")}}
_SQL_VECTORS = """n AS (SELECT graph_id, node_id, CAST(count(*) OVER (PARTITION BY graph_id) AS DOUBLE) AS size FROM nodes), k AS (SELECT graph_id, node_id, size, unnest(range(3)) AS k FROM n),
    v AS (SELECT graph_id, node_id, size, k, 2 - 2 * cos(pi() * k / size) AS w, CASE WHEN k = 0 THEN 1 / sqrt(size) ELSE sqrt(2 / size) * cos(pi() * k * (node_id + 0.5) / size) END AS v FROM k WHERE k < size)"""


def _eigen(spark, d):
    nodes = graphs.order_nodes(_read(spark, d, "lineitem"))
    edges = graphs.path_edges(nodes)
    return positional.encode_all(nodes, edges, _SPECS).select("graph_id", "node_id", "pe.*"), edges


@query(f"""WITH {EDGES}, {_SQL_VECTORS}, p AS (SELECT graph_id, node_id, sum(tanh(0.7::DOUBLE * w + 1.5::DOUBLE * v + 0.1) + tanh(0.7::DOUBLE * w - 1.5::DOUBLE * v + 0.1)) AS a, sum(tanh(-0.4::DOUBLE * w + 2.0::DOUBLE * v - 0.3) + tanh(-0.4::DOUBLE * w - 2.0::DOUBLE * v - 0.3)) AS b FROM v GROUP BY ALL)
    SELECT graph_id, CAST(node_id AS INTEGER) AS node_id, round(a - 0.5::DOUBLE * b, 5) AS h0, round(0.25::DOUBLE * a + 2 * b + 0.5, 5) AS h1 FROM p""")
def laplacian_encoder_sign_free(spark, d):
    """Eigenvalues and eigenvectors of a graph through phi with both signs, summed, and rho."""
    out = encoders.laplacian_encoder(_eigen(spark, d)[0], _PHI, _RHO)
    return out.select("graph_id", "node_id", *[F.round(F.get("h", F.lit(k)), 5).alias(f"h{k}") for k in range(2)])


@query(f"""WITH {EDGES}, {_SQL_VECTORS}, s AS (SELECT graph_id, node_id, k, (1 + CASE WHEN size = 1 THEN 0 WHEN node_id IN (0, size - 1) THEN 1 ELSE 2 END - w) * v AS s FROM v),
    p AS (SELECT graph_id, node_id, k, tanh(1.2::DOUBLE * s + 0.3) + tanh(-1.2::DOUBLE * s + 0.3) AS a, tanh(-0.8::DOUBLE * s + 0.2) + tanh(0.8::DOUBLE * s + 0.2) AS b FROM s)
    SELECT graph_id, CAST(node_id AS INTEGER) AS node_id, round(sum((k + 1) * a - 0.5::DOUBLE * b), 5) AS h0, round(sum(0.25::DOUBLE * a + (2 - k) * b), 5) AS h1 FROM p GROUP BY ALL""")
def sign_net(spark, d):
    """phi is one graph layer over each eigenvector; with L v = w v a node's neighbours sum to (degree - w) v, which is what the SQL uses."""
    pe, edges = _eigen(spark, d)
    rho = [([[1.0, -0.5, 2.0, -0.5, 3.0, -0.5], [0.25, 2.0, 0.25, 1.0, 0.25, 0.0]], None, "none")]
    out = encoders.sign_net(pe, edges, _GIN, rho, 3)
    return out.select("graph_id", "node_id", *[F.round(F.get("h", F.lit(k)), 5).alias(f"h{k}") for k in range(2)])


@query(f"""WITH {_PATH}, a AS (SELECT n.graph_id, n.node_id, n.q AS x0, 10 * n.d AS x1, n.q + coalesce(sum(e.q_src), 0.0) AS y0, 10 * n.d + coalesce(sum(10 * e.d_src), 0.0) AS y1 FROM nodes n LEFT JOIN ends e ON e.graph_id = n.graph_id AND e.dst = n.node_id GROUP BY n.graph_id, n.node_id, n.q, n.d),
    f AS (SELECT graph_id, avg(x0) AS f0, avg(x1) AS f1, sum(greatest(0.1::DOUBLE * y0 - y1, 0.0)) AS f2, max(greatest(0.1::DOUBLE * y0 - y1, 0.0)) AS f3 FROM a GROUP BY ALL)
    SELECT graph_id, round(f0, 4) AS f0, round(f1, 4) AS f1, round(f2, 4) AS f2, round(f3, 4) AS f3 FROM f""")
def fingerprint_stages(spark, d):
    """Readouts of two stages of a chain of four: the input's means, and sum and maximum after a graph layer and a linear one; the head is not run."""
    nodes = graphs.order_nodes(_read(spark, d, "lineitem")).withColumn("x", F.array(F.col("q"), 10 * F.col("d")))
    edges = graphs.path_ends(nodes)

    def conv(x):
        found = message.mpnn_plus(x, edges, 2, gather_from="senders", scatter_to="receivers", node_model=lambda v: F.zip_with(F.slice(v, 1, 2), F.slice(v, 3, 2), lambda a, b: a + b))
        return found.select("graph_id", "node_id", F.col("h").alias("x"))

    def head(x):
        raise RuntimeError("no readout asks for this stage")

    stages = [("input", lambda x: x.select("graph_id", "node_id", "x")), ("conv", conv), ("linear", lambda x: x.select("graph_id", "node_id", nn.linear(F.col("x"), [[0.1, -1.0]], None, "relu").alias("x"))), ("head", head)]
    out = encoders.fingerprints(nodes, stages, {"input": ("mean",), "linear": ("sum", "max")}, {"input": 2, "linear": 1})
    return out.select("graph_id", *[F.round(F.get("fingerprint", F.lit(k)), 4).alias(f"f{k}") for k in range(4)])


@query(f"""WITH {EDGES}, a AS (SELECT graph_id, node_id, q AS x0, d AS x1 FROM nodes UNION ALL SELECT graph_id, dst, q_src, d_src FROM edges), b AS (SELECT graph_id, node_id, avg(x0) AS y0, avg(x1) AS y1 FROM a GROUP BY ALL)
    SELECT graph_id, CAST(node_id AS INTEGER) AS node_id, round(t, 4) AS h0, round(y0, 4) AS h1, round(y1, 5) AS h2 FROM nodes JOIN b USING (graph_id, node_id)""")
def encoder_outputs_pooled(spark, d):
    """Two encoders under one key (a node's own vector, each neighbour's vector), averaged, after the feature that was there."""
    nodes, edges = _vectors(spark, d)
    near = edges.select("graph_id", F.col("dst").alias("node_id"), F.col("x_src").alias("x"))
    out = encoders.pool_outputs([nodes.select("graph_id", "node_id", "x"), near], 2, "mean", nodes.select("graph_id", "node_id", F.array("t").alias("x")))
    return out.select("graph_id", "node_id", F.round(F.get("h", F.lit(0)), 4).alias("h0"), F.round(F.get("h", F.lit(1)), 4).alias("h1"), F.round(F.get("h", F.lit(2)), 5).alias("h2"))


_HEADS = {"q": [[1.0, 0.5], [0.0, 1.0]], "k": [[0.5, 0.0], [1.0, 1.0]], "v": [[1.0, 0.0], [0.5, 1.0]], "o": [[1.0, -0.5], [0.25, 1.0]]}
_FFN = [([[0.3, -0.2], [0.1, 0.4]], [0.05, -0.1], "relu"), ([[1.0, 0.5], [-0.5, 1.0]], None, "none")]


@query(f"""WITH {_PATH}, x AS (SELECT graph_id, node_id, q / 50 AS x0, 10 * d AS x1 FROM nodes), l AS (SELECT graph_id, dst AS node_id, sum(q_src / 50) AS l0, sum(10 * d_src) AS l1 FROM ends GROUP BY ALL),
    s AS (SELECT a.graph_id, a.node_id, (a.x0 + 0.5 * a.x1) * 0.5 * b.x0 AS s0, a.x1 * (b.x0 + b.x1) AS s1, b.x0 AS v0, 0.5 * b.x0 + b.x1 AS v1 FROM x a JOIN x b ON a.graph_id = b.graph_id),
    e AS (SELECT graph_id, node_id, v0, v1, exp(s0 - max(s0) OVER w) AS e0, exp(s1 - max(s1) OVER w) AS e1 FROM s WINDOW w AS (PARTITION BY graph_id, node_id)), g AS (SELECT graph_id, node_id, sum(e0 * v0) / sum(e0) AS g0, sum(e1 * v1) / sum(e1) AS g1 FROM e GROUP BY ALL),
    h AS (SELECT x.graph_id, x.node_id, coalesce(l0, 0.0) + x0 + g0 - 0.5 * g1 AS h0, coalesce(l1, 0.0) + x1 + 0.25 * g0 + g1 AS h1 FROM x JOIN g USING (graph_id, node_id) LEFT JOIN l USING (graph_id, node_id)),
    f AS (SELECT graph_id, node_id, h0, h1, greatest(0.3 * h0 - 0.2 * h1 + 0.05, 0.0) AS f0, greatest(0.1 * h0 + 0.4 * h1 - 0.1, 0.0) AS f1 FROM h)
    SELECT graph_id, CAST(node_id AS INTEGER) AS node_id, round(h0 + f0 + 0.5 * f1, 5) AS h0, round(h1 - 0.5 * f0 + f1, 5) AS h1 FROM f""")
def local_global_block(spark, d):
    """Neighbour sums, two attention heads over each graph, a feed-forward part, each added to what it starts from."""
    nodes = graphs.order_nodes(_read(spark, d, "lineitem")).withColumn("x", F.array(F.col("q") / 50, 10 * F.col("d")))
    out = encoders.gps(nodes.select("graph_id", "node_id", "x"), graphs.path_ends(nodes), 2, 2, _HEADS, _FFN)
    return out.select("graph_id", F.col("node_id").cast("int").alias("node_id"), F.round(F.get("h", F.lit(0)), 5).alias("h0"), F.round(F.get("h", F.lit(1)), 5).alias("h1"))
