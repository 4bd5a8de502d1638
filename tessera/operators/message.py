"""Message passing: what neighbours send is aggregated where the edges end. Each function returns a row a node."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graphs import gather, scatter, sent

AGGREGATORS = ("sum", "mean", "min", "max", "var", "std")
SCALERS = ("identity", "amplification", "attenuation", "linear", "inverse_linear")


def aggregator(name: str, x: Column) -> Column:
    """A column aggregate by name; var is the population's, std has 1e-5 under its root."""
    var = F.greatest(F.avg(x * x) - F.avg(x) * F.avg(x), F.lit(0.0))
    known = {"sum": F.sum(x), "mean": F.avg(x), "min": F.min(x), "max": F.max(x), "var": var, "std": F.sqrt(var + F.lit(1e-5))}
    if name not in known:
        raise ValueError(f"no aggregator {name!r}")
    return known[name]


def gcn(nodes: DataFrame, edges: DataFrame, value: str = "q", weight: float = 1.0) -> DataFrame:
    """Sum of the neighbours' weighted values, without normalisation or self loops; 0 for a node without neighbours."""
    out = scatter(sent(edges, nodes, value).select("graph_id", "dst", "xs"), nodes.select("graph_id", "node_id"), "dst", h=F.sum(F.lit(weight) * F.col("xs")))
    return out.select("graph_id", "node_id", F.coalesce("h", F.lit(0.0)).alias("h"))


def gin(nodes: DataFrame, edges: DataFrame, value: str = "q", eps: float = 0.0) -> DataFrame:
    out = scatter(sent(edges, nodes, value).select("graph_id", "dst", "xs"), nodes.select("graph_id", "node_id", F.col(value).alias("x")), "dst", h=F.sum("xs"))
    return out.select("graph_id", "node_id", ((1 + eps) * F.col("x") + F.coalesce("h", F.lit(0.0))).alias("h"))


def gine(nodes: DataFrame, edges: DataFrame, value: str = "q", edge_value: Column | None = None) -> DataFrame:
    """x_i + sum of relu(x_j + e_ij)."""
    e = F.lit(0.0) if edge_value is None else edge_value
    up = sent(edges, nodes, value).select("graph_id", "dst", F.greatest(F.col("xs") + e, F.lit(0.0)).alias("m"))
    out = scatter(up, nodes.select("graph_id", "node_id", F.col(value).alias("x")), "dst", m=F.sum("m"))
    return out.select("graph_id", "node_id", (F.col("x") + F.coalesce("m", F.lit(0.0))).alias("h"))


def gated(nodes: DataFrame, edges: DataFrame, value: str = "q", a: float = 1.0, b: float = 1.0, c: float = 1.0, d: float = 0.02, e: float = 0.03, eps: float = 1e-5) -> DataFrame:
    """A x_i + sum(sigmoid(D x_i + E x_j + C e_ij) B x_j) / (sum(sigmoid) + eps)."""
    gate = 1 / (1 + F.exp(-(d * F.col("xd") + e * F.col("xs") + c * F.col("same_flag").cast("double"))))
    up = sent(edges, nodes, value, both=True).select("graph_id", "dst", "xs", gate.alias("s"))
    out = scatter(up, nodes.select("graph_id", "node_id", F.col(value).alias("x")), "dst", up=F.sum(F.col("s") * b * F.col("xs")), down=F.sum("s"))
    return out.select("graph_id", "node_id", (a * F.col("x") + F.coalesce(F.col("up") / (F.col("down") + eps), F.lit(0.0))).alias("h"))


def pna(nodes: DataFrame, edges: DataFrame, value: str = "q", aggregators=AGGREGATORS, scalers=("identity",), avg_log: float = 1.0, avg_deg: float = 1.0) -> DataFrame:
    """Every aggregator times every scaler (scalers outside) in one pass; degrees count as 1 at least; 0 without neighbours
    (std: the root of 1e-5)."""
    up = sent(edges, nodes, value).select("graph_id", "dst", "xs")
    out = scatter(up, nodes.select("graph_id", "node_id"), "dst", deg=F.count("_edge"), **{n: aggregator(n, F.col("xs")) for n in aggregators})
    deg = F.greatest(F.col("deg"), F.lit(1)).cast("double")
    scale = {"identity": F.lit(1.0), "amplification": F.log(deg + 1) / avg_log, "attenuation": avg_log / F.log(deg + 1), "linear": deg / avg_deg, "inverse_linear": avg_deg / deg}
    empty = lambda n: F.lit(0.0031622776601683794 if n == "std" else 0.0)
    return out.select("graph_id", "node_id", *[(F.coalesce(n, empty(n)) * scale[s]).alias(n if s == "identity" else f"{n}_{s}") for s in scalers for n in aggregators])


def mpnn(nodes: DataFrame, edges: DataFrame, value: str = "q") -> DataFrame:
    """Edge message |x_src - x_dst| + x_src, summed at receivers and at senders; both are returned, from one aggregate."""
    m = F.abs(F.col("xs") - F.col("xd")) + F.col("xs")
    ends = F.explode(F.array(F.struct(F.col("dst").alias("at"), m.alias("r"), F.lit(None).cast("double").alias("s")), F.struct(F.col("src").alias("at"), F.lit(None).cast("double").alias("r"), m.alias("s"))))
    up = sent(edges, nodes, value, both=True).select("graph_id", ends.alias("x")).select("graph_id", "x.*")
    out = scatter(up, nodes.select("graph_id", "node_id"), "at", at_receiver=F.sum("r"), at_sender=F.sum("s"))
    return out.select("graph_id", "node_id", F.coalesce("at_receiver", F.lit(0.0)).alias("at_receiver"), F.coalesce("at_sender", F.lit(0.0)).alias("at_sender"))


def gated_edges(edges: DataFrame, feature: str, c: float = 1.0, d: float = 0.02, e: float = 0.03) -> DataFrame:
    """The gated layer's new edge features D x_dst + E x_src + C e_ij, of edges that carry x_src and x_dst: a map, without a join."""
    return edges.select("graph_id", "src", "dst", (F.lit(d) * F.col("x_dst") + F.lit(e) * F.col("x_src") + F.lit(c) * F.col(feature)).alias("e"))


def with_ends(edges: DataFrame, nodes: DataFrame, feature: str) -> DataFrame:
    """edges with the feature of both ends as x_src and x_dst, for edges that do not carry them yet (two joins)."""
    return gather(gather(edges, nodes, "src", {feature: "x_src"}), nodes, "dst", {feature: "x_dst"})


BOTH = {"senders": ("src",), "receivers": ("dst",), "both": ("dst", "src")}


def mpnn_plus(
    nodes: DataFrame, edges: DataFrame, width: int, feature: str = "x", edge_feature: str | None = None, edge_model: Callable[[Column], Column] | None = None, edge_width: int | None = None,
    node_model: Callable[[Column], Column] | None = None, gather_from: str = "both", gather_how: str = "concat", scatter_to: str = "both", scatter_how: str = "concat", aggregators: tuple[str, ...] = ("sum",),
) -> DataFrame:
    """Message passing over vectors, a row a node: graph_id, node_id, h.

    nodes: graph_id, node_id, and the array `feature` of `width` numbers; edges: graph_id, src, dst, the arrays x_src and x_dst (see
    with_ends) and, if named, the array `edge_feature`. An edge's input is what `gather_from` names (senders, receivers or
    both: concatenated or added), followed by the edge feature; edge_model (a function of an array column, such as nn.linear)
    makes the message of `edge_width` numbers. Messages are aggregated entry by entry at what `scatter_to` names, by every aggregator in
    turn; the two directions are concatenated (receivers first) or added. node_model sees the node's feature followed by all of it.

    Both directions and the nodes are one union and one aggregate with partial sums before its exchange, so a hub's messages are summed
    where they are made, and nothing is joined or exchanged again. A node without messages gets 0 (std: the root of 1e-5).
    """
    for value, known in ((gather_from, BOTH), (scatter_to, BOTH), (gather_how, ("concat", "sum")), (scatter_how, ("concat", "sum"))):
        if value not in known:
            raise ValueError(f"{value!r} is none of {tuple(known)}")
    added = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    taken = [F.col({"src": "x_src", "dst": "x_dst"}[s]) for s in reversed(BOTH[gather_from])]
    both = taken[0] if len(taken) == 1 else F.concat(*taken) if gather_how == "concat" else added(*taken)
    message = F.concat(both, F.col(edge_feature)) if edge_feature else both
    if edge_width is None:
        if edge_model or edge_feature:
            raise ValueError("edge_width says how many numbers a message has")
        edge_width = width * (2 if gather_from == "both" and gather_how == "concat" else 1)
    up = edges.select("graph_id", "src", "dst", (edge_model(message) if edge_model else message).alias("m"))
    sides = BOTH[scatter_to]
    ends = F.explode(F.array(*[F.struct(F.lit(s == "src").alias("back"), F.col(s).alias("node_id")) for s in sides]))
    dealt = up.select("graph_id", "m", ends.alias("to")).select("graph_id", "to.node_id", "to.back", *[F.get("m", F.lit(k)).alias(f"m{k}") for k in range(edge_width)])
    cells = {(s, a, k): aggregator(a, F.when(F.col("back") == F.lit(s == "src"), F.col(f"m{k}"))) for s in sides for a in aggregators for k in range(edge_width)}
    own = [F.get(feature, F.lit(k)).alias(f"x{k}") for k in range(width)]
    here = nodes.select("graph_id", "node_id", *own, F.col(feature).isNotNull().alias("some"))
    kept = [F.first(f"x{k}", ignorenulls=True).alias(f"x{k}") for k in range(width)]
    met = dealt.where("graph_id is not null and node_id is not null")  # a null is no node's key
    found = met.unionByName(here, allowMissingColumns=True).groupBy("graph_id", "node_id").agg(*kept, F.bool_or("some").alias("some"), *[c.alias(f"{s}_{a}_{k}") for (s, a, k), c in cells.items()])
    joined = found.where("some is not null").withColumn("x", F.when(F.col("some"), F.array(*[F.col(f"x{k}") for k in range(width)])))
    direction = lambda s: F.array(*[F.coalesce(f"{s}_{a}_{k}", F.lit(0.0031622776601683794 if a == "std" else 0.0)) for a in aggregators for k in range(edge_width)])
    got = [direction(s) for s in sides]
    all_ = got[0] if len(got) == 1 else F.concat(*got) if scatter_how == "concat" else added(*got)
    return joined.select("graph_id", "node_id", (node_model(F.concat("x", all_)) if node_model else all_).alias("h"))


def triplets(edges: DataFrame) -> DataFrame:
    """k -> j -> i: pairs of edges where the first ends at the second's beginning, but not back at k."""
    kj = edges.select("graph_id", F.col("src").alias("k"), F.col("dst").alias("j"))
    ji = edges.select("graph_id", F.col("src").alias("j"), F.col("dst").alias("i"))
    return kj.join(ji, ["graph_id", "j"]).where("i <> k").select("graph_id", "k", "j", "i")
