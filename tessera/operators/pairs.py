"""Features moved between the levels of a graph, and joins of nodes within a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import encodings, nearest
from tessera.operators.graphs import gather, in_graph_pairs, sent, transfer


def node_to_edge(nodes: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """x_src + x_dst and |x_src - x_dst| of each edge."""
    transfer("node", "edge")
    both = sent(edges, nodes, value, both=True)
    return both.select("graph_id", "src", "dst", (F.col("xs") + F.col("xd")).alias("total"), F.abs(F.col("xs") - F.col("xd")).alias("apart"))


def node_to_nodepair(nodes: DataFrame, value: str, upper: bool = False) -> DataFrame:
    transfer("node", "nodepair")
    both = in_graph_pairs(nodes, {value: "x"}, upper)
    return both.select("graph_id", "i", "j", (F.col("x_i") + F.col("x_j")).alias("total"), F.abs(F.col("x_i") - F.col("x_j")).alias("apart"))


def nodepair_to_node(pairs: DataFrame, value: str) -> DataFrame:
    """min, mean and population std over the column (i, for each j) and over the row (j, for each i) of the matrix."""
    transfer("nodepair", "node")
    stats = lambda suffix: [F.min(value).alias(f"min{suffix}"), F.avg(value).alias(f"mean{suffix}"), F.stddev_pop(value).alias(f"std{suffix}")]
    down = pairs.groupBy("graph_id", F.col("j").alias("node_id")).agg(*stats("0"))
    across = pairs.groupBy("graph_id", F.col("i").alias("node_id")).agg(*stats("1"))
    return down.join(across, ["graph_id", "node_id"])


def nodepair_to_edge(pairs: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    transfer("nodepair", "edge")
    return edges.select("graph_id", "src", "dst").join(pairs.select("graph_id", F.col("i").alias("src"), F.col("j").alias("dst"), value), ["graph_id", "src", "dst"])


def edge_to_nodepair(edges: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """Every pair of a graph with its edge's value, 0 where there is no edge."""
    pairs = in_graph_pairs(nodes, {})
    return pairs.join(edges.select("graph_id", F.col("src").alias("i"), F.col("dst").alias("j"), F.col(value).alias("v")), ["graph_id", "i", "j"], "left").select("graph_id", "i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))


def graph_to_node(graphs: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    transfer("graph", "node")
    return nodes.select("graph_id", "node_id").join(graphs.select("graph_id", value), "graph_id")


def radius_join(points: DataFrame, position: list[str], cutoff: float, max_neighbours: int) -> DataFrame:
    """Ordered pairs of a graph's points at most `cutoff` apart, the `max_neighbours` nearest of each; ties by number.

    Points lie in tiles of some hundred that are near each other, and tiles meet only where a nearer point may be (see nearest.py); so
    neither copies nor points that all lie within the cutoff make a row for each pair. Points with a null, NaN or infinite coordinate
    have no neighbours."""
    return nearest.nearest(points, position, cutoff, max_neighbours)


def hop_distance(nodes: DataFrame, edges: DataFrame, longest: int | None = None) -> DataFrame:
    """Hops between all nodes of a graph; null where there is no way, or none of `longest` hops at most where that is given.

    Each graph is gathered once and searched breadth-first in its task, so the plan does not grow with the number of hops."""
    out = encodings.encode(nodes, edges, encodings.hops, "nodepair")
    reached = (F.col("v") >= 0) & (F.col("v") <= (longest if longest is not None else float(1 << 31)))
    return out.select("graph_id", "i", "j", F.when(reached, F.col("v")).cast("int").alias("hops"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    d = edges.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.count("*").alias("degree"))
    return nodes.select("graph_id", "node_id").join(d, ["graph_id", "node_id"], "left").fillna(0, ["degree"])


def normalised_edges(edges: DataFrame, nodes: DataFrame, how: str = "sym") -> DataFrame:
    """Adjacency weights 1 normalised: none, sym (both degrees' roots) or inv (the source's degree); 1/0 counts as 0."""
    deg = degrees(edges, nodes)
    e = gather(gather(edges.select("graph_id", "src", "dst"), deg, "src", {"degree": "a"}), deg, "dst", {"degree": "b"})
    w = {"none": F.lit(1.0), "sym": 1 / F.sqrt(F.col("a").cast("double") * F.col("b")), "inv": 1 / F.col("a").cast("double")}
    if how not in w:
        raise ValueError(f"normalisation is none, sym or inv, not {how!r}")
    return e.select("graph_id", "src", "dst", w[how].alias("w"))


def walk(edges: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Probabilities of going from i to j in k steps of a random walk, by k - 1 joins; nodes without neighbours stay nowhere."""
    p = normalised_edges(edges, nodes, "inv").select("graph_id", F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias("p"))
    out = p
    for _ in range(k - 1):
        out = out.withColumnRenamed("j", "m").join(p.select("graph_id", F.col("i").alias("m"), "j", F.col("p").alias("q")), ["graph_id", "m"]).groupBy("graph_id", "i", "j").agg(F.sum(F.col("p") * F.col("q")).alias("p"))
    return out
