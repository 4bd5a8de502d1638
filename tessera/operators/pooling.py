"""From nodes (or edges) to graphs, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.message import aggregator


def pooled(how: str, x: Column) -> Column:
    """One of sum, mean, min, max, var, std, logsum as an aggregate; logsum is mean times ln(count)."""
    return F.avg(x) * F.log(F.count(x)) if how == "logsum" else aggregator(how, x)


def pool(rows: DataFrame, value: str, how: tuple[str, ...], by: str = "graph_id") -> DataFrame:
    """sum, mean, min, max, std, logsum of a column for each graph, in one aggregate; logsum is mean times ln(count)."""
    x = F.col(value)
    return rows.groupBy(by).agg(*[pooled(h, x).alias(h) for h in how])


def virtual_node(nodes: DataFrame, value: str, how: str = "sum") -> DataFrame:
    """Each node's value plus the pooled value of its graph: a window over graph_id, no join back."""
    pooled = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}[how](value).over(Window.partitionBy("graph_id"))
    return nodes.select("graph_id", "node_id", (F.col(value) + pooled).alias("h"))


def statistics(graphs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: graphs, nodes and edges in all and per graph (min, max, mean, population std); graphs without nodes count 0."""
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    e = edges.groupBy("graph_id").agg(F.count("*").alias("e"))
    per = graphs.select("graph_id").join(n, "graph_id", "left").join(e, "graph_id", "left").fillna(0, ["n", "e"])
    stats = [f(c).alias(f"{name}_{kind}") for c, kind in (("n", "nodes"), ("e", "edges")) for name, f in (("total", F.sum), ("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))]
    return per.agg(F.count("*").alias("num_graphs"), *stats)
