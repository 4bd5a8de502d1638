"""Graphs as tables: nodes (graph_id, node_id, features), edges (graph_id, src, dst, features), pairs (graph_id, i, j)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ("graph", "node", "edge", "nodepair")

_ROWS = 200_000  # rows that a task sorts and aggregates at a time, about


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows in partitions by key, of about _ROWS rows each: their number grows with the table, and a task's memory does not, as it does with a
    fixed number of partitions or with partitions that are joined until their files (not what is built from them) are large enough."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // _ROWS)), key)


def order_nodes(lineitem: DataFrame) -> DataFrame:
    """A node a line item; a graph an order. One shuffle on graph_id, into partitions of bounded size, which later joins on graph_id reuse."""
    order = Window.partitionBy("graph_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return dealt(lineitem.withColumn("graph_id", F.col("l_orderkey")), "graph_id").select(
        "graph_id", (F.row_number().over(order) - 1).alias("node_id"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"),
        F.col("l_discount").alias("d"), F.col("l_tax").alias("t"), F.col("l_returnflag").alias("flag"), "l_partkey", "l_suppkey",
    )


def path_edges(nodes: DataFrame) -> DataFrame:
    """Both directions between consecutive nodes of a graph, with features of both ends; from lead() and lag() over the order that the nodes already have, so there is no join."""
    w = Window.partitionBy("graph_id").orderBy("node_id")
    ends = lambda shift: F.lag(F.struct("q", "d", "t", "flag"), -shift).over(w)
    both = nodes.withColumns({"next": ends(1), "prev": ends(-1)})
    out = both.select("graph_id", F.col("node_id").alias("src"), F.col("q").alias("q_src"), F.col("d").alias("d_src"), F.col("flag").alias("flag_src"), F.explode(F.array(F.struct(F.lit(1).alias("step"), F.col("next").alias("o")), F.struct(F.lit(-1).alias("step"), F.col("prev").alias("o")))).alias("x"))
    return out.where("x.o is not null").select("graph_id", "src", (F.col("src") + F.col("x.step")).alias("dst"), "q_src", "d_src", F.col("x.o.q").alias("q_dst"), F.col("x.o.t").alias("t_dst"), (F.col("flag_src") == F.col("x.o.flag")).alias("same_flag"))


def path_steps(nodes: DataFrame) -> DataFrame:
    """Both directions between consecutive nodes of a graph, without features: it reads no more columns than the nodes' own order does, so that
    nodes and edges of one query share their exchange."""
    w = Window.partitionBy("graph_id").orderBy("node_id")
    both = nodes.select("graph_id", "node_id", F.array(F.lead("node_id").over(w), F.lag("node_id").over(w)).alias("near"))
    return both.select("graph_id", F.col("node_id").alias("src"), F.explode(F.array_compact("near")).alias("dst"))


def path_ends(nodes: DataFrame, feature: str = "x") -> DataFrame:
    """Both directions between consecutive nodes with the array `feature` of both ends as x_src and x_dst, and same_flag; no join, no exchange."""
    w = Window.partitionBy("graph_id").orderBy("node_id")
    ends = lambda shift: F.lag(F.struct(F.lit(-shift).alias("step"), F.col(feature).alias("x"), "flag"), shift).over(w)
    both = nodes.withColumns({"_a": ends(1), "_b": ends(-1)}).withColumn("_o", F.explode(F.array("_a", "_b"))).where("_o is not null")
    return both.select("graph_id", F.col("node_id").alias("src"), (F.col("node_id") + F.col("_o.step")).alias("dst"), F.col(feature).alias("x_src"), F.col("_o.x").alias("x_dst"), (F.col("flag") == F.col("_o.flag")).alias("same_flag"))


def gather(edges: DataFrame, nodes: DataFrame, end: str, columns: dict[str, str]) -> DataFrame:
    """edges with columns of the node at `end` (src or dst) under new names: x[src] as an equi-join."""
    side = nodes.select("graph_id", F.col("node_id").alias(end), *[F.col(c).alias(n) for c, n in columns.items()])
    return edges.join(side, ["graph_id", end])


def sent(edges: DataFrame, nodes: DataFrame, value: str, both: bool = False) -> DataFrame:
    """edges with the value of their sender as xs and, if asked for, of their receiver as xd: taken from columns <value>_src and
    <value>_dst where the edges carry them, else by joins."""
    for end, name in (("src", "xs"), ("dst", "xd"))[: 2 if both else 1]:
        edges = edges.withColumn(name, F.col(f"{value}_{end}")) if f"{value}_{end}" in edges.columns else gather(edges, nodes, end, {value: name})
    return edges


def scatter(edges: DataFrame, nodes: DataFrame, end: str, **aggregates: Column) -> DataFrame:
    """nodes with aggregates of the edges that end (or begin) there; null where there is none. Aggregates ignore nulls, for nodes and edges
    are one union and one aggregate, partial before its exchange; F.count("_edge") counts edges."""
    own = [c for c in nodes.columns if c not in ("graph_id", "node_id")]
    sent_ = edges.withColumn("_edge", F.lit(1)).drop("node_id").withColumnRenamed(end, "node_id")
    here = nodes.select("graph_id", "node_id", *[F.col(c).alias(f"_n_{c}") for c in own], F.lit(1).alias("_own"))
    rows = sent_.unionByName(here, allowMissingColumns=True)
    kept = [F.first(f"_n_{c}", ignorenulls=True).alias(c) for c in own]
    return rows.groupBy("graph_id", "node_id").agg(*kept, *[v.alias(k) for k, v in aggregates.items()], F.max("_own").alias("_own")).where("_own = 1").drop("_own")


def in_graph_pairs(nodes: DataFrame, columns: dict[str, str], upper: bool = False, max_nodes: int | None = None) -> DataFrame:
    """All (i, j) of each graph, i before j only if `upper`: an equi-join on graph_id. Graphs over `max_nodes` are an error, for
    pairs grow with the square of a graph's size."""
    if max_nodes is not None:
        size = F.count("*").over(Window.partitionBy("graph_id"))
        nodes = nodes.withColumn("n", size).withColumn("ok", F.when(F.col("n") > max_nodes, F.raise_error(F.lit(f"a graph has more than {max_nodes} nodes"))).otherwise(F.lit(True))).where("ok").drop("n", "ok")
    a = nodes.select("graph_id", F.col("node_id").alias("i"), *[F.col(c).alias(f"{n}_i") for c, n in columns.items()])
    b = nodes.select("graph_id", F.col("node_id").alias("j"), *[F.col(c).alias(f"{n}_j") for c, n in columns.items()])
    out = a.join(b, "graph_id")
    return out.where("i < j") if upper else out


def transfer(source: str, target: str) -> None:
    """Checks that features may go from one level to another: node to node, edge, nodepair; nodepair to node, edge, nodepair; graph to node."""
    if source not in LEVELS or target not in LEVELS:
        raise ValueError(f"levels are {LEVELS}, not {source!r} and {target!r}")
    legal = {"node": ("node", "edge", "nodepair"), "nodepair": ("node", "edge", "nodepair"), "graph": ("node",)}
    if target not in legal.get(source, ()):
        raise NotImplementedError(f"{source} to {target}")
