"""Packed batches: where each node of a pack of graphs lies, dense packs, and packing, collation and padding as one plan.

Packs come as a table (graph_id, n, pack_id), of collate.pack_fast or of packs.pack. A node's place is its number plus the sizes of the
graphs before its own in the pack, so only windows over a pack's graphs are needed, never over its nodes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import collate
from tessera.operators.splits import seeded


def starts(packs: DataFrame) -> DataFrame:
    """graph_id, n, pack_id, start: the place of each graph's first node in its pack, graphs in the order of their ids."""
    before = F.sum("n").over(Window.partitionBy("pack_id").orderBy("graph_id").rowsBetween(Window.unboundedPreceding, -1))
    return packs.select("graph_id", "n", "pack_id").withColumn("start", F.coalesce(before, F.lit(0)).cast("long"))


def index(nodes: DataFrame, packs: DataFrame) -> DataFrame:
    """nodes with pack_id and place. Graphs that are in no pack have no place and go."""
    at = starts(packs).select("graph_id", "pack_id", "start", "n")
    placed = nodes.join(at, "graph_id").withColumn("place", (F.col("start") + F.col("node_id")).cast("long"))
    over = F.col("node_id") >= F.col("n")
    return placed.withColumn("place", F.when(over, F.raise_error(F.lit("a node's number is beyond its graph's size")).cast("long")).otherwise(F.col("place"))).drop("start", "n")


def largest(packs: DataFrame, multiple: int = 1) -> int:
    """Nodes of the largest pack, rounded up to a multiple; one number reaches the driver. 0 without packs."""
    top = packs.groupBy("pack_id").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    return -(-int(top) // multiple) * multiple


def to_packed(placed: DataFrame, columns: list[str], size: int, fill: float = 0.0) -> DataFrame:
    """A row for each pack and slot 0..size-1: graph_id, node_id, columns (`fill` where no node is) and mask (whether one is). Slots of a
    pack come from one aggregate over it; a place beyond `size` is an error."""
    slot = F.when(F.col("place") >= size, F.raise_error(F.lit(f"a pack has more than {size} nodes")).cast("int")).otherwise(F.col("place")).cast("int")
    own = [c for c in ("graph_id", "node_id") if c not in columns]
    held = placed.groupBy("pack_id").agg(F.collect_list(F.struct(slot.alias("slot"), F.struct(*own, *columns).alias("x"))).alias("held"))
    # the slots without a node are found once a pack; to look each slot up among its nodes would take a pack's size squared
    free = F.array_except(F.sequence(F.lit(0), F.lit(size - 1)), F.col("held.slot"))
    twice = F.size(F.array_distinct("held.slot")) < F.size("held")
    free = F.when(twice, F.raise_error(F.lit("two nodes of a pack have one place")).cast("array<int>")).otherwise(free)
    none = F.lit(None).cast(held.schema["held"].dataType.elementType["x"].dataType)
    every = F.concat("held", F.transform(free, lambda k: F.struct(k.alias("slot"), none.alias("x"))))
    slots = held.select("pack_id", F.explode(every).alias("at")).select("pack_id", "at.slot", "at.x")
    x = F.col("x")
    return slots.select("pack_id", "slot", *[x[c].alias(c) for c in own], *[F.when(x.isNull(), F.lit(fill)).otherwise(x[c]).alias(c) for c in columns], x.isNotNull().alias("mask"))


def from_packed(dense: DataFrame, columns: list[str]) -> DataFrame:
    """The nodes of to_packed() again."""
    return dense.where("mask").select("graph_id", "node_id", *columns)


def attention_rows(packs: DataFrame, size: int) -> DataFrame:
    """pack_id, place, masked (array of `size` booleans): what the node at a place must not attend to. False inside its own graph, true
    elsewhere; made from the graph's start and size alone, without pairs."""
    rows = starts(packs).where("n > 0").select("pack_id", "start", "n", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("place"))
    same = lambda value, many: F.array_repeat(F.lit(value), F.greatest(many, F.lit(0)).cast("int"))
    outside = F.slice(F.concat(same(True, F.least(F.col("start"), F.lit(size))), same(False, F.col("n")), same(True, size - F.col("start") - F.col("n"))), 1, size)
    return rows.select("pack_id", "place", outside.alias("masked"))


def pad_pairs(row: Column, size: int, fill: float = 0.0) -> Column:
    """A node's row of pair features, one array a partner, as `size` arrays: fill beyond the partners that there are. An error where
    there are more. Of an empty row the arrays are empty."""
    width = F.coalesce(F.size(F.get(row, F.lit(0))), F.lit(0))
    lack = F.lit(size) - F.size(row)
    return F.when(lack < 0, F.raise_error(F.lit(f"a graph has more than {size} nodes")).cast("array<array<double>>")).otherwise(F.concat(row, F.array_repeat(F.array_repeat(F.lit(float(fill)), width), lack)))


@dataclass(frozen=True)
class Batch:
    """Three tables of equal shape for every pack: nodes, edges and graphs, each with a flag that tells what is real."""

    nodes: DataFrame
    edges: DataFrame
    graphs: DataFrame


def combined(nodes: DataFrame, edges: DataFrame, packs: DataFrame, columns: list[str], max_nodes: int, max_edges: int, max_graphs: int, labels: list[str] | None = None, node_fill: float = 0.0) -> Batch:
    """Packing, collation and padding in one plan.

    nodes: pack_id, place, columns, node_is_true, max_nodes a pack; edges: pack_id, slot, src, dst (places), edge_is_true, max_edges a
    pack; graphs: pack_id, slot, graph_id, n and the `labels` that packs carries, graph_is_true, max_graphs a pack. Padding is one graph more
    (so a pack holds max_graphs - 1 at most): its nodes hold node_fill, its edges are loops at the pack's last slot, and its label
    is null. Packs with more than fits, or with padding edges and no padding node, are an error.
    """
    at = starts(packs).join(packs.select("graph_id", *(labels or [])), "graph_id")
    placed = nodes.select("graph_id", "node_id", *columns).join(at.select("graph_id", "pack_id", "start"), "graph_id").withColumn("place", F.col("start") + F.col("node_id"))
    dense = to_packed(placed, columns, max_nodes, node_fill).withColumnsRenamed({"slot": "place", "mask": "node_is_true"}).drop("graph_id", "node_id")
    moved = edges.select("graph_id", "src", "dst").join(at.select("graph_id", "pack_id", "start"), "graph_id").select("pack_id", F.struct((F.col("start") + F.col("src")).alias("src"), (F.col("start") + F.col("dst")).alias("dst")).alias("e"))
    ends = moved.groupBy("pack_id").agg(F.sort_array(F.collect_list("e")).alias("e"))
    total = at.groupBy("pack_id").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("graph_id", "n", *(labels or [])))).alias("g"))
    packed = total.join(ends, "pack_id", "left").withColumn("e", F.coalesce("e", F.array().cast("array<struct<src:bigint,dst:bigint>>")))
    wrong = F.when(F.size("e") > max_edges, F.lit(f"a pack has more than {max_edges} edges")).when((F.size("e") < max_edges) & (F.col("n") >= max_nodes), F.lit("a pack has padding edges and no node for them")).when(F.size("g") >= max_graphs, F.lit(f"a pack has more than {max_graphs - 1} graphs and its padding"))
    checked = {c: F.when(wrong.isNotNull(), F.raise_error(wrong).cast(packed.schema[c].dataType)).otherwise(F.col(c)) for c in ("e", "g")}  # either table alone finds what is wrong
    packed = packed.withColumns(checked)
    slot = lambda most: F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("slot")
    e = F.get("e", F.col("slot"))
    edge = packed.select("pack_id", "e", slot(max_edges)).select("pack_id", "slot", *[F.coalesce(e[c], F.lit(max_nodes - 1)).cast("long").alias(c) for c in ("src", "dst")], e.isNotNull().alias("edge_is_true"))
    g = F.get("g", F.col("slot"))
    pad = F.when(F.col("slot") == F.size("g"), F.lit(max_nodes) - F.col("n")).otherwise(F.lit(0))
    graph = packed.select("pack_id", "g", "n", slot(max_graphs)).select("pack_id", "slot", g["graph_id"].alias("graph_id"), F.coalesce(g["n"], pad).cast("long").alias("n"), *[g[c].alias(c) for c in labels or []], g.isNotNull().alias("graph_is_true"))
    return Batch(dense, edge, graph)


def estimate_largest(sizes: DataFrame, key: str, n: str, batch: int, combined_batch: int, trials: int, seed: int = 0) -> DataFrame:
    """trial, n_batches, largest: how many nodes the largest pack has when graphs are shuffled, cut into combined batches (the last one only
    if full), and each is packed fast into combined_batch / batch packs; one row a seeded trial.

    A trial's order is a total one over ranges; all that follows stays within one combined batch. No row where no combined batch is full."""
    if combined_batch % batch:
        raise ValueError("a combined batch holds a whole number of batches")
    count = combined_batch // batch
    rows = sizes.select(F.col(key).alias("key"), F.col(n).alias("n"), F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial")).withColumn("turn", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("trial").cast("string"), F.col("key").cast("string"))))
    numbered = collate._numbered(rows, [F.col("trial"), F.col("turn"), F.col("key")])
    first = numbered.groupBy("trial").agg(F.min("rn").alias("first"))
    own = numbered.join(F.broadcast(first), "trial").withColumn("lot", F.floor((F.col("rn") - F.col("first")) / combined_batch))
    lot = Window.partitionBy("trial", "lot")
    own = own.withColumn("held", F.count("*").over(lot)).where(F.col("held") == combined_batch)
    own = own.withColumn("stratum", F.floor((F.row_number().over(lot.orderBy("n", "key")) - 1) / count))
    own = own.withColumn("pack", F.row_number().over(Window.partitionBy("trial", "lot", "stratum").orderBy(seeded(seed, F.col("turn")), "key")))
    packs = own.groupBy("trial", "lot", "pack").agg(F.sum("n").alias("total"))
    return packs.groupBy("trial").agg(F.countDistinct("lot").alias("n_batches"), F.max("total").alias("largest"))
