"""Batches, dense indices, packs and padding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.splits import seeded


def _numbered(rows: DataFrame, order: list, blocks: int = 200) -> DataFrame:
    """rows with rn from 0 in the given order. Rows are dealt out by ranges of the order, numbered within a range, and shifted by
    the ranges before; so a total order needs no task that sees all rows.

    The dealt rows are read twice. They are persisted, for the ranges come from a sample and a second exchange might draw
    others; what is lost with an executor is dealt again by the same ranges."""
    dealt = rows.repartitionByRange(blocks, *order).withColumn("_p", F.spark_partition_id()).persist()
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return dealt.withColumn("_own", own).join(F.broadcast(sizes), "_p").withColumn("rn", (F.col("_own") + F.col("_before")).cast("long")).drop("_own", "_before", "_p")


def batched(sizes: DataFrame, key: str, batch: int, n: str) -> DataFrame:
    """Graphs in the order of their key in batches of `batch`: rn, batch_id, and node_offset of each graph in its batch."""
    out = _numbered(sizes, [F.col(key)]).withColumn("batch_id", F.floor(F.col("rn") / batch))
    before = F.sum(n).over(Window.partitionBy("batch_id").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("node_offset", F.coalesce(before, F.lit(0)))


def fill_slots(keys: DataFrame, long: DataFrame, key: str, tasks: list[str]) -> DataFrame:
    """A row for every key and task, its label NULL where there is none."""
    return keys.withColumn("task", F.explode(F.array(*[F.lit(t) for t in tasks]))).join(long, [key, "task"], "left")


def dense_index(nodes: DataFrame, most: int) -> DataFrame:
    """idx: a node's place in a dense batch of graphs with `most` rows each."""
    ids = _numbered(nodes.select("graph_id").distinct(), [F.col("graph_id")]).withColumnRenamed("rn", "batch")
    return nodes.select("graph_id", "node_id").join(ids, "graph_id").select("graph_id", "node_id", (F.col("batch") * most + F.col("node_id")).alias("idx"))


def pack_fast(sizes: DataFrame, key: str, n: str, packs: int, seed: int) -> DataFrame:
    """Graphs sorted by size, cut into strata of `packs` graphs, each stratum dealt at random over the packs; a last stratum that
    is not full goes to the first packs of its order."""
    out = _numbered(sizes, [F.col(n), F.col(key)]).withColumn("stratum", F.floor(F.col("rn") / packs))
    place = F.row_number().over(Window.partitionBy("stratum").orderBy(seeded(seed, F.col(key)), key)) - 1
    return out.withColumn("pack_id", place.cast("long")).drop("rn")


def filler(rows: DataFrame, pack: str, size: int) -> DataFrame:
    """How many rows each pack lacks to `size`; an error where it has more."""
    out = rows.groupBy(pack).agg(F.count("*").alias("n_nodes"))
    lack = F.when(F.col("n_nodes") > size, F.raise_error(F.lit(f"a pack has more than {size} nodes")).cast("long")).otherwise(size - F.col("n_nodes"))
    return out.withColumn("n_fill", lack)


def to_dense(nodes: DataFrame, columns: list[str], most: int, fill: float = 0.0) -> DataFrame:
    """A row for each graph and slot 0..most-1: its columns, `fill` where no node is, and mask (whether one is). An error where a
    node's number reaches `most`. A graph's slots come from one aggregate, so nothing is joined."""
    over = F.when(F.col("node_id") >= most, F.raise_error(F.lit(f"a graph has more than {most} nodes")).cast("int")).otherwise(F.col("node_id"))
    held = nodes.groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct(over.cast("int").alias("slot"), F.struct(*columns).alias("x")))).alias("m"))
    slots = held.select("graph_id", "m", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("slot"))
    x = F.col("m")[F.col("slot")]
    return slots.select("graph_id", "slot", *[F.when(x.isNull(), F.lit(fill)).otherwise(x[c]).alias(c) for c in columns], x.isNotNull().alias("mask"))


def from_dense(dense: DataFrame, columns: list[str]) -> DataFrame:
    """The nodes of to_dense() again: the slots under the mask."""
    return dense.where("mask").select("graph_id", F.col("slot").alias("node_id"), *columns)
