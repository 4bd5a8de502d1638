"""Connected components of an edge table by alternating large and small stars, each round written to the shared folder.

Every step is a join on a minimum that was summed before the shuffle; no vertex's neighbours are ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is tied to the least of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are tied to the least of them."""
    down = edges.where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u")
    return tied.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """node, component (the least node it is connected to) for every node of links but the least of each component itself.

    Links of a node with itself and null ends are ignored; repeated links count once. No links: an empty table.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = saved(edges, "edges")
    state = _state(edges)
    for _ in range(rounds):
        if not state[0]:
            break
        edges = saved(_small_star(_large_star(edges).distinct()).distinct(), "edges")
        new = _state(edges)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _state(edges: DataFrame) -> tuple:
    """A checksum of the set of edges; the stars have settled when it stays."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())
