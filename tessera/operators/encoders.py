"""Encoders of Laplacian eigenvectors with given weights, as expressions over array columns, and stages whose outputs become fingerprints.

An eigenvector's sign is arbitrary. Each encoder here either adds what both signs give, so that the result does not depend on it, or
flips signs at random by a seed, as training does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import attention, message, nn, pooling
from tessera.operators.splits import seeded

Layer = tuple[list[list[float]], list[float] | None, str]


def mlp(x: Column, layers: list[Layer]) -> Column:
    """Layers (weight, bias, activation) over an array column; for a few dozen numbers a layer, beyond that nn.mlp."""
    for weight, bias, act in layers:
        x = nn.linear(x, weight, bias, act)
    return x


def _sum(rows: Column, width: int) -> Column:
    return F.aggregate(rows, F.array(*[F.lit(0.0)] * width), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))


def flips(seed: int, graph: Column, k: Column) -> Column:
    """1 or -1 for each graph and eigenvector."""
    return F.when(F.conv(F.substring(seeded(seed, graph, k), 1, 1), 16, 10).cast("int") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def laplacian_encoder(pe: DataFrame, phi: list[Layer], rho: list[Layer], values: str = "values", vectors: str = "vectors", signs: str = "both", seed: int = 0) -> DataFrame:
    """A row a node: graph_id, node_id, h = rho(sum over eigenvectors of phi([value, entry])).

    signs: `both` adds phi of both signs, `random` flips each graph's eigenvectors by the seed, `given` takes them as they are. Null
    entries (a graph has fewer eigenvectors) are masked: they add nothing. A node without any gets rho of zeros.
    """
    if signs not in ("both", "random", "given"):
        raise ValueError(f"signs are both, random or given, not {signs!r}")
    width = len(phi[-1][0])
    pairs = F.filter(F.zip_with(values, vectors, lambda w, v: F.struct(w.alias("w"), v.alias("v"))), lambda x: x["w"].isNotNull() & x["v"].isNotNull() & ~F.isnan(x["v"]))
    if signs == "random":
        pairs = F.transform(pairs, lambda x, k: F.struct(x["w"].alias("w"), (x["v"] * flips(seed, F.col("graph_id"), k)).alias("v")))
    one = lambda x: mlp(F.array(x["w"], x["v"]), phi)
    both = lambda x: F.zip_with(one(x), mlp(F.array(x["w"], -x["v"]), phi), lambda p, q: p + q)
    total = _sum(F.transform(pairs, both if signs == "both" else one), width)
    return pe.select("graph_id", "node_id", mlp(total, rho).alias("h"))


def sign_net(pe: DataFrame, edges: DataFrame, layers: list[list[Layer]], rho: list[Layer], num_pos: int, vectors: str = "vectors", eps: float = 0.0) -> DataFrame:
    """A row a node: graph_id, node_id, h = rho(concatenation over eigenvectors of phi(v) + phi(-v)), phi a stack of graph layers
    x_i <- MLP((1 + eps) x_i + sum of the neighbours' x).

    Both signs of all num_pos eigenvectors go through each layer side by side in one array, so a layer is one gather and one aggregate
    whatever their number. Eigenvectors that a graph does not have (null) count as zeros on the way and give zeros in the end.
    """
    there = F.transform(F.col(vectors), lambda v: v.isNotNull() & ~F.isnan(v))
    entry = F.transform(F.col(vectors), lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))
    rows = pe.select("graph_id", "node_id", F.concat(entry, F.transform(entry, lambda v: -v)).alias("x"), there.alias("there"))
    mask = rows.select("graph_id", "node_id", "there")
    width = 1
    for layer in layers:
        size = 2 * num_pos * width
        sent = message.with_ends(edges.select("graph_id", "src", "dst"), rows, "x")
        summed = message.mpnn_plus(rows, sent, size, gather_from="senders", scatter_to="receivers")
        both = rows.select("graph_id", "node_id", "x").join(summed, ["graph_id", "node_id"])
        s = F.zip_with("x", "h", lambda x, h: (1 + eps) * x + h)
        each = _blocks(s, 2 * num_pos, width, layer)
        rows, width = both.select("graph_id", "node_id", each.alias("x")), len(layer[-1][0])
    half = num_pos * width
    added = F.zip_with(F.slice("x", 1, half), F.slice("x", half + 1, half), lambda p, q: p + q)
    kept = F.transform(added, lambda v, i: F.when(F.get("there", F.floor(i / width).cast("int")), v).otherwise(F.lit(0.0)))
    return rows.join(mask, ["graph_id", "node_id"]).select("graph_id", "node_id", mlp(kept, rho).alias("h"))


def _blocks(x: Column, blocks: int, width: int, layer: list[Layer]) -> Column:
    """The layer over each block of `width` numbers of an array, results in a row."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: mlp(F.slice(x, k * width + 1, F.lit(width)), layer)))


def pool_outputs(outputs: list[DataFrame], width: int, how: str = "sum", existing: DataFrame | None = None, column: str = "x", keys: tuple[str, ...] = ("graph_id", "node_id")) -> DataFrame:
    """keys and h: the arrays of several encoders that share an output, pooled entry by entry (sum, mean, max, min) over the encoders that have
    the key, after the feature that is there already (a key that only one side has gets zeros for the other). One union and one
    aggregate, whatever the number of encoders."""
    if how not in ("sum", "mean", "max", "min"):
        raise ValueError(f"outputs are pooled by sum, mean, max or min, not {how!r}")
    flat = lambda df: [*keys, *[F.get(column, F.lit(k)).alias(f"_{k}") for k in range(width)]]
    rows = None
    for df in outputs:
        own = df.select(*flat(df))
        rows = own if rows is None else rows.union(own)
    if rows is None:
        raise ValueError("there is nothing to pool")
    pooled = rows.groupBy(*keys).agg(*[message.aggregator(how, F.col(f"_{k}")).alias(f"_{k}") for k in range(width)]).select(*keys, F.array(*[F.col(f"_{k}") for k in range(width)]).alias("h"))
    if existing is None:
        return pooled
    known = existing.select(*keys, F.col(column).alias("_x"))
    size = F.coalesce(F.size("_x"), F.lit(existing.select(F.max(F.size(column))).first()[0] or 0))
    both = known.join(pooled, list(keys), "full")
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    return both.select(*keys, F.concat(F.coalesce("_x", zeros(size)), F.coalesce("h", zeros(F.lit(width)))).alias("h"))


def gps(nodes: DataFrame, edges: DataFrame, width: int, heads: int, weights: dict[str, list[list[float]]], feed_forward: list[Layer], scale: float | None = None, tile: int = 256) -> DataFrame:
    """A row a node: graph_id, node_id, h of a local-global block: the sum of the neighbours' vectors, plus attention over the whole graph
    with the input added to it, and then a feed-forward part added to their sum.

    nodes: graph_id, node_id, x (array of `width`), masked (optional: not attended to); edges: graph_id, src, dst, x_src, x_dst.
    weights: q, k, v and o, square matrices of `width`; heads must divide it.
    """
    if width % heads:
        raise ValueError("heads divide the width")
    local = message.mpnn_plus(nodes, edges, width, gather_from="senders", scatter_to="receivers").withColumnRenamed("h", "local")
    asked = nodes.select("graph_id", "node_id", *[nn.linear(F.col("x"), weights[c]).alias(c) for c in "qkv"], (F.col("masked") if "masked" in nodes.columns else F.lit(False)).alias("masked"))
    seen = attention.attend(asked, heads, width // heads, width // heads, scale=scale, tile=tile).select("graph_id", "node_id", F.coalesce("h", F.array_repeat(F.lit(0.0), width)).alias("seen"))
    both = nodes.select("graph_id", "node_id", "x").join(local, ["graph_id", "node_id"]).join(seen, ["graph_id", "node_id"])
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    h = both.select("graph_id", "node_id", add("local", add("x", nn.linear(F.col("seen"), weights["o"]))).alias("h"))
    return h.select("graph_id", "node_id", add("h", mlp(F.col("h"), feed_forward)).alias("h"))


Stage = Callable[[DataFrame], DataFrame]


def fingerprints(rows: DataFrame, stages: list[tuple[str, Stage]], at: dict[str, tuple[str, ...]], width: dict[str, int], column: str = "x") -> DataFrame:
    """graph_id and fingerprint (array): the outputs of named stages of a chain, pooled over a graph's nodes and concatenated in the order of `at`.

    stages: (name, function from table to table), each giving graph_id, node_id and the array `column`; at: stage -> how it is pooled (names
    of pooling.pool); width: numbers in that stage's array. Stages after the last one asked for are not run. A name that is no stage
    is an error, as is a stage that is named twice.
    """
    names = [n for n, _ in stages]
    if len(set(names)) < len(names) or set(at) - set(names) or not at:
        raise ValueError(f"stages are {names}, asked for are {list(at)}")
    last = max(names.index(n) for n in at)
    seen: dict[str, DataFrame] = {}
    for name, stage in stages[: last + 1]:
        rows = stage(rows)
        if name in at:
            seen[name] = rows
    wide = None
    for name in at:
        flat = seen[name].select("graph_id", *[F.get(column, F.lit(k)).alias(f"{name}_{k}") for k in range(width[name])])
        wide = flat if wide is None else wide.unionByName(flat, allowMissingColumns=True)  # aggregates ignore nulls, so stages need not meet node by node
    cells = [(name, how, k) for name, hows in at.items() for how in hows for k in range(width[name])]
    pooled = wide.groupBy("graph_id").agg(*[pooling.pooled(how, F.col(f"{name}_{k}")).alias(f"_{i}") for i, (name, how, k) in enumerate(cells)])
    return pooled.select("graph_id", F.array(*[F.col(f"_{i}") for i in range(len(cells))]).alias("fingerprint"))
