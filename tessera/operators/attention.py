"""Biased multi-head attention inside graphs, by tiles: softmax sums that can be merged, so no table of node pairs is stored.

A graph's nodes are dealt over tiles of about `tile` nodes. Every tile of queries meets every tile of keys of its graph, one row for
two tiles, and gives for each query and head the maximum score, the sum of exp(score - maximum) and the sum of values weighed by it.
Two such triples of a query merge into one, so tiles may be met in any order and place. Rows are joined on (graph, tile of keys):
a graph that holds a third of all nodes is spread over as many tasks as it has tiles, and a task holds two tiles at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DistanceBias:
    """Gaussian kernels of the distance between two nodes, and what each adds to the scores of each head."""

    centres: list[float]
    widths: list[float]
    weights: list[list[float]]  # a row a kernel, a column a head
    _sigma: np.ndarray = field(init=False, repr=False)

    def __post_init__(self) -> None:
        if not len(self.centres) == len(self.widths) == len(self.weights):
            raise ValueError("a centre, a width and a row of weights for each kernel")
        object.__setattr__(self, "_sigma", np.abs(np.array(self.widths, float)) + 0.01)

    def kernels(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """[kernels, a, b]; 0 where a position is missing, so that a graph without positions has no bias."""
        apart = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
        z = (apart[None] - np.array(self.centres)[:, None, None]) / self._sigma[:, None, None]
        return np.nan_to_num(np.exp(-0.5 * z * z) / (np.sqrt(2 * np.pi) * self._sigma)[:, None, None], nan=0.0)


def tiles(nodes: DataFrame, columns: list[str], tile: int) -> DataFrame:
    """graph_id, tile, ids, and each column (an array) of the tile's nodes as an array of arrays, in the order of ids. A graph has as many tiles
    as its nodes fill, and a node's tile is drawn by its number; so tiles are about full whatever numbers a graph's nodes have."""
    size = nodes.groupBy("graph_id").agg(F.ceil(F.count("*") / tile).alias("_tiles"))
    rows = nodes.join(size, "graph_id").select("graph_id", F.pmod(F.xxhash64(F.col("node_id").cast("long")), F.col("_tiles")).alias("tile"), F.struct(F.col("node_id").cast("long").alias("id"), *columns).alias("x"))
    own = rows.groupBy("graph_id", "tile").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return own.select("graph_id", "tile", F.col("x.id").alias("ids"), *[F.col(f"x.{c}").alias(c) for c in columns])


def met(own: DataFrame, queries: list[str], keys: list[str]) -> DataFrame:
    """A row for each two tiles of a graph: ids and columns `queries` of one, columns `keys` of the other as k_<name>."""
    per_graph = own.groupBy("graph_id").agg(F.collect_list("tile").alias("tiles"))
    asking = own.select("graph_id", "ids", *queries).join(per_graph, "graph_id").withColumn("tile", F.explode("tiles")).drop("tiles")
    return asking.join(own.select("graph_id", "tile", *[F.col(c).alias(f"k_{c}") for c in keys]), ["graph_id", "tile"])


def _matrix(column: pa.Array, row: int, width: int) -> np.ndarray:
    """A tile's array of arrays as a matrix; null arrays and entries are NaN."""
    inner = column[row].values
    if inner.null_count == 0 and inner.flatten().null_count == 0:
        return inner.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    return np.array([[np.nan if v is None else v for v in x] if x else [np.nan] * width for x in inner.to_pylist()], float).reshape(-1, width)


def _lists(x: np.ndarray) -> pa.Array:
    """A list for each row of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel(), pa.float64()))


def attend(nodes: DataFrame, heads: int, head_dim: int, value_dim: int, bias: DistanceBias | None = None, scale: float | None = None, dims: int = 3, tile: int = 256) -> DataFrame:
    """A row a node: graph_id, node_id, h (array: head by head, `value_dim` entries each) and, with a bias, near (array: the sum of each
    kernel over the graph's keys that are not masked).

    nodes: graph_id, node_id (one row each), q and k (arrays of heads * head_dim numbers), v (heads * value_dim), masked (boolean,
    null: not masked) and, with a bias, position (array of `dims` numbers; null or with null or NaN entries: no bias for its pairs). Scores are
    scale * q.k + bias, scale 1 / head_dim unless given; masked nodes are no keys but ask like the others. A node that
    has no key gets null in h and zeros in near. Entries of q, k and v must not be null. Graphs of any size: a task holds two
    tiles, and what is shuffled is the queries once for each tile of keys of their graph.
    """
    scale = 1 / head_dim if scale is None else scale
    kernels = len(bias.centres) if bias else 0
    weights = np.array(bias.weights, float).reshape(kernels, heads) if bias else np.zeros((0, heads))
    space = ["position"] if bias else []
    rows = nodes.select("graph_id", "node_id", *[F.col(c).cast("array<double>").alias(c) for c in ["q", "k", "v", *space]], F.array(F.coalesce("masked", F.lit(False)).cast("double")).alias("masked"))
    own = tiles(rows, ["q", "k", "v", "masked", *space], tile)
    pairs = met(own, ["q", *space], ["k", "v", "masked", *space])
    names = pairs.columns
    schema = "graph_id long, node_id long, m array<double>, s array<double>, w array<double>, near array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {c: batch.column(names.index(c)) for c in names}
            for r in range(batch.num_rows):
                q, k, v = _matrix(column["q"], r, heads * head_dim), _matrix(column["k_k"], r, heads * head_dim), _matrix(column["k_v"], r, heads * value_dim)
                seen = _matrix(column["k_masked"], r, 1)[:, 0] == 0
                n = len(q)
                if not seen.any():
                    continue
                score = scale * (q.reshape(n, heads, head_dim).transpose(1, 0, 2) @ k[seen].reshape(-1, heads, head_dim).transpose(1, 2, 0))
                near = np.zeros((n, kernels))
                if bias:
                    g = bias.kernels(_matrix(column["position"], r, dims), _matrix(column["k_position"], r, dims)[seen])
                    near = g.sum(axis=2).T
                    score += np.tensordot(weights, g, (0, 0))
                m = score.max(axis=2)
                e = np.exp(score - m[:, :, None])
                w = (e @ v[seen].reshape(-1, heads, value_dim).transpose(1, 0, 2)).transpose(1, 0, 2)
                lists = [_lists(x) for x in (m.T, e.sum(axis=2).T, w.reshape(n, -1), near)]
                yield pa.RecordBatch.from_arrays([pa.array([column["graph_id"][r].as_py()] * n, pa.int64()), column["ids"][r].values, *lists], names=["graph_id", "node_id", "m", "s", "w", "near"])

    parts = pairs.withColumn("graph_id", F.col("graph_id").cast("long")).mapInArrow(run, schema)
    total = parts.groupBy("graph_id", "node_id").agg(F.collect_list(F.struct("m", "s", "w", "near")).alias("parts"))
    one = F.reduce(F.slice("parts", 2, F.size("parts")), F.get("parts", F.lit(0)), lambda a, b: _merged(a, b, value_dim))
    done = total.select("graph_id", "node_id", one.alias("t"))
    h = F.transform("t.w", lambda x, i: x / F.get(F.col("t.s"), F.floor(i / value_dim).cast("int")))
    out = nodes.select(F.col("graph_id").cast("long").alias("graph_id"), F.col("node_id").cast("long").alias("node_id")).join(done, ["graph_id", "node_id"], "left")
    near = [F.coalesce("t.near", F.array_repeat(F.lit(0.0), kernels)).alias("near")] if bias else []
    return out.select("graph_id", "node_id", h.alias("h"), *near)


def _merged(a, b, value_dim: int):
    """Two triples of a query as one: both sums are brought to the larger maximum of each head."""
    m = F.zip_with(a["m"], b["m"], lambda x, y: F.greatest(x, y))
    shrink = lambda t: F.zip_with(t["m"], m, lambda x, y: F.exp(x - y))
    add = lambda x, y: F.zip_with(x, y, lambda p, q: p + q)
    s = lambda t: F.zip_with(t["s"], shrink(t), lambda x, f: x * f)
    w = lambda t: F.transform(t["w"], lambda x, i: x * F.get(shrink(t), F.floor(i / value_dim).cast("int")))
    return F.struct(m.alias("m"), add(s(a), s(b)).alias("s"), add(w(a), w(b)).alias("w"), add(a["near"], b["near"]).alias("near"))
