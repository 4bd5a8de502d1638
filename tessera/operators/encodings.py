"""Positional and structural encodings: dense linear algebra over one small graph at a time.

Nodes and edges of a graph are gathered into arrays with one aggregate each (a graph has at most `max_nodes` nodes, so a row is
bounded), and Arrow batches of many graphs go through numpy. Eigenvectors are made unique by making each one's entry of the
largest magnitude positive; disconnected graphs are treated component by component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Kernel = Callable[[np.ndarray], np.ndarray]


def adjacency(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    a = np.zeros((n, n))
    np.add.at(a, (src, dst), 1.0 if weight is None else weight)
    return a


def components(a: np.ndarray) -> np.ndarray:
    """Number of each node's component, by the least node in it."""
    label = np.arange(len(a))
    linked = (a + a.T) > 0
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(a)).min(axis=1, initial=len(a)))
        if (new == label).all():
            return label
        label = new


def normalised(a: np.ndarray, m: np.ndarray, how: str) -> np.ndarray:
    """none; sym: D^-1/2 m D^-1/2; inv: D^-1 m. One over a degree of 0 counts as 0."""
    if how not in ("none", "sym", "inv"):
        raise ValueError(f"normalisation is none, sym or inv, not {how!r}")
    deg = a.sum(axis=1)
    inverse = np.where(deg > 0, 1 / np.where(deg > 0, deg, 1), 0.0)
    if how == "sym":
        return np.sqrt(inverse)[:, None] * m * np.sqrt(inverse)[None, :]
    return inverse[:, None] * m if how == "inv" else m


def laplacian(a: np.ndarray) -> np.ndarray:
    return np.diag(a.sum(axis=1)) - a


def laplacian_eigen(a: np.ndarray, num_pos: int, how: str = "none") -> tuple[np.ndarray, np.ndarray]:
    """The num_pos lowest eigenvalues and eigenvectors for each node, of its component; 0 where a component has fewer."""
    n, part = len(a), components(a)
    values, vectors = np.zeros((n, num_pos)), np.zeros((n, num_pos))
    for c in np.unique(part):
        own = np.flatnonzero(part == c)
        sub = a[np.ix_(own, own)]
        m = normalised(sub, laplacian(sub), "sym" if how == "inv" else how)  # similar matrices: inv has the values of sym
        w, v = np.linalg.eigh((m + m.T) / 2)
        if how == "inv":
            deg = sub.sum(axis=1)
            v = v * np.sqrt(np.where(deg > 0, 1 / np.where(deg > 0, deg, 1), 0.0))[:, None]
        v = v / np.maximum(np.linalg.norm(v, axis=0), 1e-4)
        v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(len(w))] < 0, -1, 1)
        k = min(num_pos, len(w))
        values[own, :k], vectors[np.ix_(own, np.arange(k))] = w[:k], v[:, :k]
    return values, vectors


def walk_return(a: np.ndarray, steps: list[int], space_dim: float = 0) -> np.ndarray:
    """Probability of being back after k steps, times k^(space_dim / 2); a graph of one node is always back."""
    if len(a) == 1:
        return np.ones((1, len(steps)))
    p = normalised(a, a, "inv")
    return np.stack([np.diag(np.linalg.matrix_power(p, k)) * k ** (space_dim / 2) for k in steps], axis=1)


def commute(a: np.ndarray) -> np.ndarray:
    pinv = np.linalg.pinv(laplacian(a))
    d = np.diag(pinv)
    return a.sum() * (d[:, None] + d[None, :] - 2 * pinv)


def electrostatic(a: np.ndarray) -> np.ndarray:
    pinv = np.linalg.pinv(laplacian(a))
    return pinv - np.diag(pinv)[None, :]


def hops(a: np.ndarray) -> np.ndarray:
    """Shortest path lengths; NaN between components. A breadth-first search from all nodes at once over lists of neighbours: each
    pair (source, node) is looked at once, so the work is nodes times edges whatever the paths' lengths."""
    n = len(a)
    out = np.full((n, n), np.nan)
    src, near = np.nonzero(a > 0)
    begin = np.searchsorted(src, np.arange(n + 1))
    source = at = np.arange(n)
    step = 0
    while len(at):
        out[source, at] = step
        many = begin[at + 1] - begin[at]
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        source, at = np.repeat(source, many), near[np.repeat(begin[at], many) + place]
        new = np.unique((source * n + at)[np.isnan(out[source, at])])
        source, at = np.divmod(new, max(n, 1))
        step += 1
    return out


_CELLS = 200_000  # numbers that a task holds before it hands on a batch
_KEPT = 500_000  # numbers of results, and of keys, that a task keeps for graphs that are equal to earlier ones


class Once:
    """make(n, src, dst) for graphs of Arrow batches. Equal graphs (the same number of nodes and the same edges in any order) of a task share
    one result, for what is made depends on nothing else; what is kept is dropped when it grows beyond _KEPT numbers."""

    def __init__(self, make: Callable[[int, np.ndarray, np.ndarray], object], size: Callable[[object], int]):
        self.make, self.size, self.kept, self.held = make, size, {}, 0

    def over(self, batch: pa.RecordBatch, skip: Callable[[int], bool] = lambda r: False) -> Iterator[tuple[int, object]]:
        """graph_id and result of each row (graph_id, n, src, dst and others) of a batch, None for rows to skip; edges are in the order of src and dst."""
        n = batch.column(1).to_numpy().astype(np.int64)
        cuts = batch.column(2).offsets.to_numpy()
        src, dst = (batch.column(c).values.to_numpy(zero_copy_only=False)[cuts[0] : cuts[-1]].astype(np.int64) for c in (2, 3))
        cuts = cuts - cuts[0]
        row = np.repeat(np.arange(len(n)), np.diff(cuts))
        order = np.lexsort((dst, src, row))
        src, dst = src[order], dst[order]
        code = src * n[row] + dst
        for r, (g, k, a, b) in enumerate(zip(batch.column(0).to_pylist(), n.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if skip(r):
                yield g, None
                continue
            key = (k, code[a:b].tobytes())
            if key not in self.kept:
                out = self.make(k, src[a:b], dst[a:b])
                size = self.size(out) + b - a + 16
                if self.held + size > _KEPT:
                    self.kept, self.held = {}, 0
                self.kept[key] = out
                self.held += size
            yield g, self.kept[key]


class Batch:
    """Graphs that wait to be handed on: each distinct result once, and for each graph which one it has; so rows of equal graphs are copied by
    Arrow (take), not put together one by one."""

    def __init__(self):
        self.ids, self.at, self.made, self.place, self.cells = [], [], [], {}, 0

    def add(self, graph: int, made: object, cells: int) -> bool:
        """Takes a graph in; True once _CELLS numbers are reached."""
        at = self.place.get(id(made))
        if at is None:
            at = self.place[id(made)] = len(self.made)
            self.made.append(made)
        self.ids.append(graph)
        self.at.append(at)
        self.cells += cells
        return self.cells >= _CELLS

    def rows(self, sizes: np.ndarray, columns: list[pa.Array], names: list[str]) -> pa.RecordBatch:
        """graph_id and columns of all graphs; columns hold the rows of the distinct results one after another, sizes how many rows each has."""
        at = np.array(self.at)
        cuts = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        graph = np.repeat(np.array(self.ids, np.int64), np.asarray(sizes)[at])
        taken = [pa.ListArray.from_arrays(cuts, c).take(pa.array(at)).flatten() for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(graph), *taken], names=["graph_id", *names])


def gathered(nodes: DataFrame, edges: DataFrame, max_nodes: int) -> DataFrame:
    """graph_id, n, src, dst: a row a graph with the ends of its edges; a graph over `max_nodes` is an error."""
    size = nodes.groupBy("graph_id").agg((F.max("node_id") + 1).alias("n"))
    size = size.withColumn("n", F.when(F.col("n") > max_nodes, F.raise_error(F.lit(f"a graph has more than {max_nodes} nodes")).cast("int")).otherwise(F.col("n")))
    ends = edges.groupBy("graph_id").agg(F.collect_list("src").alias("src"), F.collect_list("dst").alias("dst"))
    return size.join(ends, "graph_id", "left")


def encode(nodes: DataFrame, edges: DataFrame, kernel: Kernel, level: str = "node", max_nodes: int = 512) -> DataFrame:
    """kernel(adjacency) for every graph: [N, F] gives a row a node (graph_id, node_id, pe), [N, N] a row a pair (graph_id, i, j, v);
    NaN becomes NULL in pairs. Graphs without nodes give nothing. A kernel depends on its adjacency alone, and runs once for equal graphs of a task. A task holds one graph's result and a bounded batch of others."""
    if level not in ("node", "nodepair"):
        raise ValueError(f"kernels give node or nodepair features, not {level!r}")
    node = level == "node"
    schema = "graph_id long, node_id int, pe array<double>" if node else "graph_id long, i int, j int, v double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = Batch()
        once = Once(lambda n, src, dst: np.asarray(kernel(adjacency(n, src, dst)), float), np.size)
        for batch in batches:
            for g, out in once.over(batch):
                if waiting.add(g, out, out.size):
                    yield handed(waiting)
                    waiting = Batch()
        if waiting.ids:
            yield handed(waiting)

    def handed(waiting: Batch) -> pa.RecordBatch:
        parts = waiting.made
        sizes = np.array([len(out) if node else len(out) ** 2 for out in parts])
        values = np.concatenate([out.ravel() for out in parts])
        numbers = np.concatenate([np.arange(k) for k in sizes]).astype(np.int32)
        if node:
            widths = np.repeat([out.shape[1] for out in parts], sizes)
            pe = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(widths)]).astype(np.int32)), pa.array(values))
            return waiting.rows(sizes, [pa.array(numbers), pe], ["node_id", "pe"])
        i, j = np.divmod(numbers, np.repeat([max(len(out), 1) for out in parts], sizes).astype(np.int32))
        return waiting.rows(sizes, [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(values, pa.float64(), from_pandas=True)], ["i", "j", "v"])

    return gathered(nodes, edges, max_nodes).select(F.col("graph_id").cast("long"), F.col("n").cast("int"), "src", "dst").mapInArrow(run, schema)
