"""Several positional encodings of a graph from one gather: what they share (the Laplacian's eigendecomposition, powers of the walk) is
computed once a graph, and each node's row holds all of them in a struct."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import encodings
from tessera.operators.graphs import transfer

_CELLS = 200_000  # numbers of one encoding that a task holds before it hands on a batch


class Graph:
    """One graph's adjacency and what encodings derive from it, each part at most once."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray):
        self.n, self.src, self.dst = n, src, dst
        self._powers: dict[int, np.ndarray] = {}

    @cached_property
    def a(self) -> np.ndarray:
        return encodings.adjacency(self.n, self.src, self.dst)

    @cached_property
    def blocks(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Nodes, eigenvalues and eigenvectors of the Laplacian of each component."""
        part, out = encodings.components(self.a), []
        for c in np.unique(part):
            own = np.flatnonzero(part == c)
            m = encodings.laplacian(self.a[np.ix_(own, own)])
            out.append((own, *np.linalg.eigh((m + m.T) / 2)))
        return out

    @cached_property
    def inverse(self) -> np.ndarray:
        """Pseudo-inverse of the Laplacian, from the same eigenvectors."""
        out = np.zeros((self.n, self.n))
        for own, w, v in self.blocks:
            some = w > 1e-9 * max(w.max(initial=0.0), 1e-300)
            out[np.ix_(own, own)] = (v[:, some] / w[some]) @ v[:, some].T
        return out

    def power(self, k: int) -> np.ndarray:
        """The walk's matrix to the power k, from the largest power known so far."""
        if not self._powers:
            self._powers[1] = encodings.normalised(self.a, self.a, "inv")
        if k not in self._powers:
            near = max((p for p in self._powers if p < k), default=None)
            if near is None:
                raise ValueError("powers are 1 or more")
            self._powers[k] = self._powers[near] @ self.power(k - near)
        return self._powers[k]


def _eigen(g: Graph, num_pos: int, vectors: bool, pad: float = 0.0) -> np.ndarray:
    out = np.full((g.n, num_pos), float(pad))
    for own, w, v in g.blocks:
        k = min(num_pos, len(w))
        v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(len(w))] < 0, -1, 1)
        out[np.ix_(own, np.arange(k))] = v[:, :k] if vectors else np.abs(w[:k])
    return out


def _projections(g: Graph, num_spaces: int, tolerance: float = 1e-6) -> np.ndarray:
    """How much of each node lies in the eigenspaces of the lowest eigenvalues: the diagonal of their projections, which no choice
    of a basis changes, be it a sign or a rotation within a repeated eigenvalue. 0 where a component has fewer."""
    out = np.zeros((g.n, num_spaces))
    for own, w, v in g.blocks:
        space = np.cumsum(np.concatenate([[0], np.diff(w) > tolerance * max(w.max(initial=0.0), 1.0)])) if len(w) else np.zeros(0, int)
        for k in range(min(num_spaces, int(space.max(initial=-1)) + 1)):
            out[own, k] = (v[:, space == k] ** 2).sum(axis=1)
    return out


def _returns(g: Graph, ksteps: list[int], space_dim: float = 0) -> np.ndarray:
    if g.n == 1:
        return np.ones((1, len(ksteps)))
    return np.stack([np.diag(g.power(k)) * k ** (space_dim / 2) for k in ksteps], axis=1)


def _commute(g: Graph) -> np.ndarray:
    d = np.diag(g.inverse)
    return (g.a.sum() * (d[:, None] + d[None, :] - 2 * g.inverse))[:, :, None]


#: type -> (level it is made at, kernel over a Graph); node kernels give [n, f], pair kernels [n, n, f]
TYPES: dict[str, tuple[str, Callable[..., np.ndarray]]] = {
    "laplacian_eigvec": ("node", lambda g, num_pos, pad=0.0: _eigen(g, num_pos, True, pad)),
    "laplacian_eigval": ("node", lambda g, num_pos, pad=0.0: _eigen(g, num_pos, False, pad)),
    "laplacian_projection": ("node", _projections),
    "rw_return_probs": ("node", _returns),
    "rw_transition_probs": ("nodepair", lambda g, ksteps: np.stack([g.power(k) for k in ksteps], axis=2)),
    "electrostatic": ("nodepair", lambda g: (g.inverse - np.diag(g.inverse)[None, :])[:, :, None]),
    "commute": ("nodepair", _commute),
    "graphormer": ("nodepair", lambda g: encodings.hops(g.a)[:, :, None]),
}


def transferred(x: np.ndarray, source: str, target: str, g: Graph) -> np.ndarray:
    """x at another level: [n, f], [n, n, f], or [edges, f] in the order of the graph's edges."""
    if source == target:
        return x
    transfer(source, target)
    if source == "node":
        if target == "edge":
            a, b = x[g.src], x[g.dst]
            return np.concatenate([a + b, np.abs(a - b)], axis=1)
        return np.concatenate([x[:, None] + x[None], np.abs(x[:, None] - x[None])], axis=2)
    if target == "edge":
        return x[g.src, g.dst]
    stats = [f(x, axis=k) for k in (0, 1) for f in (np.min, np.mean, np.std)]
    return np.concatenate(stats, axis=1)


def encode_all(nodes: DataFrame, edges: DataFrame, specs: dict[str, dict], max_nodes: int = 512) -> DataFrame:
    """A row a node: graph_id, node_id, pe (struct with a field for each entry of specs, so two of one type stand side by side).

    An entry: {"type": one of TYPES, "level": where it is wanted (where it is made, if not given), and the type's parameters}.
    Fields of level node are arrays; of level nodepair, an array over j of arrays; of level edge, an array of (dst, v) for the edges
    that begin at the node. Pair features become node features by minimum, mean and standard deviation over both axes,
    node features go to pairs and edges as sum and absolute difference. Entries between components are null (hops).

    Unknown types and levels that cannot be reached are errors before anything runs. Graphs over `max_nodes` nodes are an error; a
    task holds one graph's matrices and hands on batches of bounded size. Nodes are numbered 0..n-1; parallel edges count each.
    """
    plan = []
    for name, spec in specs.items():
        spec = dict(spec)
        kind = spec.pop("type", None)
        if kind not in TYPES:
            raise ValueError(f"no encoding {kind!r}; there are {', '.join(TYPES)}")
        made, kernel = TYPES[kind]
        level = spec.pop("level", None) or made
        if level not in ("node", "nodepair", "edge"):
            raise ValueError(f"encodings go to node, nodepair or edge, not {level!r}")
        if level != made:
            transfer(made, level)
        plan.append((name, made, level, kernel, spec))
    row, pair = pa.list_(pa.float64()), pa.list_(pa.list_(pa.float64()))
    edge = pa.list_(pa.struct([("dst", pa.int32()), ("v", row)]))
    kinds = {"node": (row, "array<double>"), "nodepair": (pair, "array<array<double>>"), "edge": (edge, "array<struct<dst:int,v:array<double>>>")}
    schema = "graph_id long, node_id int, pe struct<" + ",".join(f"`{name}`:{kinds[level][1]}" for name, _, level, _, _ in plan) + ">"

    def column(parts: list[tuple[Graph, np.ndarray]], level: str) -> pa.Array:
        flat = np.concatenate([x.reshape(-1) for _, x in parts]) if parts else np.zeros(0)
        values = pa.array(flat, pa.float64(), from_pandas=True)
        cuts = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        widths = [x.shape[-1] for _, x in parts]
        inner = pa.ListArray.from_arrays(cuts(np.repeat(widths, [int(np.prod(x.shape[:-1])) for _, x in parts])), values)
        if level == "node":
            return inner
        if level == "nodepair":
            return pa.ListArray.from_arrays(cuts(np.repeat([g.n for g, _ in parts], [g.n for g, _ in parts])), inner)
        order = np.concatenate([o + at for (g, _), at in zip(parts, np.cumsum([0] + [len(g.src) for g, _ in parts]), strict=False) for o in [np.lexsort((g.dst, g.src))]] or [np.zeros(0, int)]).astype(int)
        ends = np.concatenate([g.dst for g, _ in parts] or [np.zeros(0, int)])[order].astype(np.int32)
        struct = pa.StructArray.from_arrays([pa.array(ends), inner.take(pa.array(order))], fields=[edge.value_type.field(0), edge.value_type.field(1)])
        return pa.ListArray.from_arrays(cuts(np.concatenate([np.bincount(g.src, minlength=g.n) for g, _ in parts])), struct)

    def handed(waiting: encodings.Batch) -> pa.RecordBatch:
        done = waiting.made
        fields = [column([(g, x[k]) for g, x in done], level) for k, (_, _, level, _, _) in enumerate(plan)]
        pe = pa.StructArray.from_arrays(fields, names=[name for name, *_ in plan])
        sizes = np.array([g.n for g, _ in done])
        node = np.concatenate([np.arange(n) for n in sizes]).astype(np.int32)
        return waiting.rows(sizes, [pa.array(node), pe], ["node_id", "pe"])

    def encoded(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[Graph, list[np.ndarray]]:
        g = Graph(n, src, dst)
        return g, [transferred(kernel(g, **args), made, level, g) for _, made, level, kernel, args in plan]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = encodings.Batch()
        once = encodings.Once(encoded, lambda made: sum(x.size for x in made[1]) + 4 * made[0].n ** 2)
        for batch in batches:
            for graph, made in once.over(batch):
                if waiting.add(graph, made, sum(x.size for x in made[1])):
                    yield handed(waiting)
                    waiting = encodings.Batch()
        if waiting.ids:
            yield handed(waiting)

    gathered = encodings.gathered(nodes, edges, max_nodes).select(F.col("graph_id").cast("long"), F.col("n").cast("int"), F.col("src").cast("array<int>"), F.col("dst").cast("array<int>"))
    return gathered.mapInArrow(run, schema)


def walk_powers(nodes: DataFrame, edges: DataFrame, ksteps: list[int], start: DataFrame | None = None, start_k: int | None = None, max_nodes: int = 512) -> DataFrame:
    """graph_id, i, j, k, p: every power of ksteps (rising) of the random walk's matrix, its entries above 0, from one gather.

    Each power continues from the one before. `start` (graph_id, i, j, p: the power start_k as it was stored) is gathered with the
    edges and taken instead of computing that power again; a graph that it does not hold starts anew. Graphs without edges
    give no rows.
    """
    if sorted(set(ksteps)) != list(ksteps) or not ksteps or ksteps[0] < 1 or (start is None) != (start_k is None):
        raise ValueError("ksteps rise from 1 at least, and start comes with start_k")
    held = encodings.gathered(nodes, edges, max_nodes)
    if start is not None:
        known = start.groupBy("graph_id").agg(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("p").cast("double").alias("p"))).alias("known"))
        held = held.join(known, "graph_id", "left")
    else:
        held = held.withColumn("known", F.lit(None).cast("array<struct<i:int,j:int,p:double>>"))
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())

    def powers(n: int, src: np.ndarray, dst: np.ndarray, known: list[dict] | None = None) -> tuple[np.ndarray, ...]:
        """i, j, k, p of one graph."""
        g = Graph(n, src, dst)
        g.power(1)
        if known:
            m = np.zeros((n, n))
            m[[x["i"] for x in known], [x["j"] for x in known]] = [x["p"] for x in known]
            g._powers[start_k] = m
        ends = [np.nonzero(g.power(k) > 0) for k in ksteps]
        sizes = [len(i) for i, _ in ends]
        return *(np.concatenate([x[c] for x in ends]) for c in (0, 1)), np.repeat(ksteps, sizes), np.concatenate([g.power(k)[x] for k, x in zip(ksteps, ends, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[] for _ in kinds]
        size = 0
        once = encodings.Once(powers, lambda rows: 4 * len(rows[0]))
        for batch in batches:
            known = batch.column(4)
            for r, (graph, rows) in enumerate(once.over(batch, lambda r: known[r].is_valid and len(known[r]) > 0)):  # noqa: B023
                if rows is None:
                    n, src, dst = batch.column(1)[r].as_py(), *((batch.column(c)[r].as_py() or []) for c in (2, 3))
                    rows = powers(n, np.array(src, int), np.array(dst, int), known[r].as_py())
                for p, c in zip(parts, (np.full(len(rows[0]), graph), *rows), strict=True):
                    p.append(c)
                size += len(rows[0])
                if size >= _CELLS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p), t) for p, t in zip(parts, kinds, strict=True)], names=["graph_id", "i", "j", "k", "p"])
                    parts, size = [[] for _ in kinds], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p), t) for p, t in zip(parts, kinds, strict=True)], names=["graph_id", "i", "j", "k", "p"])

    rows = held.select(F.col("graph_id").cast("long"), F.col("n").cast("int"), F.col("src").cast("array<int>"), F.col("dst").cast("array<int>"), "known")
    return rows.mapInArrow(run, "graph_id long, i int, j int, k int, p double")
