"""Whitening of embeddings: moments by Chan's merging of partitions, components by one eigendecomposition in the driver.

Each partition of the distinct vectors gives its count, its mean and its scatter about that mean; two such summaries merge into
that of both by Chan's formula, in a tree over the executors, so only d x d numbers reach the driver whatever the rows. A
second pass merges the moments of the whitened vectors in the same way and holds their covariance against the identity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import removed, saved

OFFSET = 1_000_000
_EXACT = 1 << 52  # floor(scale * c) beyond this is no exact double any more
Moments = tuple[int, np.ndarray, np.ndarray]


def moments(x: np.ndarray) -> Moments:
    """Count, mean and centred scatter of the rows of x."""
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    apart = x - mean
    return len(x), mean, apart.T @ apart


def merged(a: Moments, b: Moments) -> Moments:
    """Chan's formula: the moments of both samples together; the scatter grows by that of the two means."""
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return a if a[0] else b
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def summed(rows: DataFrame, column: str, width: int, of: Callable[[np.ndarray], np.ndarray], depth: int = 3) -> Moments:
    """Moments of of(x) over the array column, merged batch by batch in a partition and then pairwise in a tree of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Moments = (0, np.zeros(width), np.zeros((width, width)))
        for batch in batches:
            if batch.num_rows:
                own = merged(own, moments(of(_matrix(batch.column(0)))))
        yield pa.RecordBatch.from_arrays([pa.array([own[0]], pa.int64()), pa.array([own[1].tobytes()], pa.binary()), pa.array([own[2].tobytes()], pa.binary())], names=["n", "mean", "scatter"])

    parts = rows.select(column).mapInArrow(run, "n long, mean binary, scatter binary").rdd
    read = parts.map(lambda r: (r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["scatter"]).reshape(width, width)))
    return read.treeReduce(merged, depth)


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of an array column whose arrays have one length and no nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass(frozen=True)
class Whitening:
    """What was fitted: distinct vectors n, their sums, centre, components (columns, unit length) and eigenvalues, falling."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float

    def varies(self) -> np.ndarray:
        """Which components have a variance that is more than rounding."""
        return self.values > max(self.trace, 0.0) * 1e-12

    def apply(self, x: np.ndarray, most: int) -> np.ndarray:
        """Rows of integer vectors in whitened coordinates; NaN where a component has no variance."""
        centred = (x - OFFSET).astype(float) - np.array([(s - self.n * OFFSET) / self.n for s in self.sums])
        e = np.where(self.varies(), self.values, np.nan)[:most]
        return centred @ self.components[:, :most] / np.sqrt(e)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2 as exact integers of any size."""
        means = [s // self.n for s in self.sums]
        low = x - np.array(means, np.int64)  # n x - S = n (x - S div n) - S mod n
        rest = np.array([s - self.n * m for s, m in zip(self.sums, means, strict=True)], np.int64)
        if x.size and x.shape[1] * (self.n * (int(np.abs(low).max()) + 1)) ** 2 < 1 << 63:
            return ((self.n * low - rest) ** 2).sum(axis=1).tolist()
        return ((self.n * low.astype(object) - rest.astype(object)) ** 2).sum(axis=1).tolist() if x.size else [0] * len(x)


def kept_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id and x (array of long) of the rows whose vector is there, without null, NaN or infinite entries."""
    rows = table.select(table[id_col].alias("id"), table[vector_col].cast("array<double>").alias("v"))
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    exact = lambda c: F.when(F.abs(c * scale) < _EXACT, F.floor(c * scale) + OFFSET).otherwise(F.raise_error(F.lit(f"a vector's entry times {scale} is beyond 2^52")).cast("long"))
    return rows.where(F.col("v").isNotNull() & F.forall("v", fine)).select("id", F.transform("v", exact).alias("x"))


def fit(vectors: DataFrame, depth: int = 3) -> tuple[Whitening, DataFrame, int] | None:
    """Fits the distinct x of vectors: the model, the table of them, and how long they are. None where there is no vector."""
    distinct = saved(vectors.select("x").distinct(), "distinct-vectors")
    sizes = distinct.agg(F.min(F.size("x")), F.max(F.size("x")), F.count("*")).first()
    if not sizes[2]:
        removed(distinct)
        return None
    if sizes[0] != sizes[1]:
        raise ValueError(f"vectors have from {sizes[0]} to {sizes[1]} entries; a covariance needs one length")
    width = sizes[0]
    sums = [0] * width
    if width:
        row = distinct.agg(*[F.sum(F.get("x", F.lit(j)).cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)]).first()
        sums = [int(v) for v in row]
    n, _, scatter = summed(distinct, "x", width, lambda x: (x - OFFSET).astype(float), depth)
    covariance = scatter / n
    values, components = np.linalg.eigh(covariance) if width else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-values, kind="stable")
    values, components = values[order], components[:, order]
    if width:
        components = components * np.where(components[np.abs(components).argmax(axis=0), np.arange(width)] < 0, -1.0, 1.0)
    return Whitening(n, tuple(sums), components, values, float(np.trace(covariance))), distinct, width


def whiten(table: DataFrame, most: int = 16, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", depth: int = 3) -> DataFrame:
    """A row for each kept vector and component up to `most`: id, component (from 1, by falling eigenvalue), n (distinct
    vectors), deviation (decimal, exact), whitened, explained (the eigenvalue's part of the trace), identity_error (largest entry of
    the whitened covariance minus the identity, from a pass of its own).

    Entries c become floor(scale * c) + 1,000,000. Vectors that are null or hold null, NaN or infinite entries are dropped; null
    ids stay; repeated rows give rows each and count once in the fit. Where the vectors span fewer dimensions than `most`, the
    components without variance have null in whitened, and explained 0; identity_error leaves them out (null if there is none
    at all). explained is null where nothing varies. Empty tables, and vectors without entries, give no rows. Vectors of different
    lengths are an error, as are entries beyond 2^52 / scale. Other columns are not read. Memory: d x d numbers a task.
    """
    kind = table.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    vectors = kept_vectors(table, id_col, vector_col, scale)
    found = fit(vectors, depth)
    if found is None or not found[2]:
        return table.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    model, distinct, width = found
    most = min(most, width)
    varies = model.varies()[:most]
    error = None
    if varies.any():
        n, _, scatter = summed(distinct, "x", int(varies.sum()), lambda x: model.apply(x, most)[:, varies], depth)
        error = float(np.abs(scatter / n - np.eye(int(varies.sum()))).max())
    removed(distinct)
    explained = [None if model.trace <= 0 else float(v / model.trace) if ok else 0.0 for v, ok in zip(model.values, varies, strict=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2048):
                batch = whole.slice(k, 2048)
                x, m = _matrix(batch.column(1)), batch.num_rows
                white = model.apply(x, most).ravel()
                rows = np.repeat(np.arange(m), most)
                far = pa.array(model.deviations(x), pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, most + 1, dtype=np.int32), m)), pa.array(np.full(m * most, model.n, np.int64)), far.take(pa.array(rows)),
                    pa.array(white, mask=np.isnan(white)), pa.array(explained * m, pa.float64()), pa.array([error] * (m * most), pa.float64()),
                ], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, schema).withColumnRenamed("id", id_col)
