"""Inference kernels: layers with given weights, as column expressions over array columns (small) or Arrow batches (wide)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACTIVATIONS = {
    "none": lambda x: x, "relu": lambda x: F.greatest(x, F.lit(0.0)), "sigmoid": lambda x: 1 / (1 + F.exp(-x)), "tanh": F.tanh,
    "elu": lambda x: F.when(x > 0, x).otherwise(F.exp(x) - 1), "silu": lambda x: x / (1 + F.exp(-x)), "softplus": lambda x: F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0)),
}
_NUMPY = {"none": lambda x: x, "relu": lambda x: np.maximum(x, 0), "sigmoid": lambda x: 1 / (1 + np.exp(-x)), "tanh": np.tanh, "elu": lambda x: np.where(x > 0, x, np.expm1(np.minimum(x, 0))), "silu": lambda x: x / (1 + np.exp(-x)), "softplus": lambda x: np.log1p(np.exp(-np.abs(x))) + np.maximum(x, 0)}


def activation(name: str):
    if name not in ACTIVATIONS:
        raise ValueError(f"no activation {name!r}")
    return ACTIVATIONS[name]


def linear(x: Column, weight: list[list[float]], bias: list[float] | None = None, act: str = "none") -> Column:
    """act(W x + b) for an array column and a small weight matrix, all inside the JVM."""
    f = activation(act)
    out = []
    for k, row in enumerate(weight):
        terms = [F.get(x, F.lit(j)) * F.lit(float(w)) for j, w in enumerate(row)]
        out.append(f(sum(terms[1:], terms[0]) + F.lit(float(bias[k]) if bias else 0.0)))
    return F.array(*out)


def layer_norm(x: Column, eps: float = 1e-5) -> Column:
    n = F.size(x)
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
    var = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n
    return F.transform(x, lambda v: (v - mean) / F.sqrt(var + eps))


def residual(x: Column, before: Column, how: str = "simple") -> Column:
    """none, simple (sum) or concat."""
    known = {"none": x, "simple": F.zip_with(x, before, lambda a, b: a + b), "concat": F.concat(x, before)}
    if how not in known:
        raise ValueError(f"residual is none, simple or concat, not {how!r}")
    return known[how]


def mlp(rows: DataFrame, column: str, layers: list[tuple[np.ndarray, np.ndarray, str]], out: str) -> DataFrame:
    """rows with column `out`: the layers (weight [out, in], bias, activation) applied to an array column in Arrow batches. NULL
    stays NULL. Weights travel with the task, so they should be megabytes at most."""
    for _, _, act in layers:
        activation(act)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(at)
            ok = np.flatnonzero(~np.asarray(x.is_null()))
            h = np.array([x[int(k)].as_py() for k in ok], float).reshape(len(ok), -1)
            for w, b, act in layers:
                h = _NUMPY[act](h @ w.T + b) if len(ok) else h
            values: list = [None] * len(x)
            for k, row in zip(ok, h, strict=True):
                values[int(k)] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.list_(pa.float64()))], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, schema)


def ensemble(rows: DataFrame, key: str, column: str, members: list[tuple[list[list[float]], list[float]]], reduction: str = "mean") -> DataFrame:
    """Every member's linear layer, reduced over members entry by entry: mean, sum, min, max, or the lower median; none keeps members."""
    stacked = F.posexplode(F.array(*[linear(F.col(column), w, b) for w, b in members]))
    long = rows.select(key, stacked.alias("member", "y")).select(key, "member", F.posexplode("y").alias("slot", "v"))
    if reduction == "none":
        return long
    known = {"mean": F.avg("v"), "sum": F.sum("v"), "min": F.min("v"), "max": F.max("v"), "median": F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v)")}
    if reduction not in known:
        raise ValueError(f"no reduction {reduction!r}")
    return long.groupBy(key, "slot").agg(known[reduction].alias("v"))


def warmup_lr(epoch: Column, base: float, warmup: int, total: int) -> Column:
    """Learning rate: linear from 0 over `warmup` epochs, then linear to 0 at `total`."""
    rise = F.lit(base) * epoch / warmup
    fall = F.lit(base) * F.greatest(F.lit(total) - epoch, F.lit(0)) / (total - warmup)
    return F.when(epoch < warmup, rise).otherwise(fall)


def drop_path(rows: DataFrame, key: str, rate: float, seed: int) -> DataFrame:
    """scale: 0 for a share `rate` of the graphs, chosen by hashed key, 1 / (1 - rate) for the others."""
    kept = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) >= int(rate * 1_000_000)
    return rows.withColumn("scale", F.when(kept, F.lit(1 / (1 - rate))).otherwise(F.lit(0.0)))
