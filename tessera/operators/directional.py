"""Messages between edges: the line graph of k -> j -> i, with Bessel bases of distance and angle as columns.

A hub with many edges in and out makes as many triplets as their product. Its incoming edges are dealt over several keys, and each
outgoing edge meets all of them, so the product is spread over tasks; sums are partial before the exchange that ends them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _j(order: int, x: float) -> float:
    """Spherical Bessel function of a number, by its upward recurrence (x is not small where this is used)."""
    below, own = math.sin(x) / x, math.sin(x) / x**2 - math.cos(x) / x
    if order == 0:
        return below
    for k in range(1, order):
        below, own = own, (2 * k + 1) / x * own - below
    return own


def zeros(order: int, count: int) -> list[float]:
    """The first `count` zeros of the spherical Bessel function: those of one order lie between those of the order below."""
    found = [math.pi * (k + 1) for k in range(count + order)]
    for l in range(1, order + 1):
        new = []
        for a, b in zip(found, found[1:], strict=False):
            low = _j(l, a) > 0
            for _ in range(100):
                mid = (a + b) / 2
                a, b = (mid, b) if (_j(l, mid) > 0) == low else (a, mid)
            new.append((a + b) / 2)
        found = new
    return found[:count]


def bessel(order: int, x: Column) -> Column:
    """Spherical Bessel function of a column: upward recurrence, and the first terms of its series where x is small against the order."""
    below, own = F.sin(x) / x, F.sin(x) / (x * x) - F.cos(x) / x
    for k in range(1, order):
        below, own = own, (2 * k + 1) / x * own - below
    far = below if order == 0 else own
    odd = math.prod(range(1, 2 * order + 2, 2))
    half = x * x / 2
    series = 1 - half / (2 * order + 3) * (1 - half / (2 * (2 * order + 5)) * (1 - half / (3 * (2 * order + 7)) * (1 - half / (4 * (2 * order + 9)))))
    power = F.lit(1.0)
    for _ in range(order):
        power = power * x
    return F.when(F.abs(x) < 0.2 * (order + 1), power / F.lit(float(odd)) * series).otherwise(far)


def radial(dist: Column, cutoff: float, count: int) -> list[Column]:
    """sqrt(2 / c) sin(n pi d / c) / d for n = 1..count; its limit where d is 0."""
    top = math.sqrt(2 / cutoff)
    return [F.when(dist == 0, F.lit(top * n * math.pi / cutoff)).otherwise(top * F.sin(n * math.pi / cutoff * dist) / dist) for n in range(1, count + 1)]


def envelope(dist: Column, cutoff: float, p: int = 6) -> Column:
    """A polynomial that falls from 1 to 0 at the cutoff with two smooth derivatives there; 0 beyond."""
    x = dist / cutoff
    a, b, c = -(p + 1) * (p + 2) / 2, float(p * (p + 2)), -p * (p + 1) / 2
    power = F.pow(x, F.lit(float(p)))
    return F.when(x < 1, 1 + a * power + b * power * x + c * power * x * x).otherwise(F.lit(0.0))


def legendre(order: int, cos: Column) -> Column:
    below, own = F.lit(1.0), cos
    for k in range(1, order):
        below, own = own, ((2 * k + 1) * cos * own - k * below) / (k + 1)
    return below if order == 0 else own


def spherical(dist: Column, angle: Column, cutoff: float, orders: int, count: int) -> list[Column]:
    """Basis of distance and angle: orders 0..orders-1 outside, zeros 1..count inside; each normalised in the ball of the cutoff."""
    out = []
    for l in range(orders):
        turn = math.sqrt((2 * l + 1) / (4 * math.pi)) * legendre(l, F.cos(angle))
        for z in zeros(l, count):
            out.append(math.sqrt(2 / cutoff**3) / abs(_j(l + 1, z)) * bessel(l, z / cutoff * dist) * turn)
    return out


def line_graph(edges: DataFrame, columns: list[str], most: int = 10_000) -> DataFrame:
    """A row for each k -> j -> i with i other than k: graph_id, k, j, i, and `columns` of both edges as kj_<c> and ji_<c>.

    Incoming edges of a node with more than `most` of them are dealt over as many keys as it takes; the counts come from one aggregate."""
    deg = edges.groupBy("graph_id", F.col("dst").alias("j")).agg(F.ceil(F.count("*") / most).cast("int").alias("_keys"))
    into = edges.select("graph_id", F.col("src").alias("k"), F.col("dst").alias("j"), *[F.col(c).alias(f"kj_{c}") for c in columns]).join(deg, ["graph_id", "j"])
    into = into.withColumn("_key", F.pmod(F.xxhash64("k"), F.col("_keys")).cast("int")).drop("_keys")
    out = edges.select("graph_id", F.col("src").alias("j"), F.col("dst").alias("i"), *[F.col(c).alias(f"ji_{c}") for c in columns]).join(deg, ["graph_id", "j"])
    out = out.withColumn("_key", F.explode(F.sequence(F.lit(0), F.col("_keys") - 1))).drop("_keys")
    return into.join(out, ["graph_id", "j", "_key"]).where("k <> i").drop("_key")


def angle(kj: list[Column], ji: list[Column]) -> Column:
    """Angle at i between j and k, from the vectors k -> j and j -> i: atan2 of the cross product's length and the dot product."""
    a = [-c for c in ji]
    b = [-c - d for c, d in zip(kj, ji, strict=True)]
    cross = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    total = lambda xs: sum(xs[1:], xs[0])
    return F.atan2(F.sqrt(total([c * c for c in cross])), total([x * y for x, y in zip(a, b, strict=True)]))


def directional(edges: DataFrame, weights: list[list[list[float]]], cutoff: float, orders: int, count: int, most: int = 10_000) -> DataFrame:
    """A row an edge j -> i: graph_id, src, dst, h (array), h_o = sum over k, s and c of weights[o][s][c] basis_s(d_kj, angle) x_c of k -> j.

    edges: graph_id, src, dst (once each), dx, dy, dz (from src to dst), and x, an array of as many numbers as the weights' last axis.
    The sums over k of basis times x are aggregated first, so the weights meet one row an edge and not one a triplet. An edge
    without triplets gets zeros. Edges of length 0 and their angles count with the basis' limits.
    """
    width = len(weights[0][0])
    if any(len(w) != orders * count or any(len(r) != width for r in w) for w in weights):
        raise ValueError(f"weights are [outputs][{orders * count}][{width}]")
    rows = edges.select("graph_id", "src", "dst", "dx", "dy", "dz", "x")
    met = line_graph(rows, ["dx", "dy", "dz", "x"], most)
    kj, ji = ([F.col(f"{s}_{c}") for c in ("dx", "dy", "dz")] for s in ("kj", "ji"))
    dist = F.sqrt(kj[0] * kj[0] + kj[1] * kj[1] + kj[2] * kj[2])
    met = met.select("graph_id", "j", "i", dist.alias("d"), angle(kj, ji).alias("t"), F.col("kj_x").alias("x"))
    basis = spherical(F.col("d"), F.col("t"), cutoff, orders, count)
    met = met.select("graph_id", F.col("j").alias("src"), F.col("i").alias("dst"), "x", *[b.alias(f"b{s}") for s, b in enumerate(basis)])
    sums = met.groupBy("graph_id", "src", "dst").agg(*[F.sum(F.col(f"b{s}") * F.get("x", F.lit(c))).alias(f"t{s}_{c}") for s in range(len(basis)) for c in range(width)])
    out = rows.select("graph_id", "src", "dst").join(sums, ["graph_id", "src", "dst"], "left")
    h = [sum((F.lit(float(w)) * F.coalesce(f"t{s}_{c}", F.lit(0.0)) for s, row in enumerate(own) for c, w in enumerate(row)), F.lit(0.0)) for own in weights]
    return out.select("graph_id", "src", "dst", F.array(*h).alias("h"))
