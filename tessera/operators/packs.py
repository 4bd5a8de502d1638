"""Greedy packing of graphs by size. The greedy order is sequential, so each group (a batch of graphs to combine) is one task's work."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def smart(sizes: np.ndarray, packs: int) -> np.ndarray:
    """Pack of each graph: the largest graphs open the packs, then the pack expected to end largest takes the smallest graph left,
    every pack getting as many graphs as the others (one more while a remainder lasts)."""
    n = len(sizes)
    order = np.argsort(-sizes, kind="stable")
    pack = np.empty(n, int)
    each = np.full(packs, n // packs)
    each[: n % packs] += 1
    heads = order[:packs]
    pack[heads] = np.arange(len(heads))
    left = list(order[packs:])
    mean = sizes.mean() if n else 0
    heap = [(-(sizes[g] + (each[k] - 1) * mean), k, sizes[g], each[k] - 1) for k, g in enumerate(heads) if each[k] > 1]
    heapq.heapify(heap)
    while left and heap:
        _, k, total, more = heapq.heappop(heap)
        g = left.pop()
        pack[g] = k
        if more > 1:
            heapq.heappush(heap, (-(total + sizes[g] + (more - 1) * mean), k, total + sizes[g], more - 1))
    return pack


def fast(sizes: np.ndarray, packs: int, seed: int = 0) -> np.ndarray:
    """Sorted by size, cut into strata of one graph a pack, each dealt at random; the remainder is a stratum too."""
    rng, order, pack = np.random.default_rng(seed), np.argsort(sizes, kind="stable"), np.empty(len(sizes), int)
    for a in range(0, len(sizes), packs):
        own = order[a : a + packs]
        pack[own] = rng.permutation(packs)[: len(own)]
    return pack


def hybrid(sizes: np.ndarray, packs: int, seed: int = 0) -> np.ndarray:
    """smart for small problems (n^2 / packs under 10^4), fast for large ones (10^5 and over); between, the largest and smallest
    tenths are packed smartly and the rest fast."""
    n = len(sizes)
    cost = n * n / max(packs, 1)
    if cost < 1e4:
        return smart(sizes, packs)
    if cost >= 1e5:
        return fast(sizes, packs, seed)
    order = np.argsort(sizes, kind="stable")
    ends = np.concatenate([order[: n // 10], order[n - n // 10 :]])
    middle = np.setdiff1d(order, ends)
    pack = np.empty(n, int)
    pack[ends], pack[middle] = smart(sizes[ends], packs), fast(sizes[middle], packs, seed)
    return pack


def pack(graphs: DataFrame, group: str, key: str, size: str, packs: int, how: str = "smart", seed: int = 0) -> DataFrame:
    """group, key, size and pack_id of each graph; a group is packed by one task and should be a bounded batch."""
    kernels = {"smart": lambda s: smart(s, packs), "fast": lambda s: fast(s, packs, seed), "hybrid": lambda s: hybrid(s, packs, seed)}
    if how not in kernels:
        raise ValueError(f"packing is smart, fast or hybrid, not {how!r}")
    kernel = kernels[how]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable").reset_index(drop=True)
        return pdf.assign(pack_id=kernel(pdf["size"].to_numpy(float)))

    rows = graphs.select(graphs[group].cast("long").alias("grp"), graphs[key].cast("long").alias(key), graphs[size].cast("long").alias("size"))
    return rows.groupBy("grp").applyInPandas(run, f"grp long, {key} long, size long, pack_id long").withColumnRenamed("grp", group)
