"""Nearest points of a graph within a cutoff, by tiles of points that lie together.

Points are brought into a Z-order of their coordinates' quantiles and cut into tiles of at most `2 * TILE` points, so tiles follow
the points however densely they lie. A tile gives each of its points a reach: the distance within which the tile alone holds as many
neighbours as are wanted, the cutoff at most. Tiles meet where their boxes are no farther apart than that, and a task looks at two of them at a
time. Of points at one place only as many as can be anyone's neighbours are candidates, so copies make no pairs of each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tessera.llm.store import saved

TILE = 256
_BANDS = 1_024  # quantiles of each coordinate
_ROWS = 50_000  # rows that a task holds before it hands on a batch
_MOST_TASKS = 4_000


def _tasks(rows: int, each: int) -> int:
    """Tasks for work that is large against its bytes, which would else be dealt to one or two."""
    return max(1, min(rows // each, _MOST_TASKS))


def _slack(reach: np.ndarray | float) -> np.ndarray | float:
    """A distance that may round to the same nine digits."""
    return reach + 2e-9 + 1e-12 * np.abs(reach)


def _apart(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt(sum(((x[:, None] - y[None, :]) * (x[:, None] - y[None, :]) for x, y in zip(a, b, strict=True)), 0.0))


def _z_order(coordinates: list[np.ndarray], bands: list[list[float]]) -> np.ndarray:
    bits = min(10, 62 // len(bands))
    out = np.zeros(len(coordinates[0]), np.int64)
    for k, (c, edges) in enumerate(zip(coordinates, bands, strict=True)):
        band = np.searchsorted(edges, c).astype(np.int64) >> (10 - bits)
        for bit in range(bits):
            out |= ((band >> bit) & 1) << (bit * len(bands) + k)
    return out


def _tiles(candidates: DataFrame, axes: list[str], wanted: int, cutoff: float) -> DataFrame:
    """tile (a number), graph_id, ids, the axes and reach (arrays over the tile's points; reach is null but for one point of each place),
    far (the largest reach) and the bounds of the box."""
    rows, *found = candidates.agg(F.count("*"), *[F.percentile_approx(c, [k / _BANDS for k in range(1, _BANDS)], 5_000) for c in axes]).first()
    bands = [list(x or []) for x in found]
    kinds = candidates.schema

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _z_order([batch.column(c).to_numpy(zero_copy_only=False) for c in axes], bands)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(z)], names=[*batch.schema.names, "z"])

    rows = candidates.mapInArrow(code, StructType([*kinds, StructField("z", LongType())])).repartitionByRange(_tasks(rows, 40 * TILE), "graph_id", "z").sortWithinPartitions("graph_id", "z", *axes, "first")
    bounds = [f"{end}{c}" for c in axes for end in ("lo", "hi")]
    lists = [StructField(c, ArrayType(DoubleType())) for c in [*axes, "reach"]]
    schema = StructType([StructField("tile", LongType()), kinds["graph_id"], StructField("ids", ArrayType(kinds["id"].dataType)), *lists, *[StructField(c, DoubleType()) for c in ["far", *bounds]]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, out, size = TaskContext.get().partitionId() << 32, None, [], 0

        def tile(rows: pa.Table) -> tuple:
            nonlocal number
            number += 1
            at = [rows.column(c).to_numpy() for c in axes]
            own = np.flatnonzero(rows.column("first").to_numpy())
            apart = _apart([x[own] for x in at], at)
            reach = np.full(rows.num_rows, np.nan)
            reach[own] = np.minimum(np.partition(apart, wanted - 1, axis=1)[:, wanted - 1] if rows.num_rows >= wanted else np.inf, cutoff)
            ends = [f(x) for x in at for f in (np.min, np.max)]
            return (number - 1, rows.column("graph_id")[0], rows.column("id").combine_chunks(), at, reach, float(reach[own].max(initial=0.0)), ends)

        def handed() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(t[2]) for t in out])]).astype(np.int32)
            flat = [pa.array(np.concatenate([t[3][k] for t in out])) for k in range(len(axes))] + [pa.array(np.concatenate([t[4] for t in out]), from_pandas=True)]
            ids = pa.concat_arrays([t[2] for t in out])
            columns = [pa.array([t[0] for t in out], pa.int64()), pa.array([t[1].as_py() for t in out], out[0][1].type), *[pa.ListArray.from_arrays(offsets, x) for x in [ids, *flat]], pa.array([t[5] for t in out])]
            return pa.RecordBatch.from_arrays([*columns, *[pa.array([t[6][k] for t in out], pa.float64()) for k in range(2 * len(axes))]], names=schema.names)

        def split(rows: pa.Table, last: bool) -> Iterator[pa.Table]:
            """Tiles of one graph's rows; what is left over unless these are its last."""
            at = 0
            while rows.num_rows - at > 2 * TILE:
                yield rows.slice(at, TILE)
                at += TILE
            rest = rows.slice(at)
            if last and rest.num_rows:
                half = rest.num_rows if rest.num_rows <= TILE else rest.num_rows // 2
                yield from (x for x in (rest.slice(0, half), rest.slice(half)) if x.num_rows)
            nonlocal held
            held = None if last else rest

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            graph = rows.column("graph_id").to_pandas().to_numpy()
            edges = [0, *(np.flatnonzero(graph[1:] != graph[:-1]) + 1), rows.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                part = rows.slice(a, b - a)
                if held is not None and held.column("graph_id")[0] == part.column("graph_id")[0]:
                    part, held = pa.concat_tables([held, part]), None
                done = list(split(held, True)) if held is not None else []
                for x in [*done, *split(part, False)]:
                    out.append(tile(x))
                    size += x.num_rows
                if size >= _ROWS:
                    yield handed()
                    out, size = [], 0
        if held is not None:
            out += [tile(x) for x in list(split(held, True))]
        if out:
            yield handed()

    return saved(rows.mapInArrow(cut, schema), "point-tiles")


def _met(tiles: DataFrame, axes: list[str]) -> DataFrame:
    """a, b: numbers of two tiles where b may hold a point within the reach of one of a."""
    bounds = [f"{end}{c}" for c in axes for end in ("lo", "hi")]
    a = tiles.select("graph_id", F.col("tile").alias("a"), "far", *[F.col(c).alias(f"a_{c}") for c in bounds])
    b = tiles.select("graph_id", F.col("tile").alias("b"), *[F.col(c).alias(f"b_{c}") for c in bounds])
    gap = lambda c: F.greatest(F.col(f"b_lo{c}") - F.col(f"a_hi{c}"), F.col(f"a_lo{c}") - F.col(f"b_hi{c}"), F.lit(0.0))
    between = F.sqrt(reduce(lambda x, y: x + y, [gap(c) * gap(c) for c in axes]))
    return a.join(b, "graph_id").where(between <= F.col("far") + 4e-9 + 2e-12 * F.col("far")).select("a", "b")


def nearest(points: DataFrame, position: list[str], cutoff: float, most: int) -> DataFrame:
    """graph_id, i, j, dist: for each point (graph_id, node_id, coordinates) the `most` nearest others of its graph at most `cutoff` away,
    by distance rounded to nine digits and then by number. Points with a null, NaN or infinite coordinate have no neighbours."""
    axes = [f"_p{k}" for k in range(len(position))]
    known = points.select("graph_id", F.col("node_id").alias("id"), *[(F.col(c).cast("double") + 0.0).alias(a) for c, a in zip(position, axes, strict=True)])
    known = known.where(reduce(and_, [F.abs(a) < float("inf") for a in axes]) & F.col("graph_id").isNotNull() & F.col("id").isNotNull())
    wanted = most + 1  # a point is the nearest to itself, or another at its place is
    place = F.row_number().over(Window.partitionBy("graph_id", *axes).orderBy("id"))
    candidates = known.withColumn("nth", place).where(F.col("nth") <= wanted).select("graph_id", "id", *axes, (F.col("nth") == 1).cast("double").alias("first"))
    tiles = _tiles(candidates, axes, wanted, cutoff)
    met = _met(tiles, axes)
    tasks = _tasks(tiles.count(), 16)
    own = tiles.select(F.col("tile").alias("a"), "graph_id", *[F.col(c).alias(f"a{c}") for c in axes], "reach")
    met = met.join(tiles.select(F.col("tile").alias("b"), "ids", *[F.col(c).alias(f"b{c}") for c in axes]), "b").repartition(tasks, "a").join(own, "a").drop("a", "b")
    names = met.columns
    schema = StructType([points.schema["graph_id"], *[StructField(c, DoubleType()) for c in axes], StructField("j", points.schema["node_id"].dataType), StructField("dist", DoubleType())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {c: batch.column(names.index(c)) for c in names}
            out, size = [], 0
            for r in range(batch.num_rows):
                numbers = lambda c: column[c][r].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                reach = numbers("reach")
                asks = np.flatnonzero(~np.isnan(reach))
                at = [numbers(f"a{c}")[asks] for c in axes]
                apart = _apart(at, [numbers(f"b{c}") for c in axes])
                near = (apart <= _slack(reach[asks])[:, None]) & (apart <= cutoff)
                if apart.shape[1] > 2 * wanted:
                    full = np.flatnonzero(near.sum(axis=1) > 2 * wanted)
                    near[full] &= apart[full] <= _slack(np.partition(apart[full], wanted - 1, axis=1)[:, wanted - 1])[:, None]
                i, j = np.nonzero(near)
                if len(i):
                    out.append((column["graph_id"][r], [x[i] for x in at], column["ids"][r].values.take(pa.array(j)), apart[i, j]))
                    size += len(i)
                if size >= _ROWS or (out and r == batch.num_rows - 1):
                    graph = pa.array(range(len(out))).take(pa.array(np.repeat(np.arange(len(out)), [len(x[3]) for x in out])))
                    graph = pa.array([x[0].as_py() for x in out], out[0][0].type).take(graph)
                    yield pa.RecordBatch.from_arrays([graph, *[pa.array(np.concatenate([x[1][k] for x in out])) for k in range(len(axes))], pa.concat_arrays([x[2] for x in out]), pa.array(np.concatenate([x[3] for x in out]))], names=schema.names)
                    out, size = [], 0

    by = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("dist", 9), "j"))
    places = met.mapInArrow(look, schema).withColumn("nth", by("graph_id", *axes)).where(F.col("nth") <= wanted).drop("nth")
    near = known.withColumnRenamed("id", "i").join(places, ["graph_id", *axes]).where("i <> j").select("graph_id", "i", "j", "dist")
    return near.withColumn("nth", by("graph_id", "i")).where(F.col("nth") <= most).select("graph_id", "i", "j", "dist")
