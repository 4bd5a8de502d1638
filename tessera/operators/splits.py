"""Sampling and splitting by hashed ranks: seeded, the same on every cluster, without a sort of whole rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(seed: int, *key: Column) -> Column:
    """A text that orders rows at random but always alike."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]))


def sub_sample(rows: DataFrame, size: int | float | None, key: str, seed: int = 42) -> DataFrame:
    """int: that many rows (all if there are fewer); float: that share; None: all."""
    if size is None:
        return rows
    if isinstance(size, bool) or not isinstance(size, (int, float)):
        raise ValueError(f"sample size is an int, a float or None, not {size!r}")
    if isinstance(size, float):
        return ranked(rows, key, seed).where(F.col("rank") < F.floor(F.col("total") * size)).drop("rank", "total")
    n = size
    return rows.withColumn("_h", seeded(seed, F.col(key))).orderBy("_h", key).limit(n).drop("_h")


def ranked(rows: DataFrame, key: str, seed: int, by: tuple[str, ...] = (), blocks: int = 256) -> DataFrame:
    """rows with `rank` from 0 in the order of seeded(), within each `by`, and `total`.

    The order's leading two hex digits are blocks; rows are ranked within a block and blocks by a running sum of their
    sizes, so no task orders more than a 256th of a group."""
    h = rows.withColumn("_h", seeded(seed, F.col(key))).withColumn("_b", F.substring("_h", 1, 2))
    sizes = h.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b") if by else Window.partitionBy(F.lit(0)).orderBy("_b")
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("_n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))})
    own = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", key)) - 1
    return h.withColumn("_own", own).join(F.broadcast(sizes.drop("_n")) if not by else sizes.drop("_n"), [*by, "_b"]).withColumn("rank", F.col("_own") + F.col("_before")).drop("_own", "_before", "_b", "_h")


def random_split(rows: DataFrame, key: str, val: float, test: float, seed: int = 42) -> DataFrame:
    """split: the first floor(n * val) rows in seeded order are val, the next floor(n * test) test, the rest train."""
    n_val, n_test = F.floor(F.col("total") * val), F.floor(F.col("total") * test)
    out = ranked(rows, key, seed)
    return out.withColumn("split", F.when(F.col("rank") < n_val, "val").when(F.col("rank") < n_val + n_test, "test").otherwise("train")).drop("rank", "total")


def split_unseen(rows: DataFrame, seen: DataFrame, key: str, val: float, test: float, seed: int = 42) -> DataFrame:
    """Rows whose key occurs in `seen` are test_seen; the others are split at random."""
    known = seen.select(key).distinct()
    return random_split(rows.join(known, key, "left_anti"), key, val, test, seed).unionByName(rows.join(known, key, "left_semi").withColumn("split", F.lit("test_seen")))


def split_overlap_to_train(rows: DataFrame, other: DataFrame, key: str, val: float, test: float, seed: int = 42) -> DataFrame:
    """The other half of split_unseen(): rows whose key `other` has too are train, so that it holds out nothing that they were
    trained on; the rest are split at random."""
    known = other.select(key).distinct()
    return random_split(rows.join(known, key, "left_anti"), key, val, test, seed).unionByName(rows.join(known, key, "left_semi").withColumn("split", F.lit("train")))


def file_split(rows: DataFrame, wide: DataFrame, index: str, names: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """rows with the split whose column of `wide` (padded with NULL or NaN) lists their index; rows listed nowhere go."""
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("split"), F.nanvl(F.col(n).cast("double"), F.lit(None).cast("double")).cast("long").alias(index)) for n in names])).alias("x")).select("x.*").where(F.col(index).isNotNull()).distinct()
    return rows.join(long, index)


def task_sample(rows: DataFrame, task: str, key: str, fractions: dict[str, float], epoch: int = 0) -> DataFrame:
    """floor(n * fraction) rows of each task (1 where it is not named), others every epoch."""
    share = F.coalesce(F.create_map(*[x for k, v in fractions.items() for x in (F.lit(k), F.lit(float(v)))])[F.col(task)], F.lit(1.0)) if fractions else F.lit(1.0)
    return ranked(rows, key, epoch, (task,)).where(F.col("rank") < F.floor(F.col("total") * share)).drop("rank", "total")
