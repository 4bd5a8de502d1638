"""Sparse multi-task labels: merging, cleaning, weighting and normalising."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_tasks(tasks: dict[str, DataFrame], key: str = "mol_id", order: str = "row_ord") -> DataFrame:
    """A row a key with a column a task (label of the last row that has it; NULL where the task lacks the key) and n_rows.

    One union and one aggregate instead of a chain of full outer joins: a single shuffle, with partial sums, whatever the
    number of tasks. Keys that are NULL are left out."""
    rows = reduce(DataFrame.unionByName, [t.select(F.col(key), F.col(order).alias("_ord"), F.lit(name).alias("_task"), F.col("label").cast("double").alias("_label")) for name, t in tasks.items()])
    last = lambda name: F.max_by(F.when(F.col("_task") == name, F.col("_label")), F.when(F.col("_task") == name, F.col("_ord"))).alias(name)
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*[last(n) for n in tasks], F.count("*").alias("n_rows"))


def once_then_back(rows: DataFrame, key: str, expensive, order: str) -> DataFrame:
    """Applies `expensive` (DataFrame to DataFrame that keeps the key) to the first row of each key, and gives every row its result."""
    first = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_rn = 1").drop("_rn")
    return rows.join(expensive(first), key)


def keep(rows: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group in a stated order (drop_duplicates with a definite survivor)."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def fits(label: Column, expected: Column) -> Column:
    """Whether a label array has as many entries as its level has rows; arrays with missing entries pass."""
    return F.exists(label, lambda x: x.isNull()) | (F.size(label) == expected)


def padded(label: Column, size: int) -> Column:
    """The array with NULLs after it up to `size`, or its first `size` entries."""
    label = F.coalesce(label, F.array().cast("array<double>"))
    return F.slice(F.concat(label, F.array_repeat(F.lit(None).cast("double"), size)), 1, size)


def label_statistics(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: min, max, mean, population std and count of each column, missing values left out."""
    return rows.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop), ("n", F.count))])


def normalised(x: Column, stats: dict[str, Column], method: str | None, low: float | None = None, high: float | None = None) -> Column:
    """None: as it is; "normal": z-score; "unit": to 0..1. Clipping needs both bounds, which then also stand for min and max.
    A constant column has no scale: null."""
    if method not in (None, "normal", "unit"):
        raise ValueError(f"method is None, normal or unit, not {method!r}")
    clip = low is not None and high is not None
    x = F.least(F.greatest(x, F.lit(low)), F.lit(high)) if clip else x
    if method == "normal":
        return F.try_divide(x - stats["mean"], stats["std"])
    if method == "unit":
        a, b = (F.lit(low), F.lit(high)) if clip else (stats["min"], stats["max"])
        return F.try_divide(x - a, b - a)
    return x


def normalised_by(rows: DataFrame, column: str, method: str | None, fitted: Column) -> DataFrame:
    """rows with `column` normalised by the statistics of the rows where `fitted` holds (the train split)."""
    s = rows.where(fitted).agg(*[f(column).alias(f"_{n}") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))])
    stats = {n: F.col(f"_{n}") for n in ("min", "max", "mean", "std")}
    return rows.crossJoin(F.broadcast(s)).withColumn(column, normalised(F.col(column), stats, method)).drop("_min", "_max", "_mean", "_std")  # one row


def denormalised(x: Column, stats: dict[str, Column], method: str | None) -> Column:
    if method == "normal":
        return x * stats["std"] + stats["mean"]
    return x * (stats["max"] - stats["min"]) + stats["min"] if method == "unit" else x


def balance_weights(rows: DataFrame, label: str) -> DataFrame:
    """weight: p for negatives and 1/p for positives, p the share of positives, over the largest weight; labels 0 and 1 only. Null where all
    labels are alike: there is nothing to balance."""
    p = rows.agg(F.avg(label).alias("_p"))
    out = rows.crossJoin(F.broadcast(p))  # one row
    raw = F.when(F.col(label) == 0, F.col("_p")).when(F.col(label) == 1, F.try_divide(F.lit(1.0), F.col("_p")))
    weight = F.try_divide(raw, F.greatest(F.col("_p"), F.try_divide(F.lit(1.0), F.col("_p"))))
    return out.withColumn("weight", F.when((F.col("_p") > 0) & (F.col("_p") < 1), weight)).drop("_p")


def balance_weights_all(rows: DataFrame, names: list[str]) -> DataFrame:
    """weight: for each label p where it is 0 and 1/p where it is 1 (p: its share of ones), multiplied over all labels and divided by the
    largest such product. A missing label, and one whose values are all alike, counts as 1. Other values than 0, 1 and null are
    an error. Two aggregates of one row each; the rows themselves are not shuffled."""
    odd = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(0, 1), F.raise_error(F.lit(f"label {c} is not binary")).cast("double")).otherwise(F.col(c).cast("double")) for c in names]
    shares = rows.agg(*[F.avg(x).alias(f"_p{k}") for k, x in enumerate(odd)])
    out = rows.crossJoin(F.broadcast(shares))  # one row
    product = F.lit(1.0)
    for k, c in enumerate(names):
        p = F.col(f"_p{k}")
        product = product * F.when(F.col(c).isNull() | p.isNull() | (p <= 0) | (p >= 1), F.lit(1.0)).when(F.col(c) == 1, 1 / F.when(p > 0, p)).otherwise(p)
    out = out.withColumn("_raw", product)
    return out.crossJoin(F.broadcast(out.agg(F.max("_raw").alias("_top")))).withColumn("weight", F.col("_raw") / F.col("_top")).drop("_raw", "_top", *[f"_p{k}" for k in range(len(names))])


def drop_rare(rows: DataFrame, names: list[str], least: int) -> tuple[DataFrame, list[str]]:
    """rows without the label columns (of names) that have fewer than `least` positive values, and which went; one aggregate counts all."""
    found = rows.agg(*[F.count_if(F.col(c) > 0).alias(f"_{k}") for k, c in enumerate(names)]).first()
    gone = [c for k, c in enumerate(names) if found[k] < least]
    return rows.drop(*gone), gone


def bucket(x: Column, cuts: list[float]) -> Column:
    """How many cuts x lies above (a value on a cut lies below it)."""
    out = F.lit(0)
    for k, c in enumerate(cuts):
        out = F.when(x > c, k + 1).otherwise(out)
    return F.when(x.isNotNull(), out)


def one_of_k(x: Column, classes: list) -> Column:
    """Ones and zeros, one slot a class and a last one for anything else."""
    own = F.array(*[F.lit(c) for c in classes])
    return F.concat(F.transform(own, lambda c: F.when(c == x, 1).otherwise(0)), F.array(F.when(F.array_contains(own, x), 0).otherwise(1)))
