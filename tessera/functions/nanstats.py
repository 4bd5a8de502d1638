"""Statistics in which NaN counts as missing: NaN becomes NULL, and SQL aggregates leave NULL out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(x: Column) -> Column:
    """x, or NULL where it is NaN."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def nan_mean(x: Column) -> Column:
    return F.avg(known(x))


def nan_var(x: Column, unbiased: bool = True) -> Column:
    return F.var_samp(known(x)) if unbiased else F.var_pop(known(x))


def nan_std(x: Column, unbiased: bool = True) -> Column:
    return F.stddev_samp(known(x)) if unbiased else F.stddev_pop(known(x))


def nan_median(name: str) -> Column:
    """The lower median of a column: a value that occurs."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY nanvl(CAST(`{name}` AS DOUBLE), NULL))")


def nan_count(x: Column) -> Column:
    return F.count(known(x))


def mask_non_finite(x: Column, value: float | None | str) -> Column:
    """None: as it is; "raise": an error for NaN or an infinity; a number: put in their place."""
    if value is None:
        return x
    bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    if value == "raise":
        return F.when(bad, F.raise_error(F.lit("NaN or an infinity among the values")).cast("double")).otherwise(x)
    return F.when(bad, F.lit(float(value))).otherwise(x)
