"""Robust and guarded statistics as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAD_SCALE = 1.4826


def number(x: Column) -> Column:
    """Missing values as null: NaN doesn't reach averages or orders."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def zscore(x: Column, mean: Column, std: Column, floor: float = 1e-6) -> Column:
    return (x - mean) / F.greatest(std, F.lit(floor))


def ratio(x: Column, base: Column, otherwise: Column) -> Column:
    """x / base, or ``otherwise`` where base isn't positive."""
    return F.when(base > 0, x / base).otherwise(otherwise)


def bin_of(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin from 0 of equal widths; the last one includes ``high``."""
    return F.least(F.floor((x - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")


def percent(hits: Column, of: Column) -> Column:
    return F.coalesce(F.try_divide(hits.cast("double"), of.cast("double")), F.lit(0.0)) * 100


def ratio_of_z(z: Column) -> Column:
    """A deviation on the scale of ratios: 1 + z / 10."""
    return 1 + z * 0.1
