"""Rounding and guarded statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int = 0) -> Column:
    """Half away from zero on the binary value, as SQL's ROUND of a double."""
    scale = 10.0**places
    x = x.cast("double")
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def js_round(x: Column) -> Column:
    """floor(x + 0.5): half towards positive infinity."""
    return F.floor(x.cast("double") + 0.5)


def percent(part: Column, whole: Column, places: int = 1) -> Column:
    """part / whole * 100; null where whole is 0 or null."""
    return rounded(F.try_divide(part.cast("double"), whole.cast("double")) * 100, places)


def score(positive: Column, negative: Column, total: Column) -> Column:
    """Sentiment score: (positive - negative) / total * 100; null on no rows."""
    return percent(positive - negative, total)


def correlation(x: Column, y: Column, least: int = 4) -> Column:
    """Pearson's r as an aggregate; 0 where there are fewer than ``least`` rows or no variance."""
    both = x.isNotNull() & y.isNotNull()
    n = F.count(F.when(both, 1))
    r = F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(F.when(both, x)) * F.var_pop(F.when(both, y))))
    return F.when(n >= least, F.coalesce(r, F.lit(0.0))).otherwise(0.0)


def slope(y: Column, x: Column) -> Column:
    """Least-squares slope as an aggregate; 0 where x doesn't vary."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.var_pop(x)), F.lit(0.0))


#: Abramowitz and Stegun 26.2.17: fixed values.
_CDF = (0.3193815, -0.3565638, 1.781478, -1.821256, 1.330274)


def normal_cdf(z: Column) -> Column:
    """The normal distribution function by a polynomial (error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = F.lit(0.0)
    for c in reversed(_CDF):
        poly = (poly + c) * t
    tail = 0.3989423 * F.exp(-z * z / 2) * poly
    return F.when(z > 0, 1 - tail).otherwise(tail)


def strength(r: Column) -> Column:
    return F.when(F.abs(r) >= 0.6, "high").when(F.abs(r) >= 0.35, "medium").otherwise("low")
