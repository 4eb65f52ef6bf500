"""Numeric column helpers: guarded ratios, half-up rounding, clamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: rounds .5 towards +infinity, as the source reports do.

    Doubles from 2^53 on are whole already; the floor of the engine is a long and would stop at its greatest.
    """
    scale = float(10**digits)
    y = (x * F.lit(scale) + F.lit(0.5)).cast("double")
    return F.when(F.abs(y) < F.lit(2.0**53), F.floor(y).cast("double")).otherwise(y) / F.lit(scale)


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b as double, ``empty`` when b is not positive."""
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(empty))


def pct(a: Column, b: Column, digits: int = 0, empty: float = 0.0) -> Column:
    """Percentage of a in b, half-up rounded."""
    return half_up(ratio(a, b, empty / 100.0) * 100.0, digits)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
