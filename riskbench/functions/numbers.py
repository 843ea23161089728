"""Small numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def r6(c: Column) -> Column:
    """Rounded to six decimals, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def r9(c: Column) -> Column:
    """Nine decimals, for means of short decimals that would often lie on a rounding tie at six."""
    return F.round(c, 9) + F.lit(0.0)


def shown(name: str) -> Column:
    """A metric column rounded for comparison."""
    return (r9 if name in ("brier", "ece") else r6)(F.col(name))


def sum_when(cond: Column, value: Column | int = 1) -> Column:
    v = value if isinstance(value, Column) else F.lit(value)
    return F.coalesce(F.sum(F.when(cond, v)), F.lit(0))


def not_finite(c: Column) -> Column:
    """True for NaN and both infinities; NULL is missing, not non-finite."""
    d = c.cast("double")
    return F.coalesce(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), F.lit(False))


def clip(c: Column, lo: float, hi: float) -> Column:
    """Clipped to [lo, hi]; NULL stays NULL (least/greatest alone would drop it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def count_below(cuts: Column, x: Column, strict: bool = True) -> Column:
    """How many entries of a short sorted array lie below ``x`` (or at most ``x``)."""
    return F.size(F.filter(cuts, lambda e: e < x if strict else e <= x))
