"""Encoding that learns nothing: the layout comes from the contract, not from the data."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .. import schema as S
from .numbers import clip

# Bounds of the angle scale for derived columns.
ANGLE_BOUNDS = {
    "age_years": (18.0, 100.0),
    "bmi": (10.0, 80.0),
    "ap_hi": (60.0, 250.0),
    "ap_lo": (30.0, 150.0),
    "pulse_pressure": (0.0, 220.0),
    "map": (30.0, 200.0),
    "cholesterol": (1.0, 3.0),
    "gluc": (1.0, 3.0),
    "active": (0.0, 1.0),
    "gender": (1.0, 2.0),
    "smoke": (0.0, 1.0),
    "alco": (0.0, 1.0),
}
# End of fixed values.


def one_hot_names() -> list[str]:
    return [f"{c}={v}" for c in S.CATEGORICAL for v in S.CATEGORIES[c][1:]]


def indicator_names() -> list[str]:
    return [f"{c}__missing" for c in S.NUMERIC]


def feature_names(add_missing_indicators: bool = True) -> list[str]:
    """Numeric, binary, one-hot without the first code, then indicators."""
    return S.NUMERIC + S.BINARY_NUMERIC + one_hot_names() + (indicator_names() if add_missing_indicators else [])


def encode(df: DataFrame, add_missing_indicators: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Columns of ``feature_names`` as doubles. A missing code is all zeros; numeric nulls stay null."""
    cols = [F.col(c).cast("double").alias(c) for c in S.NUMERIC + S.BINARY_NUMERIC]
    cols += [
        F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)).alias(f"{c}={v}")
        for c in S.CATEGORICAL
        for v in S.CATEGORIES[c][1:]
    ]
    if add_missing_indicators:
        cols += [F.col(c).isNull().cast("double").alias(f"{c}__missing") for c in S.NUMERIC]
    return df.select(*keep, *cols)


def angle_bounds(name: str) -> tuple[float, float]:
    """Derived-column bounds, then contract ranges, then 0-1 for flags, indicators and one-hot columns."""
    if name in ANGLE_BOUNDS:
        return ANGLE_BOUNDS[name]
    if name in S.PLAUSIBLE:
        lo, hi = S.PLAUSIBLE[name]
        return float(lo), float(hi)
    if name in S.BINARY_NUMERIC or name.endswith("__missing") or "=" in name:
        return 0.0, 1.0
    raise S.ContractError(f"no fixed bounds for {name!r}")


def fixed_angles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns mapped from fixed bounds to [0, pi]. Check with ``contract.require_finite`` first; NULL stays NULL."""
    out = {}
    for c in columns:
        lo, hi = angle_bounds(c)
        out[c] = clip((F.col(c).cast("double") - lo) / (hi - lo), 0.0, 1.0) * math.pi
    return df.withColumns(out)
