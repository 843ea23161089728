"""Exact quantiles with linear interpolation, without holding a column's values on one task.

The column is aggregated to distinct values with counts, and a running count (see ``functions.ordering``) finds the two
values around each position. Training-fold quantiles use the same table with one count per fold: training count = all
rows minus the fold's rows, so no row is copied once per training set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import ordering as O
from ..functions.numbers import sum_when


def _at(position: Column, value: str, cum: Column, own: Column) -> Column:
    """Value at a 0-based position: the largest value with fewer than position + 1 rows strictly before it."""
    return F.max(F.when((own > 0) & (cum - own <= position), F.col(value)))


def _interpolated(q: float, value: str, cum: str, own: str, total: str) -> tuple[Column, Column, Column]:
    last = F.col(total) - 1
    pos = last * F.lit(q)
    return _at(F.floor(pos), value, F.col(cum), F.col(own)), _at(F.ceil(pos), value, F.col(cum), F.col(own)), F.max(pos - F.floor(pos))


def exact_quantiles(
    long: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float], row_bound: int | None = None
) -> DataFrame:
    """One row per group with columns q0, q1, ... for the probabilities; nulls are skipped."""
    known = long.where(F.col(value).isNotNull())
    counts = known.groupBy(*groups, value).agg(F.count("*").alias("_c"))
    return quantiles_of_counts(counts, groups, value, "_c", probs, O.fit_cuts(known, groups, value, row_bound))


def quantiles_of_counts(
    counts: DataFrame, groups: Sequence[str], value: str, weight: str, probs: Sequence[float], cuts: DataFrame | None = None
) -> DataFrame:
    """As ``exact_quantiles``, over distinct values with a row count each."""
    groups = list(groups)
    run = O.running_sums(counts, groups, value, [weight], cuts=cuts)
    aggs = []
    for i, q in enumerate(probs):
        lo, hi, frac = _interpolated(q, value, f"cum_{weight}", weight, f"total_{weight}")
        aggs += [lo.alias(f"lo{i}"), hi.alias(f"hi{i}"), frac.alias(f"fr{i}")]
    cells = run.groupBy(*groups).agg(*aggs)
    return cells.select(
        *groups,
        *[(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"fr{i}")).alias(f"q{i}") for i in range(len(probs))],
    )


def train_fold_quantiles(
    long: DataFrame, value: str, probs: Sequence[float], k: int, row_bound: int | None = None
) -> DataFrame:
    """(rep, fold, feature, edges array): quantiles of the training rows of each fold.

    ``long`` has rep, fold, feature and the value. One distinct-value table serves all k training sets of a repeat.
    """
    known = long.where(F.col(value).isNotNull())
    counts = known.groupBy("rep", "feature", value).agg(
        *[sum_when(F.col("fold") != f).cast("long").alias(f"t{f}") for f in range(k)]
    )
    groups = ["rep", "feature"]
    cuts = O.fit_cuts(known, groups, value, row_bound)
    run = O.running_sums(counts, groups, value, [f"t{f}" for f in range(k)], cuts=cuts)
    aggs = []
    for f in range(k):
        for i, q in enumerate(probs):
            lo, hi, frac = _interpolated(q, value, f"cum_t{f}", f"t{f}", f"total_t{f}")
            aggs += [lo.alias(f"lo{f}_{i}"), hi.alias(f"hi{f}_{i}"), frac.alias(f"fr{f}_{i}")]
    cells = run.groupBy(*groups).agg(*aggs)

    def edge(f: int, i: int) -> Column:
        lo, hi, fr = F.col(f"lo{f}_{i}"), F.col(f"hi{f}_{i}"), F.col(f"fr{f}_{i}")
        return lo + (hi - lo) * fr

    return cells.select(
        *groups,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(f).alias("fold"), F.array(*[edge(f, i) for i in range(len(probs))]).alias("edges"))
                    for f in range(k)
                ]
            )
        ),
    )
