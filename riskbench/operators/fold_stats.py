"""Statistics of the training rows of each fold, and the transforms that use them.

Nothing is refitted per fold. Additive statistics are computed once per fold and merged over the other folds; everything
that needs the distribution works on distinct values with one training count per fold. Fitted tables have one row per
(rep, fold) or (rep, fold, feature), so applying them is a broadcast join of a table that does not grow with the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import ordering as O
from ..functions.numbers import clip, sum_when
from .audit import melt
from .quantiles import quantiles_of_counts, train_fold_quantiles

KEYS = ["rep", "fold"]


def training_rows(df: DataFrame, k: int) -> DataFrame:
    """Each row once per fold it trains: ``fold`` becomes the held-out fold. Only for fits that need the rows themselves."""
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold"))
    return df.withColumn("_train", F.explode(others)).withColumn("fold", F.col("_train").cast("int")).drop("_train")


def long_values(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ("rep", "fold")) -> DataFrame:
    return melt(df, features, keep, "feature", "value")


def train_medians(df: DataFrame, features: Sequence[str], k: int, row_bound: int | None = None) -> DataFrame:
    """(rep, fold, feature, median) of the training rows."""
    q = train_fold_quantiles(long_values(df, features), "value", [0.5], k, row_bound)
    return q.select(*KEYS, "feature", F.col("edges")[0].alias("median"))


def train_modes(df: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    """(rep, fold, feature, mode): most frequent training value, the lowest on ties."""
    known = long_values(df, features).where(F.col("value").isNotNull())
    counts = known.groupBy("rep", "feature", "value").agg(
        *[sum_when(F.col("fold") != f).cast("long").alias(f"t{f}") for f in range(k)]
    )
    best = counts.groupBy("rep", "feature").agg(
        *[F.max(F.when(F.col(f"t{f}") > 0, F.struct(F.col(f"t{f}").alias("n"), (-F.col("value")).alias("v")))).alias(f"b{f}") for f in range(k)]
    )
    cells = F.array(*[F.struct(F.lit(f).alias("fold"), (-F.col(f"b{f}.v")).alias("mode")) for f in range(k)])
    return best.select("rep", "feature", F.inline(cells))


def train_moments(df: DataFrame, features: Sequence[str], k: int, fill: DataFrame | None = None) -> DataFrame:
    """(rep, fold, feature, n, mean, sd, min, max) of the training rows; population sd, never zero (1 instead).

    With ``fill`` (rep, fold, feature, median) missing values count as the median of the same training rows.
    """
    per = long_values(df, features).groupBy("rep", "feature", "fold").agg(
        F.count("value").alias("n"),
        F.count(F.when(F.col("value").isNull(), 1)).alias("nulls"),
        F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean"),
        F.coalesce(F.var_pop("value") * F.count("value"), F.lit(0.0)).alias("m2"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
    )
    part = F.struct("n", "mean", "m2")
    target = F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold"))).alias("to")
    t = per.select("*", target).groupBy("rep", F.col("to").alias("fold"), "feature").agg(
        F.collect_list(part).alias("parts"),  # k - 1 entries
        F.sum("nulls").alias("nulls"),
        F.min("lo").alias("min"),
        F.max("hi").alias("max"),
    )
    if fill is not None:
        t = t.join(F.broadcast(fill), [*KEYS, "feature"])
        extra = F.struct(F.col("nulls").alias("n"), F.coalesce("median", F.lit(0.0)).alias("mean"), F.lit(0.0).alias("m2"))
        t = t.withColumn("parts", F.concat("parts", F.array(extra)))
    n = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["n"])
    total = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["n"] * p["mean"])
    t = t.withColumn("n", n).withColumn("mean", F.try_divide(total, F.col("n").cast("double")))
    m2 = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["m2"] + p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")))
    sd = F.sqrt(m2 / F.col("n"))
    return t.select(*KEYS, "feature", "n", "mean", F.when(sd > 0, sd).otherwise(1.0).alias("sd"), "min", "max")


def fitted(stats: DataFrame) -> DataFrame:
    """A fitted table as a local one: reps x folds x features rows, whatever the data. Used several times, computed once."""
    return stats.sparkSession.createDataFrame([tuple(r) for r in stats.collect()], stats.schema)


def wide(stats: DataFrame, features: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per (rep, fold) with columns ``<value>__<feature>``."""
    return stats.groupBy(*KEYS).agg(
        *[F.max(F.when(F.col("feature") == f, F.col(v))).alias(f"{v}__{f}") for f in features for v in values]
    )


def _apply(df: DataFrame, stats: DataFrame, features: Sequence[str], values: Sequence[str], to) -> DataFrame:
    table = wide(stats, features, values)
    joined = df.join(F.broadcast(table), KEYS)  # rep x fold rows
    out = joined.withColumns({f: to(f) for f in features})
    return out.drop(*[f"{v}__{f}" for f in features for v in values])


def impute(df: DataFrame, stats: DataFrame, features: Sequence[str], value: str = "median") -> DataFrame:
    """Missing values of each row replaced by the statistic of its (rep, fold)."""
    return _apply(df, stats, features, [value], lambda f: F.coalesce(F.col(f).cast("double"), F.col(f"{value}__{f}")))


def standardise(df: DataFrame, stats: DataFrame, features: Sequence[str]) -> DataFrame:
    return _apply(df, stats, features, ["mean", "sd"], lambda f: (F.col(f) - F.col(f"mean__{f}")) / F.col(f"sd__{f}"))


def range_angles(df: DataFrame, stats: DataFrame, features: Sequence[str]) -> DataFrame:
    """Training range to [0, pi]; other rows are clipped; a span below 1e-12 counts as 1."""

    def to(f: str) -> Column:
        span = F.col(f"max__{f}") - F.col(f"min__{f}")
        return clip((F.col(f) - F.col(f"min__{f}")) / F.when(span < 1e-12, 1.0).otherwise(span), 0.0, 1.0) * math.pi

    return _apply(df, stats, features, ["min", "max"], to)


# ---------------------------------------------------------------- distinct training values


def train_values(df: DataFrame, features: Sequence[str], target: str, k: int, fill: DataFrame | None = None) -> DataFrame:
    """(rep, fold, feature, value, n0, n1): label counts of each distinct training value.

    Rows are aggregated once per repeat; only distinct values are expanded to the folds. With ``fill`` a missing value
    counts as the fold's median, otherwise it is left out.
    """
    y = F.col(target)
    cells = long_values(df, features, ("rep", "fold", target)).groupBy("rep", "feature", "value").agg(
        *[sum_when((F.col("fold") != f) & (y == v)).cast("long").alias(f"n{v}_{f}") for f in range(k) for v in (0, 1)]
    )
    per_fold = F.array(
        *[F.struct(F.lit(f).alias("fold"), F.col(f"n0_{f}").alias("n0"), F.col(f"n1_{f}").alias("n1")) for f in range(k)]
    )
    t = cells.select("rep", "feature", "value", F.inline(per_fold)).where("n0 + n1 > 0")
    if fill is None:
        return t.where(F.col("value").isNotNull())
    filled = t.join(F.broadcast(fill), [*KEYS, "feature"]).withColumn("value", F.coalesce("value", "median"))
    return filled.groupBy(*KEYS, "feature", "value").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def value_edges(values: DataFrame, n_bins: int, row_bound: int | None = None, groups: Sequence[str] = ("rep", "fold", "feature")) -> DataFrame:
    """(groups..., edges): deduplicated interior quantiles of counted values."""
    probs = [i / n_bins for i in range(1, n_bins)]
    counted = values.withColumn("_w", F.col("n0") + F.col("n1"))
    cuts = O.fit_cuts(counted, groups, "value", row_bound)
    q = quantiles_of_counts(counted, groups, "value", "_w", probs, cuts)
    return q.select(*groups, F.array_sort(F.array_distinct(F.array(*[F.col(f"q{i}") for i in range(len(probs))]))).alias("edges"))
