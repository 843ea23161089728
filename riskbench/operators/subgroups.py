"""Metrics per subgroup, the worst subgroup, gaps between subgroups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from . import metrics as M

MIN_N = 30
SHOWN = ["sensitivity", "specificity", "ppv", "pr_auc", "roc_auc", "brier"]


def subgroup_table(
    pred: DataFrame, keys: Sequence[str], threshold: float = 0.5, min_n: int = MIN_N, row_bound: int | None = None
) -> DataFrame:
    """(key, level, n, prevalence, reportable, metrics...): an ALL row and one row per level of each key.

    A level with one class has no metrics and is not reportable; nor is one below ``min_n`` rows. Null levels are dropped.
    Each prediction is expanded to its levels once, so all keys share one aggregation.
    """
    cells = [F.struct(F.lit("ALL").alias("key"), F.lit("ALL").alias("level"))]
    cells += [
        F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("level"))) for k in keys
    ]
    long = pred.select("y", "p", F.inline(F.array_compact(F.array(*cells))))
    s = M.summary(long, ["key", "level"], threshold, row_bound)
    whole = F.col("key") == "ALL"
    two = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))
    return s.select(
        "key",
        "level",
        "n",
        (F.col("n_pos") / F.col("n")).alias("prevalence"),
        (whole | (two & (F.col("n") >= min_n))).alias("reportable"),
        *[F.when(whole | two, F.col(m)).alias(m) for m in SHOWN],
    )


def _candidates(table: DataFrame, metric: str, reportable_only: bool = True) -> DataFrame:
    t = table.where((F.col("key") != "ALL") & F.col(metric).isNotNull())
    return t.where("reportable") if reportable_only else t


def worst_subgroup(table: DataFrame, metric: str = "sensitivity", reportable_only: bool = True) -> DataFrame:
    """The row with the smallest metric; no candidate is an error."""
    out = _candidates(table, metric, reportable_only).orderBy(metric, "key", "level").limit(1)
    if out.isEmpty():
        raise ValueError("no reportable subgroups")
    return out


def disparity(table: DataFrame, metric: str = "sensitivity") -> DataFrame:
    """(key, gap): largest minus smallest value, for keys with at least two reportable levels."""
    g = _candidates(table, metric).groupBy("key").agg((F.max(metric) - F.min(metric)).alias("gap"), F.count("*").alias("_n"))
    return g.where("_n >= 2").drop("_n")


def format_table(table: DataFrame) -> DataFrame:
    """Text table: three decimals, ``-`` for undefined values, a mark on small levels."""
    cols = ["prevalence", *M.HEADLINE, "ppv", "pr_auc", "brier"]
    mark = F.when(F.col("reportable"), "").otherwise("  (n too small)")
    return table.select(
        "key",
        F.concat("level", mark).alias("level"),
        "n",
        *[F.coalesce(F.when(F.col(c).isNotNull(), F.format_string("%.3f", F.col(c))), F.lit("-")).alias(c) for c in cols],
    )
