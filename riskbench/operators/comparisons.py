"""Tests between models on paired predictions or paired fold scores, and their verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import tails as T
from ..functions.numbers import sum_when

EXACT_BELOW = 25
TOO_FEW = 10


# ---------------------------------------------------------------- McNemar


def paired_correctness(pred: DataFrame, model_a: str, model_b: str, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n_both_correct, n_a_only, n_b_only, n_both_wrong) over records that both models scored.

    One aggregation by record brings the two predictions together; no self-join.
    """
    ok = ((F.col("p") >= F.lit(float(threshold))).cast("int") == F.col("y")).cast("int")
    per = (
        pred.where(F.col("model").isin(model_a, model_b))
        .groupBy(*by, "record_id")
        .agg(
            F.max(F.when(F.col("model") == model_a, ok)).alias("a"),
            F.max(F.when(F.col("model") == model_b, ok)).alias("b"),
        )
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
    )
    a, b = F.col("a") == 1, F.col("b") == 1
    return per.groupBy(*by).agg(
        sum_when(a & b).cast("long").alias("n_both_correct"),
        sum_when(a & ~b).cast("long").alias("n_a_only"),
        sum_when(~a & b).cast("long").alias("n_b_only"),
        sum_when(~a & ~b).cast("long").alias("n_both_wrong"),
    )


def mcnemar(counts: DataFrame, exact: bool | None = None, alpha: float = 0.05) -> DataFrame:
    """Add n_discordant, method, statistic, p_value and verdict.

    Exact binomial below 25 discordant records, else chi-square with continuity correction.
    """
    a, b = F.col("n_a_only"), F.col("n_b_only")
    n = a + b
    use_exact = (n < EXACT_BELOW) if exact is None else F.lit(bool(exact))
    gap = F.abs(a - b).cast("double")
    chi = F.try_divide((gap - 1) * (gap - 1), n)
    out = counts.withColumns(
        {
            "n_discordant": n,
            "method": F.when(n == 0, "identical predictions").when(use_exact, "exact binomial").otherwise("chi-square with continuity correction"),
            "statistic": F.when(n == 0, F.lit(0.0)).when(use_exact, F.least(a, b).cast("double")).otherwise(chi),
        }
    )
    p = (
        F.when(n == 0, F.lit(1.0))
        .when(use_exact, T.binomial_two_sided(F.least(a, b), n))
        .otherwise(T.chi2_1_upper(F.col("statistic")))
    )
    out = out.withColumn("p_value", p)
    verdict = (
        F.when(n < TOO_FEW, F.format_string("inconclusive: only %d discordant cases", n))
        .when(F.col("p_value") >= alpha, F.format_string("no significant difference (p=%.3f)", F.col("p_value")))
        .otherwise(
            F.format_string(
                "%s is better (p=%.3f), by %d of %d discordant", F.when(a > b, "A").otherwise("B"), F.col("p_value"), F.abs(a - b), n
            )
        )
    )
    return out.withColumn("verdict", verdict)


# ---------------------------------------------------------------- t tests on paired differences


def paired_differences(scores: DataFrame, unit: Sequence[str], arm: str, value: str, reference: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., arm, unit..., diff) = reference - arm, paired on the unit (a draw, or a repeat and fold)."""
    ref = scores.where(F.col(arm) == reference).select(*by, *unit, F.col(value).alias("_ref"))
    other = scores.where(F.col(arm) != reference)
    return other.join(ref, [*by, *unit]).select(*by, arm, *unit, (F.col("_ref") - F.col(value)).alias("diff"))


def _moments(diffs: DataFrame, by: Sequence[str]) -> DataFrame:
    g = diffs.groupBy(*by).agg(F.count("diff").alias("n"), F.avg("diff").alias("mean"), F.stddev_samp("diff").alias("_sd"))
    return g.where("n >= 2").withColumns({"df": F.col("n") - 1, "se": F.col("_sd") / F.sqrt("n")}).drop("_sd")


def paired_t(diffs: DataFrame, by: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """(by..., n, df, mean, se, t, p_value, ci_low, ci_high, verdict) over independent differences; groups of one are left out."""
    m = _moments(diffs, by)
    flat = F.col("se") <= 0
    t = F.when(~flat, F.col("mean") / F.col("se"))
    m = m.withColumn("t", t)
    crit = T.quantile(1 - alpha / 2, F.col("df"))
    out = m.withColumn("p_value", F.when(flat, F.lit(1.0)).otherwise(T.two_sided_p(F.col("t"), F.col("df"))))
    out = out.withColumn("_half", F.when(flat, F.lit(0.0)).otherwise(crit * F.col("se")))
    out = out.withColumns({"ci_low": F.col("mean") - F.col("_half"), "ci_high": F.col("mean") + F.col("_half")}).drop("_half")
    sign = F.when(F.col("mean") > 0, "A > B").otherwise("A < B")
    verdict = F.when(
        F.col("p_value") < alpha, F.format_string("%s: %+.4f [%+.4f, %+.4f], p=%.4f", sign, "mean", "ci_low", "ci_high", "p_value")
    ).otherwise(F.format_string("no detected difference: %+.4f [%+.4f, %+.4f], p=%.3f", "mean", "ci_low", "ci_high", "p_value"))
    return out.withColumn("verdict", verdict)


def equivalence(diffs: DataFrame, by: Sequence[str], margin: float, alpha: float = 0.05) -> DataFrame:
    """Two one-sided tests: (by..., n, df, mean, se, p_value, equivalent, ci_low, ci_high, bound, verdict).

    The interval has level 1 - 2 alpha; ``bound`` is its larger absolute end, the smallest margin that would pass.
    """
    if margin <= 0:
        raise ValueError("the margin must be positive")
    m = _moments(diffs, by)
    flat = F.col("se") <= 0
    mean, se, df = F.col("mean"), F.col("se"), F.col("df")
    safe = F.when(flat, F.lit(1.0)).otherwise(se)
    lower = T.upper_tail((mean + margin) / safe, df)
    upper = 1 - T.upper_tail((mean - margin) / safe, df)
    inside = F.abs(mean) < margin
    out = m.withColumn("p_value", F.when(flat, F.when(inside, 0.0).otherwise(1.0)).otherwise(F.greatest(lower, upper)))
    out = out.withColumn("equivalent", F.when(flat, inside).otherwise(F.col("p_value") < alpha))
    out = out.withColumn("_half", F.when(flat, F.lit(0.0)).otherwise(T.quantile(1 - alpha, df) * se))
    out = out.withColumns({"ci_low": mean - F.col("_half"), "ci_high": mean + F.col("_half")}).drop("_half")
    out = out.withColumn("bound", F.greatest(F.abs("ci_low"), F.abs("ci_high")))
    verdict = F.when(
        F.col("equivalent"), F.format_string("equivalent within +-%.4f (p=%.4f); above %.4f excluded", F.lit(float(margin)), "p_value", "bound")
    ).otherwise(F.format_string("NOT equivalent within +-%.4f (p=%.3f); only above %.4f excluded", F.lit(float(margin)), "p_value", "bound"))
    return out.withColumn("verdict", verdict)


def corrected_resampled_t(diffs: DataFrame, by: Sequence[str], n_train: Column, n_test: Column) -> DataFrame:
    """Nadeau-Bengio t over repeated folds: variance times (1/k + n_test/n_train). (by..., k, delta, t, p_value)

    Equal fold scores give t = 0 and p = 1.
    """
    g = diffs.groupBy(*by).agg(F.count("diff").alias("k"), F.avg("diff").alias("delta"), F.var_samp("diff").alias("_var"))
    g = g.where("k >= 2")
    scale = 1 / F.col("k") + n_test / F.greatest(n_train, F.lit(1))
    varied = F.col("_var") > 0
    g = g.withColumn("t", F.when(varied, F.col("delta") / F.sqrt(F.col("_var") * scale)).otherwise(F.lit(0.0)))
    return g.withColumn("p_value", F.when(varied, T.two_sided_p(F.col("t"), F.col("k") - 1)).otherwise(F.lit(1.0))).drop("_var")


def holm(tests: DataFrame, p: str = "p_value", alpha: float = 0.05, by: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """Add p_adjusted = min(1, p (m - i)) in ascending order and the step-down flag ``rejected``. One row per comparison."""
    order = W.partitionBy(*by).orderBy(p, *tie)
    m = F.count("*").over(W.partitionBy(*by))
    i = F.row_number().over(order) - 1
    out = tests.withColumn("p_adjusted", F.least(F.lit(1.0), F.col(p) * (m - i)))
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    return out.withColumn("rejected", F.min(F.col("p_adjusted") < alpha).over(upto))
