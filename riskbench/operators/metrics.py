"""Threshold, ranking and calibration metrics, grouped by any columns (model, rep, fold, subgroup).

Predictions (groups..., y, p) are first aggregated to distinct scores. That one shuffle carries everything: the confusion
counts, Brier and calibration sums are sums over distinct scores, and ROC-AUC, average precision and thresholds come from
one running sum down the scores. Copies of one score collapse before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import ordering as O
from ..functions.numbers import clip, count_below, sum_when
from ..session import stored

N_BINS = 10
ALL_METRICS = [
    "sensitivity", "specificity", "ppv", "npv", "pr_auc", "roc_auc", "balanced_accuracy",
    "f1", "mcc", "kappa", "brier", "ece", "accuracy",
]
HEADLINE = ["sensitivity", "specificity"]
_EPS = 1e-12


def label_violations(pred: DataFrame, y: str = "y") -> DataFrame:
    c = F.col(y)
    return pred.agg(F.count("*").alias("n"), sum_when(c.isNull() | ~c.isin(0, 1)).cast("long").alias("bad_labels"))


def checked(pred: DataFrame) -> DataFrame:
    """``pred`` whose rows fail the job when a label ``y`` is not 0 or 1 or a score ``p`` is missing or no number."""
    y, p = F.col("y"), F.col("p").cast("double")
    label = F.when(y.isin(0, 1), y).otherwise(F.raise_error(F.concat(F.lit("label must be 0 or 1: "), F.coalesce(y.cast("string"), F.lit("null")))))
    score = F.when(p.isNotNull() & ~F.isnan(p), p).otherwise(F.raise_error(F.lit("score is missing or not a number")))
    return pred.withColumns({"y": label.cast(pred.schema["y"].dataType), "p": score})


# ---------------------------------------------------------------- rates from confusion counts


def _c(name: str) -> Column:
    return F.col(name).cast("double")


def sensitivity() -> Column:
    return F.try_divide(_c("tp"), _c("tp") + _c("fn"))


def specificity() -> Column:
    return F.try_divide(_c("tn"), _c("tn") + _c("fp"))


def ppv() -> Column:
    return F.try_divide(_c("tp"), _c("tp") + _c("fp"))


def npv() -> Column:
    return F.try_divide(_c("tn"), _c("tn") + _c("fn"))


def accuracy() -> Column:
    return F.try_divide(_c("tp") + _c("tn"), _c("tp") + _c("tn") + _c("fp") + _c("fn"))


def f1() -> Column:
    """Harmonic mean of precision and recall; 0 when it is undefined."""
    both = ppv() + sensitivity()
    return F.when(both > _EPS, 2 * ppv() * sensitivity() / both).otherwise(F.lit(0.0))


def mcc() -> Column:
    tp, fp, fn, tn = _c("tp"), _c("fp"), _c("fn"), _c("tn")
    root = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return F.when(root > _EPS, (tp * tn - fp * fn) / root).otherwise(F.lit(0.0))


def kappa() -> Column:
    tp, fp, fn, tn = _c("tp"), _c("fp"), _c("fn"), _c("tn")
    n = tp + fp + fn + tn
    expected = F.try_divide(tp + fp, n) * F.try_divide(tp + fn, n) + F.try_divide(tn + fn, n) * F.try_divide(tn + fp, n)
    return F.when(F.abs(1 - expected) > _EPS, (accuracy() - expected) / (1 - expected)).otherwise(F.lit(0.0))


RATES = {
    "sensitivity": sensitivity,
    "specificity": specificity,
    "ppv": ppv,
    "npv": npv,
    "accuracy": accuracy,
    "balanced_accuracy": lambda: (sensitivity() + specificity()) / 2,
    "f1": f1,
    "mcc": mcc,
    "kappa": kappa,
    "youden_j": lambda: sensitivity() + specificity() - 1,
}


def with_rates(counts: DataFrame, names: Sequence[str] = tuple(RATES)) -> DataFrame:
    """Add rates to a table with tn, fp, fn, tp."""
    return counts.withColumns({n: RATES[n]() for n in names})


def confusion(pred: DataFrame, groups: Sequence[str], threshold: float | Column = 0.5) -> DataFrame:
    """(groups..., tn, fp, fn, tp); p >= threshold is positive."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    y, hit = F.col("y") == 1, F.col("p") >= t
    return checked(pred).groupBy(*groups).agg(
        sum_when(~y & ~hit).cast("long").alias("tn"),
        sum_when(~y & hit).cast("long").alias("fp"),
        sum_when(y & ~hit).cast("long").alias("fn"),
        sum_when(y & hit).cast("long").alias("tp"),
    )


# ---------------------------------------------------------------- distinct scores and curves


def distinct_scores(pred: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(groups..., p, n, pos, neg): one row per distinct score."""
    d = checked(pred).groupBy(*groups, "p").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("pos"))
    return d.withColumn("neg", F.col("n") - F.col("pos"))


def score_curve(pred: DataFrame, groups: Sequence[str], row_bound: int | None = None) -> DataFrame:
    """Distinct scores with running counts from the highest score down and group totals of positives and negatives."""
    cuts = O.fit_cuts(pred, groups, "p", row_bound)
    return O.running_sums(distinct_scores(pred, groups), groups, "p", ["pos", "neg"], descending=True, cuts=cuts)


def _roc_auc_sum() -> Column:
    """Pairs ranked right, ties as one half: each negative meets the positives above it and half of those beside it."""
    return F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0))


def _pr_auc_sum() -> Column:
    return F.sum(F.col("pos") * (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))))


def calibration_bin(p: Column, n_bins: int = N_BINS) -> Column:
    """0-based right-closed bin of a probability clipped to [0, 1]."""
    edges = F.array(*[F.lit(i * (1.0 / n_bins)) for i in range(1, n_bins)])
    return count_below(edges, p)


def _finished(sums: DataFrame, n_bins: int = N_BINS) -> DataFrame:
    """Every metric from n, n_pos, the confusion counts and the sums ``_sq``, ``_roc``, ``_pr`` and ``_gap<bin>``."""
    return with_rates(sums).withColumns(
        {
            "roc_auc": F.try_divide(F.col("_roc"), _c("n_pos") * (F.col("n") - F.col("n_pos"))),
            "pr_auc": F.try_divide(F.col("_pr"), _c("n_pos")),
            "brier": F.col("_sq") / F.col("n"),
            "ece": sum((F.abs(F.col(f"_gap{b}")) for b in range(n_bins)), F.lit(0.0)) / F.col("n"),
        }
    )


def summary(
    pred: DataFrame,
    groups: Sequence[str],
    threshold: float | str = 0.5,
    row_bound: int | None = None,
    n_bins: int = N_BINS,
) -> DataFrame:
    """Every metric per group. ``threshold`` is a number or a column that is constant in each group.

    Undefined rates are NULL; ROC-AUC is NULL with one class, average precision is NULL without positives.
    """
    keys = list(groups) + ([threshold] if isinstance(threshold, str) else [])
    curve = score_curve(pred, keys, row_bound)
    t = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    p, pos, neg = F.col("p"), F.col("pos"), F.col("neg")
    hit = p >= t
    gap = pos - clip(p, 0.0, 1.0) * F.col("n")
    curve = curve.withColumn("_bin", calibration_bin(clip(p, 0.0, 1.0), n_bins))
    sums = curve.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum("pos").alias("n_pos"),
        sum_when(~hit, neg).cast("long").alias("tn"),
        sum_when(hit, neg).cast("long").alias("fp"),
        sum_when(~hit, pos).cast("long").alias("fn"),
        sum_when(hit, pos).cast("long").alias("tp"),
        F.sum(pos * (p - 1) * (p - 1) + neg * p * p).alias("_sq"),
        _roc_auc_sum().alias("_roc"),
        _pr_auc_sum().alias("_pr"),
        *[sum_when(F.col("_bin") == b, gap).alias(f"_gap{b}") for b in range(n_bins)],
    )
    out = _finished(sums, n_bins).withColumn("threshold", t)
    counts = ["n", "n_pos", "tn", "fp", "fn", "tp"]
    return out.select(*groups, *ALL_METRICS, "youden_j", F.col("threshold").cast("double").alias("threshold"), *counts)


def roc_auc(pred: DataFrame, groups: Sequence[str], row_bound: int | None = None) -> DataFrame:
    """(groups..., n, n_pos, roc_auc)."""
    curve = score_curve(pred, groups, row_bound)
    s = curve.groupBy(*groups).agg(F.sum("n").alias("n"), F.sum("pos").alias("n_pos"), _roc_auc_sum().alias("_roc"))
    return s.select(*groups, "n", "n_pos", F.try_divide(F.col("_roc"), _c("n_pos") * (F.col("n") - F.col("n_pos"))).alias("roc_auc"))


def average_precision(pred: DataFrame, groups: Sequence[str], row_bound: int | None = None) -> DataFrame:
    curve = score_curve(pred, groups, row_bound)
    s = curve.groupBy(*groups).agg(F.sum("pos").alias("n_pos"), _pr_auc_sum().alias("_pr"))
    return s.select(*groups, "n_pos", F.try_divide(F.col("_pr"), _c("n_pos")).alias("pr_auc"))


def brier(pred: DataFrame, groups: Sequence[str]) -> DataFrame:
    e = F.col("p") - F.col("y")
    return pred.groupBy(*groups).agg(F.avg(e * e).alias("brier"))


def calibration_table(pred: DataFrame, groups: Sequence[str], n_bins: int = N_BINS) -> DataFrame:
    """(groups..., bin, n, predicted, observed)."""
    p = clip(F.col("p"), 0.0, 1.0)
    return pred.groupBy(*groups, calibration_bin(p, n_bins).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg("y").alias("observed")
    )


def ece(pred: DataFrame, groups: Sequence[str], n_bins: int = N_BINS) -> DataFrame:
    bins = calibration_table(pred, groups, n_bins)
    gap = F.col("n") * F.abs(F.col("observed") - F.col("predicted"))
    return bins.groupBy(*groups).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def average_rank(df: DataFrame, groups: Sequence[str], value: str, row_bound: int | None = None) -> DataFrame:
    """(groups..., value, n, rank): the mean rank that tied values share, one row per distinct value."""
    known = df.where(F.col(value).isNotNull())
    distinct = known.groupBy(*groups, value).agg(F.count("*").alias("n"))
    run = O.running_sums(distinct, groups, value, ["n"], cuts=O.fit_cuts(known, groups, value, row_bound))
    return run.select(*groups, value, "n", (F.col("cum_n") - (F.col("n") - 1) / 2.0).alias("rank"))


def roc_points(pred: DataFrame, groups: Sequence[str], row_bound: int | None = None) -> DataFrame:
    """(groups..., p, fpr, tpr) at each distinct score."""
    c = score_curve(pred, groups, row_bound)
    return c.select(
        *groups,
        "p",
        F.try_divide(_c("cum_neg"), _c("total_neg")).alias("fpr"),
        F.try_divide(_c("cum_pos"), _c("total_pos")).alias("tpr"),
    )


def pr_points(pred: DataFrame, groups: Sequence[str], row_bound: int | None = None) -> DataFrame:
    """(groups..., p, recall, precision, prevalence) at each distinct score."""
    c = score_curve(pred, groups, row_bound)
    return c.select(
        *groups,
        "p",
        F.try_divide(_c("cum_pos"), _c("total_pos")).alias("recall"),
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        (F.col("total_pos") / (F.col("total_pos") + F.col("total_neg"))).alias("prevalence"),
    )


def best_youden_threshold(pred: DataFrame, groups: Sequence[str], row_bound: int | None = None) -> DataFrame:
    """(groups..., threshold, youden_j): the lowest of the scores with the largest J; 0.5 if J is undefined."""
    c = score_curve(pred, groups, row_bound)
    j = (
        F.try_divide(_c("cum_pos"), _c("total_pos"))
        + F.try_divide(_c("total_neg") - F.col("cum_neg"), _c("total_neg"))
        - 1
    )
    best = c.groupBy(*groups).agg(F.max(F.when(j.isNotNull(), F.struct(j.alias("j"), (-F.col("p")).alias("at")))).alias("_b"))
    return best.select(*groups, F.coalesce(-F.col("_b.at"), F.lit(0.5)).alias("threshold"), F.col("_b.j").alias("youden_j"))


def threshold_at_sensitivity(pred: DataFrame, groups: Sequence[str], target: float = 0.90, row_bound: int | None = None) -> DataFrame:
    """(groups..., threshold): the highest score whose sensitivity reaches the target, else the lowest score."""
    c = score_curve(pred, groups, row_bound)
    reached = F.try_divide(_c("cum_pos"), _c("total_pos")) >= F.lit(float(target))
    return c.groupBy(*groups).agg(F.coalesce(F.max(F.when(reached, F.col("p"))), F.min("p")).alias("threshold"))


def fixed_threshold_row(pred: DataFrame, groups: Sequence[str], threshold: float = 0.5, empty: float | None = None, row_bound: int | None = None) -> DataFrame:
    """accuracy, sensitivity, specificity, roc_auc, pr_auc; ``empty`` replaces a rate without a denominator."""
    s = summary(pred, groups, threshold, row_bound)
    rate = (lambda c: F.coalesce(F.col(c), F.lit(float(empty)))) if empty is not None else F.col
    return s.select(
        *groups, "accuracy", rate("sensitivity").alias("sensitivity"), rate("specificity").alias("specificity"), "roc_auc", "pr_auc"
    )


# ---------------------------------------------------------------- across folds


def aggregate(per_fold: DataFrame, by: Sequence[str], metrics: Sequence[str] = tuple(ALL_METRICS)) -> DataFrame:
    """(by..., metric, mean, sd, n_folds, min, max); undefined folds skipped, sd is 0 for a single value."""
    cells = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double")).alias("value")) for m in metrics]
    )
    return per_fold.select(*by, F.inline(cells)).groupBy(*by, "metric").agg(
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"),
        F.count("value").alias("n_folds"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


# ---------------------------------------------------------------- bootstrap

THRESHOLD_METRICS = ["sensitivity", "specificity", "ppv", "npv", "accuracy", "balanced_accuracy", "f1", "mcc", "kappa", "youden_j"]
BOOTSTRAP_METRICS = [*THRESHOLD_METRICS, "roc_auc", "pr_auc", "brier", "ece"]
ROWS_PER_DRAW = 200_000  # rows of a range whose replicates one task draws
_REPLICATES_PER_BLOCK = 250
_CELLS_AT_ONCE = 1_000_000  # weights that a task holds at a time
_SUMS = ["n", "n_pos", "tn", "fp", "fn", "tp"]


def replicate_sums(p, w_pos, w_neg, above_pos, above_neg, threshold: float, n_bins: int = N_BINS):
    """What a range of falling distinct scores ``p`` adds to the metrics of each replicate: one running-sum pass for all.

    ``w_pos`` and ``w_neg`` are (replicate, score) weights, ``above_*`` the weights above the range. Returns a matrix with a
    column per count of ``_SUMS``, then the squared error, ranked pairs, precision sum and a calibration gap per bin.
    """
    import numpy as np

    cum_pos = above_pos[:, None] + np.cumsum(w_pos, axis=1)
    cum_all = cum_pos + above_neg[:, None] + np.cumsum(w_neg, axis=1)
    hit = p >= threshold
    clipped = np.clip(p, 0.0, 1.0)
    bins = np.searchsorted([i * (1.0 / n_bins) for i in range(1, n_bins)], clipped, side="left")
    gaps = w_pos - clipped * (w_pos + w_neg)
    pos, neg = w_pos.sum(axis=1), w_neg.sum(axis=1)
    tp, fp = w_pos[:, hit].sum(axis=1), w_neg[:, hit].sum(axis=1)
    sums = [pos + neg, pos, neg - fp, fp, pos - tp, tp, w_pos @ (p - 1) ** 2 + w_neg @ p**2]
    sums.append((w_neg * (cum_pos - w_pos / 2.0)).sum(axis=1))
    sums.append((w_pos * (cum_pos / np.maximum(cum_all, 1))).sum(axis=1))
    sums += [gaps[:, bins == b].sum(axis=1) for b in range(n_bins)]
    return np.column_stack(sums).astype("float64")


def _multinomial(rng, totals, counts):
    """(replicate, cell) counts of ``totals`` draws each, by cells in proportion to ``counts``; empty cells get none."""
    import numpy as np

    out = np.zeros((len(totals), len(counts)), "int64")
    some = np.flatnonzero(counts)
    if len(some):
        out[:, some] = rng.multinomial(totals, counts[some] / counts[some].sum())
    return out


def bootstrap_replicates(
    pred: DataFrame,
    groups: Sequence[str],
    threshold: float = 0.5,
    n_boot: int = 2000,
    seed: int = 20260830,
    curves: bool = True,
    row_bound: int | None = None,
    rows_per_draw: int = ROWS_PER_DRAW,
) -> DataFrame:
    """(groups..., replicate, every metric of ``BOOTSTRAP_METRICS``) of rows drawn with replacement; replicates of one class are left out.

    Drawing n of n rows gives the distinct scores multinomial weights. They are drawn in two steps of the same distribution:
    first the positives and negatives that fall in each range of scores (one small table a group), then, range by range and
    in parallel, the weights inside. What lies above a range is known from the first step, so each range needs one pass
    whatever its place. Rows collapse to distinct scores before anything is drawn; without ``curves`` to the two sides of
    the threshold (ROC-AUC, average precision, Brier score and calibration error then mean nothing and are left out).
    """
    groups = list(groups)
    t = float(threshold)
    if curves:
        cuts = O.fit_cuts(pred, groups, "p", row_bound, rows_per_draw)
        cells = O.with_range(distinct_scores(pred, groups), groups, "p", cuts)
    else:
        side = checked(pred).withColumn("p", F.when(F.col("p") >= t, 1.0).otherwise(0.0))
        cells, t = O.with_range(distinct_scores(side, groups), groups, "p", None), 0.5
    cells = stored(cells.select(*groups, "_range", "p", "pos", "neg"), "bootstrap-cells")
    keyed = [cells.schema[g] for g in groups]

    def tagged(df: DataFrame, *more: str) -> DataFrame:
        return df.withColumn("_seed", F.xxhash64(F.lit(seed), *groups, *more))

    # One row per (group, range); a group has at most MAX_CUTS + 1 ranges.
    per_range = cells.groupBy(*groups, "_range").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    blocks = F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // _REPLICATES_PER_BLOCK)))
    per_block = tagged(per_range.withColumn("_block", blocks), F.lit("ranges"), "_block")

    def draw_ranges(key, rows):
        import numpy as np
        import pandas as pd

        rows = rows.sort_values("_range", ascending=False)
        first = int(rows["_block"].iloc[0]) * _REPLICATES_PER_BLOCK
        size = min(_REPLICATES_PER_BLOCK, n_boot - first)
        rng = np.random.default_rng(int(rows["_seed"].iloc[0]) % 2**64)
        counts = np.concatenate([rows["pos"], rows["neg"]]).astype("int64")
        drawn = _multinomial(rng, np.full(size, counts.sum()), counts)
        pos, neg = drawn[:, : len(rows)], drawn[:, len(rows) :]
        columns = {"pos": pos, "neg": neg, "above_pos": np.cumsum(pos, axis=1) - pos, "above_neg": np.cumsum(neg, axis=1) - neg}
        out = pd.DataFrame({c: list(np.ascontiguousarray(m.T)) for c, m in columns.items()})
        for name, value in zip(groups, key):
            out[name] = value
        return out.assign(_range=rows["_range"].to_numpy(), _first=first)

    arrays = "pos array<bigint>, neg array<bigint>, above_pos array<bigint>, above_neg array<bigint>"
    totals_type = T.StructType([*keyed, *T.StructType.fromDDL(f"_range int, _first int, {arrays}").fields])
    totals = per_block.groupBy(*groups, "_block").applyInPandas(draw_ranges, totals_type)
    names = ["_sq", "_roc", "_pr", *[f"_gap{b}" for b in range(N_BINS)]]

    def draw_scores(key, rows, plan):
        import numpy as np
        import pandas as pd

        if not len(rows):
            return pd.DataFrame({f.name: [] for f in sums_type.fields})
        rows = rows.sort_values("p", ascending=False)
        p = rows["p"].to_numpy("float64")
        counts = {c: rows[c].to_numpy("int64") for c in ("pos", "neg")}
        plan = plan.sort_values("_first")
        drawn = {c: np.concatenate(list(plan[c])) for c in ("pos", "neg", "above_pos", "above_neg")}
        rng = np.random.default_rng(int(rows["_seed"].iloc[0]) % 2**64)
        at_once = max(1, _CELLS_AT_ONCE // len(p))
        parts = []
        for i in range(0, n_boot, at_once):
            part = {c: v[i : i + at_once] for c, v in drawn.items()}
            w = [_multinomial(rng, part[c], counts[c]) for c in ("pos", "neg")]
            parts.append(replicate_sums(p, *w, part["above_pos"], part["above_neg"], t))
        out = pd.DataFrame(np.concatenate(parts), columns=_SUMS + names)
        out[_SUMS] = out[_SUMS].astype("int64")
        for name, value in zip(groups, key):
            out[name] = value
        return out.assign(replicate=np.arange(n_boot, dtype="int32"))

    fields = [f"{c} bigint" for c in _SUMS] + [f"{c} double" for c in names]
    sums_type = T.StructType([*keyed, *T.StructType.fromDDL("replicate int, " + ", ".join(fields)).fields])
    by_range = tagged(cells, F.lit("scores"), "_range").groupBy(*groups, "_range")
    parts = by_range.cogroup(totals.groupBy(*groups, "_range")).applyInPandas(draw_scores, sums_type)
    sums = parts.groupBy(*groups, "replicate").agg(*[F.sum(c).alias(c) for c in _SUMS + names])
    two = _finished(sums.where("tp + fn > 0 and tn + fp > 0"))
    return two.select(*groups, "replicate", *(BOOTSTRAP_METRICS if curves else THRESHOLD_METRICS))


def bootstrap_cis(
    pred: DataFrame,
    groups: Sequence[str],
    metrics: Sequence[str] = tuple(BOOTSTRAP_METRICS),
    threshold: float = 0.5,
    n_boot: int = 2000,
    alpha: float = 0.05,
    seed: int = 20260830,
    row_bound: int | None = None,
    rows_per_draw: int = ROWS_PER_DRAW,
) -> DataFrame:
    """(groups..., metric, n_boot_used, ci_low, ci_high): percentile intervals of several metrics from the same replicates.

    Replicates with one class are skipped; where a metric is undefined in a replicate, that replicate gives it no value.
    """
    unknown = [m for m in metrics if m not in BOOTSTRAP_METRICS]
    if unknown or not metrics:
        raise ValueError(f"bootstrap covers {BOOTSTRAP_METRICS}, not {unknown}")
    curves = any(m not in THRESHOLD_METRICS for m in metrics)
    reps = bootstrap_replicates(pred, groups, threshold, n_boot, seed, curves, row_bound, rows_per_draw)
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    return reps.select(*groups, F.inline(cells)).groupBy(*groups, "metric").agg(
        F.count("*").alias("n_boot_used"),
        F.percentile("value", alpha / 2).alias("ci_low"),
        F.percentile("value", 1 - alpha / 2).alias("ci_high"),
    )


def bootstrap_ci(
    pred: DataFrame,
    groups: Sequence[str],
    metric: str = "sensitivity",
    threshold: float = 0.5,
    n_boot: int = 2000,
    alpha: float = 0.05,
    seed: int = 20260830,
    row_bound: int | None = None,
) -> DataFrame:
    """(groups..., n_boot_used, ci_low, ci_high): percentile interval of one metric."""
    return bootstrap_cis(pred, groups, [metric], threshold, n_boot, alpha, seed, row_bound).drop("metric")
