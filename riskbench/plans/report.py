"""Report tables over the fold-level ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators import comparisons as T
from ..operators.metrics import HEADLINE

# Metric order of the main table, classical baselines, metrics where smaller is better.
MAIN_METRICS = [
    "sensitivity", "specificity", "ppv", "npv", "pr_auc", "roc_auc", "balanced_accuracy", "mcc", "brier", "ece", "accuracy",
]
CLASSICAL = ["logreg", "svm_rbf", "rf", "xgboost", "mlp"]
LOWER_IS_BETTER = ["brier", "ece", "fit_seconds"]
SUMMARY_METRICS = [
    "sensitivity", "specificity", "pr_auc", "roc_auc", "f1", "ppv", "npv", "balanced_accuracy", "accuracy", "mcc", "brier", "ece", "fit_seconds",
]
NEEDS_CONTROL = ["qkernel", "vqc", "hybrid", "quantum"]
# End of fixed values.


class ReportError(ValueError):
    """A table must not be shown as it is."""


def main_table(ledger: DataFrame, metrics: Sequence[str] = tuple(MAIN_METRICS), decimals: int = 3) -> DataFrame:
    """One row per model: ``mean +/- sd`` text and ``<metric>__mean``, parameters, folds. Sorted by model."""
    have = [m for m in metrics if m in ledger.columns]
    aggs = []
    for m in have:
        mean, sd = F.avg(m), F.stddev_samp(m)
        shown = F.when(mean.isNotNull(), F.format_string(f"%.{decimals}f", mean)).otherwise("nan")
        spread = F.when(sd.isNotNull(), F.format_string(f"%.{decimals}f", sd)).otherwise("nan")
        aggs += [F.concat(shown, F.lit(" +/- "), spread).alias(m), mean.alias(f"{m}__mean")]
    if "n_trainable_params" in ledger.columns:
        aggs.append(F.min("n_trainable_params").alias("params"))  # one value per model
    return ledger.groupBy("model").agg(*aggs, F.count("*").alias("folds")).orderBy("model")


def param_table(ledger: DataFrame) -> DataFrame:
    """(model, params, bytes_fp32, x_smaller_than_largest); models without a count are left out."""
    p = ledger.where(F.col("n_trainable_params").isNotNull()).groupBy("model").agg(F.min("n_trainable_params").alias("params"))
    largest = F.max("params").over(W.partitionBy())  # one row per model
    return p.select(
        "model",
        "params",
        (F.col("params") * 4).alias("bytes_fp32"),
        F.bround(F.try_divide(largest.cast("double"), F.col("params")), 1).alias("x_smaller_than_largest"),
    )


def attach_floor(table: DataFrame, audit_rows: DataFrame) -> DataFrame:
    """Add the audit's majority-class accuracy to each row of the main table; NULL if the audit has none."""
    floor = audit_rows.where("section = 'class_balance' and metric = 'majority_class_accuracy'").agg(F.max("value")).first()[0]
    return table.withColumn("majority_class_accuracy", F.lit(floor).cast("double"))


def refuse_if_incomplete(table: DataFrame) -> list[str]:
    """Raise ReportError unless the table has the headline metrics and a control beside the models that need one.

    Returns notes for the reader. Works on the table of models, one row each.
    """
    missing = [m for m in HEADLINE if not any(c.startswith(m) for c in table.columns)]
    if missing:
        raise ReportError(f"the main table lacks {missing}")
    name = F.col("model")
    special = F.lit(False)
    for part in NEEDS_CONTROL:
        special = special | name.contains(part)
    c = table.agg(F.max(special).alias("special"), F.max(name.contains("control")).alias("control")).first()
    if c["special"] and not c["control"]:
        raise ReportError("models that need a matched control are shown without one")
    if "majority_class_accuracy" not in table.columns:
        return ["no majority-class floor recorded; read accuracy against it"]
    return []


def to_markdown(table: DataFrame, drop_helpers: bool = True) -> str:
    """Markdown text of a report table. Report tables have one row per model, so they fit on the driver."""
    shown = table.drop(*[c for c in table.columns if c.endswith("__mean")]) if drop_helpers else table
    lines = ["| " + " | ".join(shown.columns) + " |", "|" + "---|" * len(shown.columns)]
    for row in shown.collect():
        lines.append("| " + " | ".join("-" if v is None else str(v) for v in row) + " |")
    return "\n".join(lines) + "\n"


def best_baseline(ledger: DataFrame, metric: str = "pr_auc", candidates: Sequence[str] = tuple(CLASSICAL)) -> DataFrame:
    """(model, mean) of the classical model with the largest mean; the earlier in the list wins a tie."""
    rank = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col("model"))
    means = ledger.where(F.col("model").isin(list(candidates))).groupBy("model").agg(F.avg(metric).alias("mean"))
    best = means.agg(F.max(F.struct("mean", (-rank).alias("r"), "model")).alias("b"))
    return best.select("b.model", "b.mean")


def compare_to_baseline(ledger: DataFrame, metric: str = "pr_auc", folds: int = 5, alpha: float = 0.05) -> DataFrame:
    """(model, baseline, k, delta, t, p_value, p_adjusted, rejected) of each model with as many folds as the baseline.

    Folds are paired by (rep, fold). n_test = max(1, round(n_train / (folds - 1))).
    """
    base = best_baseline(ledger, metric).first()
    if base is None:
        raise ReportError("no classical baseline in the ledger")
    ref = base["model"]
    counts = {r["model"]: r["count"] for r in ledger.groupBy("model").count().collect()}  # one row per model
    same = [m for m, n in counts.items() if m != ref and n == counts[ref]]
    n_train = ledger.agg(F.max("n_train").alias("n")).first()["n"]
    n_test = max(1, int(round(n_train / max(folds - 1, 1))))
    pairs = ledger.where(F.col("model").isin([*same, ref])).select("model", "rep", "fold", metric)
    diffs = T.paired_differences(pairs, ["rep", "fold"], "model", metric, ref).withColumn("diff", -F.col("diff"))
    tests = T.corrected_resampled_t(diffs, ["model"], F.lit(n_train), F.lit(n_test))
    return T.holm(tests.withColumn("baseline", F.lit(ref)), alpha=alpha, tie=["model"])


CONFIG_SCHEMA = "folds int, repeats int, source string, feature_set string, seed long"


def protocol_summary(ledger: DataFrame, folds: int = 5, repeats: int = 5) -> DataFrame:
    """One row per model over runs whose configuration says folds x repeats: means, sds, confusion per repeat."""
    cfg = F.from_json("config_json", CONFIG_SCHEMA, {"mode": "PERMISSIVE"})
    rows = ledger.withColumn("_cfg", cfg).where((F.col("_cfg.folds") == folds) & (F.col("_cfg.repeats") == repeats))
    have = [m for m in SUMMARY_METRICS if m in ledger.columns]
    reps = F.count_distinct("rep")
    return rows.groupBy("model").agg(
        F.count("*").alias("folds"),
        reps.alias("repeats"),
        F.min("_cfg.feature_set").alias("feature_set"),
        F.min("_cfg.source").alias("source"),
        *[F.avg(m).alias(f"{m}_mean") for m in have],
        *[F.when(F.count(m) > 0, F.coalesce(F.stddev_samp(m), F.lit(0.0))).alias(f"{m}_sd") for m in have],
        *[(F.sum(c) / reps).alias(c) for c in ("tn", "fp", "fn", "tp", "n")],
    )


def best_per_metric(ledger: DataFrame, metrics: Sequence[str] = tuple(SUMMARY_METRICS)) -> DataFrame:
    """(metric, best, models): the best mean of each metric and the models that reach it."""
    have = [m for m in metrics if m in ledger.columns]
    means = ledger.groupBy("model").agg(*[F.avg(m).alias(m) for m in have])
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in have])
    long = means.select("model", F.inline(cells)).where(F.col("value").isNotNull())
    signed = F.when(F.col("metric").isin(LOWER_IS_BETTER), -F.col("value")).otherwise(F.col("value"))
    top = F.max(signed).over(W.partitionBy("metric"))  # one row per model and metric
    hit = long.withColumns({"_s": signed, "_top": top}).where("_s = _top")
    return hit.groupBy("metric").agg(F.min("value").alias("best"), F.array_join(F.array_sort(F.collect_list("model")), ",").alias("models"))


def awaiting(catalog: DataFrame, ledger: DataFrame) -> DataFrame:
    """Catalog models without a ledger row."""
    return catalog.join(ledger.select("model").distinct(), "model", "left_anti")


def latest_per_model(ledger: DataFrame, order: Sequence[str] = ("run_no", "run_ts", "run_id", "rep", "fold")) -> DataFrame:
    """(model, runs, latest...): the row count and the last row per model in the given order; missing order columns are left out."""
    keys = [c for c in order if c in ledger.columns]
    rest = [c for c in ledger.columns if c not in ("model", *keys)]
    g = ledger.groupBy("model").agg(F.count("*").alias("runs"), F.max(F.struct(*keys, F.struct(*rest).alias("row"))).alias("_l"))
    return g.select("model", "runs", *[f"_l.{k}" for k in keys], "_l.row.*")


def reliability(ledger: DataFrame, model: str) -> DataFrame:
    """One row: mean sensitivity and specificity of a model, NULL if it is absent."""
    return ledger.where(F.col("model") == model).agg(F.avg("sensitivity").alias("sensitivity"), F.avg("specificity").alias("specificity"))


def size_versus_metric(ledger: DataFrame, metric: str = "pr_auc") -> DataFrame:
    """(model, params, <metric>): parameter count next to the mean metric."""
    g = ledger.groupBy("model").agg(F.min("n_trainable_params").alias("params"), F.avg(metric).alias(metric))
    return g.where(F.col("params").isNotNull())
