"""Fold-level result rows: building, run headline, out-of-fold view."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from . import metrics as M

FOLD_KEYS = ["model", "rep", "fold"]


def config_json(config: dict) -> str:
    """Canonical JSON text, keys sorted."""
    return json.dumps(config, sort_keys=True, separators=(",", ":"), default=str)


def fold_ledger(
    pred: DataFrame,
    n_train: Callable[[Column], Column],
    n_params: Column,
    fit_seconds: Column,
    config: dict,
    threshold: float | str = 0.5,
    row_bound: int | None = None,
) -> DataFrame:
    """One row per (model, rep, fold): the metric set plus run facts and the configuration."""
    s = M.summary(pred, FOLD_KEYS, threshold, row_bound)
    return (
        s.withColumn("n_train", n_train(F.col("n")).cast("long"))
        .withColumn("n_trainable_params", n_params.cast("long"))
        .withColumn("fit_seconds", fit_seconds)
        .withColumn("config_json", F.lit(config_json(config)))
    )


def out_of_fold(pred: DataFrame, keys: Sequence[str] = ("model", "record_id")) -> DataFrame:
    """One prediction per model and record: the last repeat wins. A max over structs, combined before the shuffle."""
    rest = [c for c in pred.columns if c not in keys and c != "rep"]
    best = pred.groupBy(*keys).agg(F.max(F.struct("rep", *rest)).alias("_b"))
    return best.select(*keys, "_b.*")


def headline(ledger: DataFrame) -> DataFrame:
    """(model, headline): sensitivity and specificity as mean +/- sd, folds and parameters."""
    g = ledger.groupBy("model").agg(
        F.avg("sensitivity").alias("se"),
        F.coalesce(F.stddev_samp("sensitivity"), F.lit(0.0)).alias("se_sd"),
        F.avg("specificity").alias("sp"),
        F.coalesce(F.stddev_samp("specificity"), F.lit(0.0)).alias("sp_sd"),
        F.count("*").alias("folds"),
        F.max("n_trainable_params").alias("params"),
    )
    text = F.format_string(
        "%s: sensitivity %.3f +/- %.3f, specificity %.3f +/- %.3f  [%d folds%s]",
        "model", "se", "se_sd", "sp", "sp_sd", "folds",
        F.when(F.col("params") > 0, F.format_string(", %d params", "params")).otherwise(""),
    )
    return g.select("model", text.alias("headline"))
