"""The models that can be evaluated, as a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# One entry per model family.
ENTRIES = [
    {"model": "control_c", "needs_special": False, "input_kind": "features", "reports_params": True, "note": "fixed random projection with the shared head"},
    {"model": "logreg", "needs_special": False, "input_kind": "features", "reports_params": False, "note": "linear baseline, balanced class weights"},
    {"model": "mlp", "needs_special": False, "input_kind": "features", "reports_params": False, "note": "two hidden layers, 32 and 16"},
    {"model": "product_control", "needs_special": False, "input_kind": "features", "reports_params": True, "note": "chain products with the shared head"},
    {"model": "rf", "needs_special": False, "input_kind": "features", "reports_params": False, "note": "400 trees, balanced class weights"},
    {"model": "svm_rbf", "needs_special": False, "input_kind": "features", "reports_params": False, "note": "sampled landmarks, RBF kernel, logistic head"},
    {"model": "xgboost", "needs_special": False, "input_kind": "features", "reports_params": False, "note": "boosted trees of depth 3"},
]
# End of fixed values.
_SCHEMA = "model string, needs_special boolean, input_kind string, reports_params boolean, note string"


def names() -> list[str]:
    return sorted(e["model"] for e in ENTRIES)


def catalog(spark: SparkSession, include_special: bool = True) -> DataFrame:
    df = spark.createDataFrame([tuple(e.values()) for e in ENTRIES], _SCHEMA)
    return (df if include_special else df.where(~F.col("needs_special"))).orderBy("model")


def spec(name: str) -> dict:
    for e in ENTRIES:
        if e["model"] == name:
            return e
    raise KeyError(f"unknown model {name!r}; known: {names()}")
