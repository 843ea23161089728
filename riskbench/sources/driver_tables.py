"""The clinical, score, fold and ledger tables that the registered queries derive from the given Parquet tables.

All arithmetic is on integers of ``orders``, so that Spark and SQL see the same rows. Products are reduced modulo their
divisor first and do not overflow for any key.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.numbers import clip
from ..operators import ledger as L, splits as P
from ..schema import BASE_SEED, ID
from ..session import stored

MODELS = ["control_c", "logreg", "mlp"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_bound(spark: SparkSession, sf_dir: str) -> int:
    """Rows of ``orders``, read from the Parquet footers."""
    return table(spark, sf_dir, "orders").count()


def _quad(s: Column, a: int, b: int, m: int) -> Column:
    u = s % m
    return (u * u * a + u * b) % m


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order in the canonical layout; every fortieth row repeats the features of its predecessor."""
    k = F.col("o_orderkey")
    src = table(spark, sf_dir, "orders").select(
        k.alias(ID),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
        (k - F.when(k % 40 == 1, 1).otherwise(0)).alias("s"),
    )
    s = F.col("s")

    def d(c: Column) -> Column:
        return c.cast("double")

    def flag(c: Column) -> Column:
        return c.cast("int")

    def level(share: Column, first: int, second: int) -> Column:
        return F.when(share < first, 1).when(share < second, 2).otherwise(3)

    out = src.select(
        ID,
        "cents",
        (10950 + _quad(s, 31, 7919, 13000)).cast("int").alias("age"),
        F.when((s * 17 + 3) % 100 < 35, 1).otherwise(2).alias("gender"),
        F.when(s % 97 == 0, F.lit(75.0)).when(s % 89 != 0, d(145 + _quad(s, 13, 131, 50))).alias("height"),
        F.when(s % 101 != 0, d(45 + _quad(s, 7, 53, 85))).alias("weight"),
        F.when(s % 61 == 0, F.lit(90.0)).when(s % 103 != 0, d(95 + _quad(s, 3, 211, 100))).alias("ap_hi"),
        F.when(s % 61 == 0, F.lit(110.0)).when(s % 107 != 0, d(55 + _quad(s, 5, 97, 60))).alias("ap_lo"),
        level((s * 37) % 100, 75, 93).alias("cholesterol"),
        level((s * 41) % 100, 85, 95).alias("gluc"),
        flag((s * 29) % 10 < 1).alias("smoke"),
        flag((s * 43) % 100 < 7).alias("alco"),
        flag((s * 47) % 10 < 8).alias("active"),
    )
    risk = (
        2 * (F.coalesce(F.col("ap_hi"), F.lit(120.0)) - 140)
        + (F.col("age") - 17500) / F.lit(180.0)
        + 15 * (F.col("cholesterol") - 1)
        + (F.col("cents") % 121 - 60)
    )
    return out.withColumn("cardio", (risk > 0).cast("int"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tied probabilities of two models per record."""
    df = subjects(spark, sf_dir)
    cents, y = F.col("cents"), F.col("cardio")
    return df.select(
        ID,
        "cardio",
        (clip(20 + cents % 41 + 30 * y, 0, 100) / F.lit(100.0)).alias("p_a"),
        (clip(15 + (cents * 7) % 61 + 20 * y, 0, 100) / F.lit(100.0)).alias("p_b"),
    )


def folds(spark: SparkSession, sf_dir: str, k: int = 5, repeats: int = 5) -> DataFrame:
    df = subjects(spark, sf_dir).select(ID, "cardio")
    return P.repeated_stratified_folds(df, "cardio", k, repeats, BASE_SEED)


def predictions(spark: SparkSession, sf_dir: str, k: int = 5, repeats: int = 5) -> DataFrame:
    """(model, rep, fold, record_id, y, p): two scored models and a constant-prevalence control."""
    joined = P.with_stratified_folds(scores(spark, sf_dir), "cardio", k, repeats, BASE_SEED)
    meta = P.fold_metadata(joined.select(ID, "cardio", "rep", "fold"), "cardio").select("rep", "fold", "train_prevalence")
    wide = joined.join(F.broadcast(meta), ["rep", "fold"])  # rep x fold rows
    return wide.select(
        ID,
        "rep",
        "fold",
        F.col("cardio").alias("y"),
        F.explode(
            F.create_map(
                F.lit("logreg"), F.col("p_a"), F.lit("mlp"), F.col("p_b"), F.lit("control_c"), F.col("train_prevalence")
            )
        ).alias("model", "p"),
    )


def ledger(spark: SparkSession, sf_dir: str, k: int = 5, repeats: int = 5) -> DataFrame:
    """Fold-level ledger of the three models at threshold 0.5."""
    pred = predictions(spark, sf_dir, k, repeats)
    n = row_bound(spark, sf_dir)
    params = {"logreg": 9, "mlp": 849, "control_c": 1}
    p_col = functools.reduce(
        lambda acc, kv: acc.when(F.col("model") == kv[0], kv[1]), params.items(), F.when(F.lit(False), 0)
    )
    rows = L.fold_ledger(
        pred,
        n_train=lambda rows: F.lit(n) - rows,
        n_params=p_col,
        fit_seconds=F.round(F.col("n_train") / 100000.0 + F.col("rep") * 0.01 + F.col("fold") * 0.001, 6),
        config={"folds": k, "repeats": repeats, "source": "orders", "feature_set": "compact", "seed": BASE_SEED},
        row_bound=n,
    )
    return stored(rows, "ledger-rows")  # one row per model, repeat and fold; reports read it as a file, several times
