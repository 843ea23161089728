"""Registry of queries and the SQL text of the shared views."""

from __future__ import annotations

import textwrap
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..schema import BASE_SEED, FEATURES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SUBJECTS = """
keyed AS (
  SELECT o_orderkey AS record_id, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS cents,
         o_orderkey - CASE WHEN o_orderkey % 40 = 1 THEN 1 ELSE 0 END AS s
  FROM orders),
measured AS (
  SELECT record_id, cents,
         CAST(10950 + (s*s*31 + s*7919) % 13000 AS INTEGER) AS age,
         CASE WHEN (s*17+3) % 100 < 35 THEN 1 ELSE 2 END AS gender,
         CASE WHEN s % 97 = 0 THEN 75 WHEN s % 89 = 0 THEN NULL ELSE 145 + (s*s*13 + s*131) % 50 END::DOUBLE AS height,
         CASE WHEN s % 101 = 0 THEN NULL ELSE 45 + (s*s*7 + s*53) % 85 END::DOUBLE AS weight,
         CASE WHEN s % 61 = 0 THEN 90 WHEN s % 103 = 0 THEN NULL ELSE 95 + (s*s*3 + s*211) % 100 END::DOUBLE AS ap_hi,
         CASE WHEN s % 61 = 0 THEN 110 WHEN s % 107 = 0 THEN NULL ELSE 55 + (s*s*5 + s*97) % 60 END::DOUBLE AS ap_lo,
         CASE WHEN (s*37) % 100 < 75 THEN 1 WHEN (s*37) % 100 < 93 THEN 2 ELSE 3 END AS cholesterol,
         CASE WHEN (s*41) % 100 < 85 THEN 1 WHEN (s*41) % 100 < 95 THEN 2 ELSE 3 END AS gluc,
         CASE WHEN (s*29) % 10 < 1 THEN 1 ELSE 0 END AS smoke,
         CASE WHEN (s*43) % 100 < 7 THEN 1 ELSE 0 END AS alco,
         CASE WHEN (s*47) % 10 < 8 THEN 1 ELSE 0 END AS active
  FROM keyed),
subjects AS (
  SELECT *, CASE WHEN 2*(COALESCE(ap_hi,120)-140) + (age-17500)/180.0 + 15*(cholesterol-1)
                      + (cents % 121 - 60) > 0 THEN 1 ELSE 0 END AS cardio
  FROM measured)"""

CLINICAL = """
ranged AS (
  SELECT * REPLACE (
    CASE WHEN height BETWEEN 100 AND 250 THEN height END AS height,
    CASE WHEN weight BETWEEN 20 AND 300 THEN weight END AS weight,
    CASE WHEN ap_hi BETWEEN 60 AND 250 THEN ap_hi END AS ap_hi,
    CASE WHEN ap_lo BETWEEN 30 AND 150 THEN ap_lo END AS ap_lo)
  FROM subjects),
cleaned AS (
  SELECT * REPLACE (
    CASE WHEN COALESCE(ap_hi < ap_lo, FALSE) THEN NULL ELSE ap_hi END AS ap_hi,
    CASE WHEN COALESCE(ap_hi < ap_lo, FALSE) THEN NULL ELSE ap_lo END AS ap_lo)
  FROM ranged),
derived AS (
  SELECT *, age / 365.25::DOUBLE AS age_years, weight / ((height/100.0::DOUBLE) * (height/100.0::DOUBLE)) AS bmi_raw,
         ap_hi - ap_lo AS pulse_pressure, ap_lo + (ap_hi - ap_lo)/3.0::DOUBLE AS map
  FROM cleaned),
bounded AS (SELECT * EXCLUDE (bmi_raw), CASE WHEN bmi_raw BETWEEN 10 AND 80 THEN bmi_raw END AS bmi FROM derived),
clinical AS (
  SELECT *,
    CASE WHEN bmi < 18.5 THEN 'underweight' WHEN bmi < 25 THEN 'normal' WHEN bmi < 30 THEN 'overweight'
         WHEN bmi >= 30 THEN 'obese' END AS bmi_class,
    CASE WHEN ap_hi < 120 THEN 'normal' WHEN ap_hi < 130 THEN 'elevated' WHEN ap_hi < 140 THEN 'stage1'
         WHEN ap_hi < 180 THEN 'stage2' WHEN ap_hi >= 180 THEN 'crisis' END AS bp_group,
    CASE WHEN age_years < 40 THEN 'young' WHEN age_years < 50 THEN 'middle' WHEN age_years < 60 THEN 'older'
         WHEN age_years < 70 THEN 'senior' WHEN age_years >= 70 THEN 'elderly' END AS age_group
  FROM bounded)"""

SCORES = """
scores AS (
  SELECT record_id, cardio,
         LEAST(100, GREATEST(0, 20 + cents % 41 + 30*cardio)) / 100.0::DOUBLE AS p_a,
         LEAST(100, GREATEST(0, 15 + (cents*7) % 61 + 20*cardio)) / 100.0::DOUBLE AS p_b
  FROM subjects)"""


def folds_sql(k: int = 5, repeats: int = 5) -> str:
    return f"""
folds AS (
  SELECT record_id, cardio, rep, CAST(ntile({k}) OVER (PARTITION BY rep, cardio ORDER BY h, record_id) - 1 AS INTEGER) AS fold
  FROM (SELECT record_id, cardio, CAST(r AS INTEGER) AS rep,
               substr(sha256(concat_ws('|', '{BASE_SEED}', 'split', '{k}', CAST(r AS VARCHAR), CAST(record_id AS VARCHAR))), 1, 16) AS h
        FROM subjects CROSS JOIN range({repeats}) t(r)))"""


FOLDS = folds_sql()

FOLD_META = """
fold_meta AS (
  SELECT rep, fold, CAST(n AS BIGINT) AS n_test, CAST(SUM(n) OVER (PARTITION BY rep) - n AS BIGINT) AS n_train,
         pos / n::DOUBLE AS test_prevalence,
         (SUM(pos) OVER (PARTITION BY rep) - pos)::DOUBLE / (SUM(n) OVER (PARTITION BY rep) - n) AS train_prevalence
  FROM (SELECT rep, fold, COUNT(*) AS n, SUM(cardio)::DOUBLE AS pos FROM folds GROUP BY rep, fold))"""

PREDICTIONS = """
predictions AS (
  SELECT 'logreg' AS model, rep, fold, record_id, f.cardio AS y, p_a AS p FROM folds f JOIN scores USING (record_id)
  UNION ALL
  SELECT 'mlp', rep, fold, record_id, f.cardio, p_b FROM folds f JOIN scores USING (record_id)
  UNION ALL
  SELECT 'control_c', rep, fold, record_id, f.cardio, train_prevalence FROM folds f JOIN fold_meta USING (rep, fold))"""

EDGES = [i * 0.1 for i in range(1, 10)]


def summary_sql(src: str, groups: str, threshold: str = "0.5", name: str = "summary") -> str:
    """Row-level definition of the metric set, independent of the plan that Spark runs."""
    bin_of = " + ".join(f"(p > {e!r}::DOUBLE)::INT" for e in EDGES)
    return f"""
{name}_rows AS (
  SELECT *, CASE WHEN p >= {threshold} THEN 1 ELSE 0 END AS yhat,
         RANK() OVER (PARTITION BY {groups} ORDER BY p) + (COUNT(*) OVER (PARTITION BY {groups}, p) - 1) / 2.0 AS rk,
         SUM(y) OVER (PARTITION BY {groups} ORDER BY p DESC)::DOUBLE / COUNT(*) OVER (PARTITION BY {groups} ORDER BY p DESC) AS prec,
         {bin_of} AS bin
  FROM {src}),
{name}_ece AS (
  SELECT {groups}, SUM(gap) / SUM(m) AS ece FROM (
    SELECT {groups}, bin, COUNT(*) AS m, COUNT(*) * ABS(AVG(y) - AVG(LEAST(1, GREATEST(0, p)))) AS gap
    FROM {name}_rows GROUP BY {groups}, bin) GROUP BY {groups}),
{name}_base AS (
  SELECT {groups}, COUNT(*)::DOUBLE AS n, SUM(y)::DOUBLE AS n_pos,
         SUM((y=0 AND yhat=0)::INT)::DOUBLE AS tn, SUM((y=0 AND yhat=1)::INT)::DOUBLE AS fp,
         SUM((y=1 AND yhat=0)::INT)::DOUBLE AS fn, SUM((y=1 AND yhat=1)::INT)::DOUBLE AS tp,
         AVG((p-y)*(p-y)) AS brier,
         (SUM(rk) FILTER (y=1) - SUM(y) * (SUM(y)+1) / 2.0) / NULLIF(SUM(y)::DOUBLE * (COUNT(*) - SUM(y)), 0) AS roc_auc,
         SUM(prec) FILTER (y=1) / NULLIF(SUM(y), 0) AS pr_auc
  FROM {name}_rows GROUP BY {groups}),
{name}_rates AS (
  SELECT *, tp/NULLIF(tp+fn,0) AS sensitivity, tn/NULLIF(tn+fp,0) AS specificity, tp/NULLIF(tp+fp,0) AS ppv,
         tn/NULLIF(tn+fn,0) AS npv, (tp+tn)/n AS accuracy
  FROM {name}_base JOIN {name}_ece USING ({groups})),
{name} AS (
  SELECT *, (sensitivity+specificity)/2 AS balanced_accuracy, sensitivity+specificity-1 AS youden_j,
         CASE WHEN ppv+sensitivity > 1e-12 THEN 2*ppv*sensitivity/(ppv+sensitivity) ELSE 0 END AS f1,
         CASE WHEN (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn) > 0
              THEN (tp*tn-fp*fn)/SQRT((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)) ELSE 0 END AS mcc,
         CASE WHEN ABS(1-(((tp+fp)*(tp+fn)+(tn+fn)*(tn+fp))/(n*n))) > 1e-12
              THEN (accuracy-((tp+fp)*(tp+fn)+(tn+fn)*(tn+fp))/(n*n))/(1-((tp+fp)*(tp+fn)+(tn+fn)*(tn+fp))/(n*n)) ELSE 0 END AS kappa
  FROM {name}_rates)"""


METRICS = [
    "sensitivity", "specificity", "ppv", "npv", "pr_auc", "roc_auc", "balanced_accuracy",
    "f1", "mcc", "kappa", "brier", "ece", "accuracy",
]

PARAMS_SQL = "CASE model WHEN 'logreg' THEN 9 WHEN 'mlp' THEN 849 ELSE 1 END"
CONFIG_JSON = '{{"feature_set":"compact","folds":{k},"repeats":{r},"seed":' + str(BASE_SEED) + ',"source":"orders"}}'


def ledger_sql(k: int = 5, r: int = 5) -> str:
    return (
        FOLD_META + "," + PREDICTIONS + "," + summary_sql("predictions", "model, rep, fold") + f""",
ledger AS (
  SELECT s.*, 0.5::DOUBLE AS threshold, (SELECT COUNT(*) FROM orders) - CAST(n AS BIGINT) AS n_train,
         CAST({PARAMS_SQL} AS BIGINT) AS n_trainable_params, '{CONFIG_JSON.format(k=k, r=r)}' AS config_json,
         round(((SELECT COUNT(*) FROM orders) - n)/100000.0::DOUBLE + rep*0.01::DOUBLE + fold*0.001::DOUBLE, 6) AS fit_seconds
  FROM summary s)"""
    )


def rounded(name: str, expr: str | None = None) -> str:
    """SQL twin of ``functions.numbers.shown``."""
    return f"round({expr or name}, {9 if name in ('brier', 'ece') else 6}) AS {name}"


def ctes(*parts: str) -> str:
    return "WITH " + ",".join(p.strip("\n") for p in parts) + "\n"


FEATURE_LIST = ", ".join(FEATURES)


def register(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL where it has one."""

    def wrap(fn):
        if name in QUERIES:
            raise KeyError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = textwrap.dedent(sql).strip()
        return fn

    return wrap
