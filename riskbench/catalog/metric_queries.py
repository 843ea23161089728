"""Queries: metrics, curves, thresholds, calibration, subgroups."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions.clinical import age_group_or_unknown
from ..functions.numbers import r6, r9, shown
from ..operators import ledger as L, metrics as M, subgroups as G
from ..session import stored
from ..sources import driver_tables as D
from .base import CLINICAL, EDGES, FOLD_META, FOLDS, METRICS, PREDICTIONS, SCORES, SUBJECTS, ctes, register, rounded, summary_sql

LONG = """
long_scores AS (SELECT 'logreg' AS model, record_id, cardio AS y, p_a AS p FROM scores
                UNION ALL SELECT 'mlp', record_id, cardio, p_b FROM scores)"""
SC = ctes(SUBJECTS, SCORES, LONG)
PRED = ctes(SUBJECTS, SCORES, FOLDS, FOLD_META, PREDICTIONS)
SUMMARY = ctes(SUBJECTS, SCORES, FOLDS, FOLD_META, PREDICTIONS, summary_sql("predictions", "model, rep, fold"))
SUMMARY_ALL = ctes(SUBJECTS, SCORES, LONG, summary_sql("long_scores", "model"))


def long_scores(spark, sf_dir):
    """(model, record_id, y, p) for the two scored models."""
    return D.scores(spark, sf_dir).select(
        S.ID,
        F.col("cardio").alias("y"),
        F.inline(
            F.array(
                F.struct(F.lit("logreg").alias("model"), F.col("p_a").alias("p")),
                F.struct(F.lit("mlp").alias("model"), F.col("p_b").alias("p")),
            )
        ),
    )


@register("metric_label_check", SC + "SELECT COUNT(*) AS n, COUNT(*) FILTER (y IS NULL OR y NOT IN (0,1)) AS bad_labels FROM long_scores")
def metric_label_check(spark, sf_dir):
    return M.label_violations(long_scores(spark, sf_dir))


@register(
    "metric_confusion",
    PRED + """SELECT model, rep, fold, CAST(COUNT(*) FILTER (y=0 AND p<0.5) AS BIGINT) AS tn, COUNT(*) FILTER (y=0 AND p>=0.5) AS fp,
                     COUNT(*) FILTER (y=1 AND p<0.5) AS fn, COUNT(*) FILTER (y=1 AND p>=0.5) AS tp FROM predictions GROUP BY ALL""",
)
def metric_confusion(spark, sf_dir):
    return M.confusion(D.predictions(spark, sf_dir), L.FOLD_KEYS)


_RATES = ["sensitivity", "specificity", "ppv", "npv", "accuracy", "balanced_accuracy", "f1", "mcc", "kappa", "youden_j"]
for _rate in _RATES:

    def _rate_query(spark, sf_dir, rate=_rate):
        c = M.confusion(D.predictions(spark, sf_dir), L.FOLD_KEYS)
        return M.with_rates(c, [rate]).select(*L.FOLD_KEYS, r6(F.col(rate)).alias(rate))

    register(f"metric_{_rate}", SUMMARY + f"SELECT model, rep, fold, round({_rate}, 6) AS {_rate} FROM summary")(_rate_query)


@register(
    "metric_summary",
    SUMMARY + "SELECT model, rep, fold, " + ", ".join(rounded(m) for m in [*METRICS, "youden_j"])
    + ", 0.5::DOUBLE AS threshold, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("n", "n_pos", "tn", "fp", "fn", "tp")) + " FROM summary",
)
def metric_summary(spark, sf_dir):
    s = M.summary(D.predictions(spark, sf_dir), L.FOLD_KEYS, 0.5, D.row_bound(spark, sf_dir))
    return s.withColumns({m: shown(m) for m in [*METRICS, "youden_j"]})


@register(
    "metric_average_rank",
    SC + """SELECT model, p, COUNT(*) AS n, round(AVG(rk), 6) AS rank FROM (
              SELECT model, p, AVG(pos) OVER (PARTITION BY model, p) AS rk FROM (
                SELECT model, p, ROW_NUMBER() OVER (PARTITION BY model ORDER BY p) AS pos FROM long_scores)) GROUP BY model, p""",
)
def metric_average_rank(spark, sf_dir):
    r = M.average_rank(long_scores(spark, sf_dir), ["model"], "p", D.row_bound(spark, sf_dir))
    return r.withColumn("rank", r6(F.col("rank")))


@register(
    "metric_roc_auc",
    SUMMARY_ALL + "SELECT model, CAST(n AS BIGINT) AS n, CAST(n_pos AS BIGINT) AS n_pos, round(roc_auc, 6) AS roc_auc FROM summary",
)
def metric_roc_auc(spark, sf_dir):
    r = M.roc_auc(long_scores(spark, sf_dir), ["model"], D.row_bound(spark, sf_dir))
    return r.withColumn("roc_auc", r6(F.col("roc_auc")))


@register("metric_pr_auc", SUMMARY_ALL + "SELECT model, CAST(n_pos AS BIGINT) AS n_pos, round(pr_auc, 6) AS pr_auc FROM summary")
def metric_pr_auc(spark, sf_dir):
    r = M.average_precision(long_scores(spark, sf_dir), ["model"], D.row_bound(spark, sf_dir))
    return r.withColumn("pr_auc", r6(F.col("pr_auc")))


@register("metric_brier", SC + "SELECT model, round(AVG((p-y)*(p-y)), 9) AS brier FROM long_scores GROUP BY model")
def metric_brier(spark, sf_dir):
    return M.brier(long_scores(spark, sf_dir), ["model"]).withColumn("brier", r9(F.col("brier")))


@register("metric_ece", SUMMARY_ALL + "SELECT model, round(ece, 9) AS ece FROM summary")
def metric_ece(spark, sf_dir):
    return M.ece(long_scores(spark, sf_dir), ["model"]).withColumn("ece", r9(F.col("ece")))


_BIN = " + ".join(f"(p > {e!r}::DOUBLE)::INT" for e in EDGES)


@register(
    "metric_calibration_table",
    SC + f"SELECT model, {_BIN} AS bin, COUNT(*) AS n, round(AVG(p), 6) AS predicted, round(AVG(y), 6) AS observed FROM long_scores GROUP BY 1, 2",
)
def metric_calibration_table(spark, sf_dir):
    t = M.calibration_table(long_scores(spark, sf_dir), ["model"])
    return t.withColumns({c: r6(F.col(c)) for c in ("predicted", "observed")})


CURVE_SQL = """
    , d AS (SELECT model, p, SUM(y)::DOUBLE AS pos, COUNT(*) - SUM(y) AS neg FROM long_scores GROUP BY model, p)
    , c AS (SELECT model, p, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER (PARTITION BY model) AS tpos,
                   SUM(neg) OVER (PARTITION BY model) AS tneg FROM d WINDOW w AS (PARTITION BY model ORDER BY p DESC))"""


@register("metric_roc_points", SC + CURVE_SQL + "SELECT model, p, round(fp/tneg, 6) AS fpr, round(tp/tpos, 6) AS tpr FROM c")
def metric_roc_points(spark, sf_dir):
    t = M.roc_points(long_scores(spark, sf_dir), ["model"], D.row_bound(spark, sf_dir))
    return t.withColumns({c: r6(F.col(c)) for c in ("fpr", "tpr")})


@register(
    "metric_pr_points",
    SC + CURVE_SQL + "SELECT model, p, round(tp/tpos, 6) AS recall, round(tp/(tp+fp), 6) AS precision, round(tpos/(tpos+tneg), 6) AS prevalence FROM c",
)
def metric_pr_points(spark, sf_dir):
    t = M.pr_points(long_scores(spark, sf_dir), ["model"], D.row_bound(spark, sf_dir))
    return t.withColumns({c: r6(F.col(c)) for c in ("recall", "precision", "prevalence")})


_FOLD_CURVE = """
    , d AS (SELECT model, rep, fold, p, SUM(y)::DOUBLE AS pos, COUNT(*) - SUM(y) AS neg FROM predictions GROUP BY ALL)
    , c AS (SELECT model, rep, fold, p, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER g AS tpos, SUM(neg) OVER g AS tneg
            FROM d WINDOW w AS (PARTITION BY model, rep, fold ORDER BY p DESC), g AS (PARTITION BY model, rep, fold))
    , j AS (SELECT *, tp/tpos + (tneg-fp)/tneg - 1 AS j FROM c)"""


@register(
    "metric_best_youden_threshold",
    PRED + _FOLD_CURVE + """
    SELECT model, rep, fold, round(p, 6) AS threshold, round(j, 6) AS youden_j FROM j
    QUALIFY ROW_NUMBER() OVER (PARTITION BY model, rep, fold ORDER BY j DESC, p) = 1""",
)
def metric_best_youden_threshold(spark, sf_dir):
    t = M.best_youden_threshold(D.predictions(spark, sf_dir), L.FOLD_KEYS, D.row_bound(spark, sf_dir))
    return t.withColumns({c: r6(F.col(c)) for c in ("threshold", "youden_j")})


@register(
    "metric_threshold_at_sensitivity",
    PRED + _FOLD_CURVE + """
    SELECT model, rep, fold, round(COALESCE(MAX(p) FILTER (tp/tpos >= 0.9), MIN(p)), 6) AS threshold FROM c GROUP BY model, rep, fold""",
)
def metric_threshold_at_sensitivity(spark, sf_dir):
    t = M.threshold_at_sensitivity(D.predictions(spark, sf_dir), L.FOLD_KEYS, 0.9, D.row_bound(spark, sf_dir))
    return t.withColumn("threshold", r6(F.col("threshold")))


@register(
    "metric_fixed_threshold_row",
    SUMMARY + """SELECT model, rep, fold, round(accuracy, 6) AS accuracy, round(COALESCE(sensitivity, 0), 6) AS sensitivity,
                 round(COALESCE(specificity, 0), 6) AS specificity, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc FROM summary""",
)
def metric_fixed_threshold_row(spark, sf_dir):
    t = M.fixed_threshold_row(D.predictions(spark, sf_dir), L.FOLD_KEYS, 0.5, 0.0, D.row_bound(spark, sf_dir))
    return t.select(*L.FOLD_KEYS, *[r6(F.col(c)).alias(c) for c in ("accuracy", "sensitivity", "specificity", "roc_auc", "pr_auc")])


@register(
    "metric_aggregate",
    SUMMARY + " UNION ALL ".join(
        f"""SELECT model, '{m}' AS metric, round(AVG({m}), 9) AS mean, round(COALESCE(stddev_samp({m}), 0), 9) AS sd, COUNT({m}) AS n_folds,
            round(MIN({m}), 9) AS "min", round(MAX({m}), 9) AS "max" FROM summary GROUP BY model"""
        for m in METRICS
    ),
)
def metric_aggregate(spark, sf_dir):
    s = M.summary(D.predictions(spark, sf_dir), L.FOLD_KEYS, 0.5, D.row_bound(spark, sf_dir))
    a = M.aggregate(s, ["model"])
    return a.withColumns({c: r9(F.col(c)) for c in ("mean", "sd", "min", "max")})


@register("metric_bootstrap_ci")
def metric_bootstrap_ci(spark, sf_dir):
    """Intervals of every covered metric, one set of 2,000 replicates a model."""
    return M.bootstrap_cis(long_scores(spark, sf_dir), ["model"], n_boot=2000, row_bound=D.row_bound(spark, sf_dir))


# ---------------------------------------------------------------- evaluation views


@register(
    "harness_threshold_on_train",
    PRED + """
    , d AS (SELECT model, rep, t.f AS fold, p, SUM(y)::DOUBLE AS pos, COUNT(*) - SUM(y) AS neg FROM predictions JOIN range(5) t(f) ON t.f <> fold GROUP BY ALL)
    , c AS (SELECT model, rep, fold, p, SUM(pos) OVER w / SUM(pos) OVER g + (SUM(neg) OVER g - SUM(neg) OVER w) / SUM(neg) OVER g - 1 AS j
            FROM d WINDOW w AS (PARTITION BY model, rep, fold ORDER BY p DESC), g AS (PARTITION BY model, rep, fold))
    , best AS (SELECT model, rep, CAST(fold AS INTEGER) AS fold, p AS threshold FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY model, rep, fold ORDER BY j DESC, p) = 1)
    SELECT model, rep, fold, round(threshold, 6) AS threshold, COUNT(*) FILTER (y=1 AND p>=threshold) AS tp, COUNT(*) FILTER (y=0 AND p>=threshold) AS fp
    FROM predictions JOIN best USING (model, rep, fold) WHERE model <> 'control_c' GROUP BY model, rep, fold, threshold""",
)
def harness_threshold_on_train(spark, sf_dir):
    from ..plans.harness import train_thresholds, with_threshold

    pred = stored(D.predictions(spark, sf_dir).where("model <> 'control_c'"), "predictions")
    t = train_thresholds(pred, 5, D.row_bound(spark, sf_dir))
    both = with_threshold(pred, t)
    c = M.confusion(both, [*L.FOLD_KEYS, "threshold"], F.col("threshold"))
    return c.select(*L.FOLD_KEYS, r6(F.col("threshold")).alias("threshold"), "tp", "fp")


@register(
    "harness_out_of_fold",
    PRED + """SELECT model, record_id, fold, y, round(p, 6) AS p FROM predictions
              QUALIFY ROW_NUMBER() OVER (PARTITION BY model, record_id ORDER BY rep DESC) = 1""",
)
def harness_out_of_fold(spark, sf_dir):
    return L.out_of_fold(D.predictions(spark, sf_dir)).select("model", S.ID, "fold", "y", r6(F.col("p")).alias("p"))


# ---------------------------------------------------------------- subgroups

SUBGROUP = ctes(SUBJECTS, CLINICAL, SCORES, """
sub_rows AS (
  SELECT 'ALL' AS "key", 'ALL' AS level, s.cardio AS y, p_a AS p FROM scores s
  UNION ALL SELECT 'gender', CAST(gender AS VARCHAR), s.cardio, p_a FROM scores s JOIN clinical USING (record_id)
  UNION ALL SELECT 'age_group', COALESCE(age_group, 'unknown'), s.cardio, p_a FROM scores s JOIN clinical USING (record_id))""",
    summary_sql("sub_rows", '"key", level'), """
subgroup_table AS (
  SELECT "key", level, CAST(n AS BIGINT) AS n, n_pos/n AS prevalence, ("key" = 'ALL' OR (n >= 30 AND n_pos > 0 AND n_pos < n)) AS reportable,
         CASE WHEN "key" = 'ALL' OR (n_pos > 0 AND n_pos < n) THEN sensitivity END AS sensitivity,
         CASE WHEN "key" = 'ALL' OR (n_pos > 0 AND n_pos < n) THEN specificity END AS specificity,
         CASE WHEN "key" = 'ALL' OR (n_pos > 0 AND n_pos < n) THEN ppv END AS ppv,
         CASE WHEN "key" = 'ALL' OR (n_pos > 0 AND n_pos < n) THEN pr_auc END AS pr_auc,
         CASE WHEN "key" = 'ALL' OR (n_pos > 0 AND n_pos < n) THEN roc_auc END AS roc_auc,
         CASE WHEN "key" = 'ALL' OR (n_pos > 0 AND n_pos < n) THEN brier END AS brier
  FROM summary)""")


def subgroup_table(spark, sf_dir):
    keys = D.subjects(spark, sf_dir).select(
        S.ID, F.col("gender").cast("string").alias("gender"), age_group_or_unknown(F.col("age")).alias("age_group")
    )
    pred = D.scores(spark, sf_dir).select(S.ID, F.col("cardio").alias("y"), F.col("p_a").alias("p")).join(keys, S.ID)
    return G.subgroup_table(pred, ["gender", "age_group"], row_bound=D.row_bound(spark, sf_dir))


_SUBM = ["prevalence", "sensitivity", "specificity", "ppv", "pr_auc", "roc_auc", "brier"]


@register(
    "subgroup_table",
    SUBGROUP + 'SELECT "key", level, n, reportable, ' + ", ".join(rounded(m) for m in _SUBM) + " FROM subgroup_table",
)
def subgroup_table_query(spark, sf_dir):
    return subgroup_table(spark, sf_dir).withColumns({m: shown(m) for m in _SUBM})


@register(
    "subgroup_worst",
    SUBGROUP + """SELECT "key", level, n, round(sensitivity, 6) AS sensitivity FROM subgroup_table WHERE "key" <> 'ALL' AND reportable AND sensitivity IS NOT NULL
                  ORDER BY subgroup_table.sensitivity, "key", level LIMIT 1""",
)
def subgroup_worst(spark, sf_dir):
    w = G.worst_subgroup(subgroup_table(spark, sf_dir), "sensitivity")
    return w.select("key", "level", "n", r6(F.col("sensitivity")).alias("sensitivity"))


@register(
    "subgroup_disparity",
    SUBGROUP + """SELECT "key", round(MAX(sensitivity) - MIN(sensitivity), 6) AS gap FROM subgroup_table WHERE "key" <> 'ALL' AND reportable
                  AND sensitivity IS NOT NULL GROUP BY "key" HAVING COUNT(*) >= 2""",
)
def subgroup_disparity(spark, sf_dir):
    return G.disparity(subgroup_table(spark, sf_dir), "sensitivity").withColumn("gap", r6(F.col("gap")))


@register(
    "subgroup_formatted",
    SUBGROUP + """SELECT "key", level || CASE WHEN reportable THEN '' ELSE '  (n too small)' END AS level, n, """
    + ", ".join(f"COALESCE(printf('%.3f', {m}), '-') AS {m}" for m in ("prevalence", "sensitivity", "specificity", "ppv", "pr_auc", "brier"))
    + " FROM subgroup_table",
)
def subgroup_formatted(spark, sf_dir):
    return G.format_table(subgroup_table(spark, sf_dir))
