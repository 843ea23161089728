"""Queries: ledger files, report tables, tests between models."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions.numbers import r6, r9, shown
from ..operators import audit as A, comparisons as T, ledger as L
from ..plans import model_catalog as MC, report as R
from ..session import new_path
from ..sources import driver_tables as D, ledger_files as LF, result_files as RF
from .base import FOLDS, METRICS, SCORES, SUBJECTS, ctes, ledger_sql, register, rounded

LED = ctes(SUBJECTS, SCORES, FOLDS, ledger_sql())
_COUNTS = ["n", "n_pos", "tn", "fp", "fn", "tp"]
_LED_COLS = (
    "model, rep, fold, " + ", ".join(rounded(m) for m in METRICS) + ", threshold, "
    + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in _COUNTS) + ", n_train, n_trainable_params, fit_seconds, config_json"
)


def _ledger_out(df):
    return df.select(
        "model", "rep", "fold", *[shown(m).alias(m) for m in METRICS], "threshold", *_COUNTS,
        "n_train", "n_trainable_params", "fit_seconds", "config_json",
    )


@register("ledger_append", LED + f"SELECT {_LED_COLS} FROM ledger")
def ledger_append(spark, sf_dir):
    """Two appends to one path, then a scan of the whole ledger."""
    path = new_path(spark, "ledger")
    led = D.ledger(spark, sf_dir)
    LF.append(led.where("model <> 'control_c'"), path)
    LF.append(led.where("model = 'control_c'"), path)
    return _ledger_out(LF.read(spark, path))


@register(
    "ledger_latest_of_two_runs",
    LED + """, r AS (SELECT 1 AS run_no, NULL AS note, * FROM ledger UNION ALL SELECT 2, 'again', * FROM ledger WHERE model = 'logreg' AND rep = 0)
             SELECT model, COUNT(*) OVER (PARTITION BY model) AS runs, CAST(run_no AS BIGINT) AS run_no, note, rep, fold, round(roc_auc, 6) AS roc_auc FROM r
             QUALIFY ROW_NUMBER() OVER (PARTITION BY model ORDER BY run_no DESC, rep DESC, fold DESC) = 1""",
)
def ledger_latest_of_two_runs(spark, sf_dir):
    """The second run has a column more; what is latest goes by the order of the runs."""
    path = new_path(spark, "ledger-runs")
    led = D.ledger(spark, sf_dir)
    LF.append(led, path)
    LF.append(led.where("model = 'logreg' AND rep = 0"), path, {"note": "again"})
    t = R.latest_per_model(LF.read(spark, path))
    return t.select("model", "runs", "run_no", "note", "rep", "fold", r6(F.col("roc_auc")).alias("roc_auc"))


@register("ledger_csv_scan", LED + f"SELECT {_LED_COLS} FROM ledger")
def ledger_csv_scan(spark, sf_dir):
    path = new_path(spark, "ledger-csv")
    LF.write_csv(D.ledger(spark, sf_dir), path)
    return _ledger_out(LF.read_csv(spark, path))


@register(
    "ledger_headline",
    LED + """SELECT model, printf('%s: sensitivity %.3f +/- %.3f, specificity %.3f +/- %.3f  [%d folds, %d params]', model, AVG(sensitivity),
        stddev_samp(sensitivity), AVG(specificity), stddev_samp(specificity), COUNT(*), MAX(n_trainable_params)) AS headline FROM ledger GROUP BY model""",
)
def ledger_headline(spark, sf_dir):
    return L.headline(D.ledger(spark, sf_dir))


@register(
    "report_main_table",
    LED + "SELECT model, " + ", ".join(
        f"printf('%.3f', AVG({m})) || ' +/- ' || printf('%.3f', stddev_samp({m})) AS {m}" for m in R.MAIN_METRICS if m != "npv"
    ) + ", COALESCE(printf('%.3f', AVG(npv)), 'nan') || ' +/- ' || COALESCE(printf('%.3f', stddev_samp(npv)), 'nan') AS npv, "
    + ", ".join(f"round(AVG({m}), 9) AS {m}__mean" for m in R.MAIN_METRICS) + ", MIN(n_trainable_params)::BIGINT AS params, COUNT(*) AS folds FROM ledger GROUP BY model",
)
def report_main_table(spark, sf_dir):
    t = R.main_table(D.ledger(spark, sf_dir))
    return t.withColumns({f"{m}__mean": r9(F.col(f"{m}__mean")) for m in R.MAIN_METRICS})


@register(
    "report_main_table_with_floor",
    LED + """SELECT model, printf('%.3f', AVG(accuracy)) AS accuracy, (SELECT round(GREATEST(AVG(cardio), 1-AVG(cardio)), 9) FROM subjects) AS majority_class_accuracy
             FROM ledger GROUP BY model""",
)
def report_main_table_with_floor(spark, sf_dir):
    """The audit is written as a file and its floor attached to the table, which then passes the gate."""
    path = new_path(spark, "audit")
    RF.write_audit(A.audit(D.subjects(spark, sf_dir), row_bound=D.row_bound(spark, sf_dir)), path)
    t = R.attach_floor(R.main_table(D.ledger(spark, sf_dir)), RF.read_audit(spark, path))
    R.refuse_if_incomplete(t)
    return t.select("model", F.split("accuracy", " ")[0].alias("accuracy"), r9(F.col("majority_class_accuracy")).alias("majority_class_accuracy"))


@register(
    "report_param_table",
    LED + """SELECT model, params, params*4 AS bytes_fp32, round_even(MAX(params) OVER () / params::DOUBLE, 1) AS x_smaller_than_largest
             FROM (SELECT model, MIN(n_trainable_params)::BIGINT AS params FROM ledger GROUP BY model)""",
)
def report_param_table(spark, sf_dir):
    return R.param_table(D.ledger(spark, sf_dir))


@register(
    "report_gate",
    LED + """SELECT COUNT(DISTINCT model) AS models, COUNT(DISTINCT model) FILTER (contains(model, 'control')) AS controls,
             COUNT(DISTINCT model) FILTER (contains(model, 'qkernel') OR contains(model, 'vqc') OR contains(model, 'hybrid') OR contains(model, 'quantum')) AS special,
             1 AS notes FROM ledger""",
)
def report_gate(spark, sf_dir):
    t = R.main_table(D.ledger(spark, sf_dir))
    notes = R.refuse_if_incomplete(t)
    special = F.col("model").rlike("qkernel|vqc|hybrid|quantum")
    return t.agg(
        F.count("*").alias("models"),
        F.count(F.when(F.col("model").contains("control"), 1)).alias("controls"),
        F.count(F.when(special, 1)).alias("special"),
    ).withColumn("notes", F.lit(len(notes)))


@register(
    "report_best_baseline",
    LED + """SELECT model, round(AVG(pr_auc), 6) AS mean FROM ledger WHERE model IN ('logreg','svm_rbf','rf','xgboost','mlp')
             GROUP BY model ORDER BY AVG(pr_auc) DESC LIMIT 1""",
)
def report_best_baseline(spark, sf_dir):
    return R.best_baseline(D.ledger(spark, sf_dir)).withColumn("mean", r6(F.col("mean")))


_P_EVEN = """
    (1 - (t_abs / sqrt(df + t_abs*t_abs)) * list_sum(list_transform(range(0, CAST(df/2 AS BIGINT)),
        lambda j: factorial(CAST(2*j AS INTEGER))::DOUBLE / (factorial(CAST(j AS INTEGER))::DOUBLE * factorial(CAST(j AS INTEGER))::DOUBLE * pow(4.0::DOUBLE, j))
             * pow(df / (df + t_abs*t_abs), j))))"""


@register(
    "report_paired_comparison",
    LED + f"""
    , base AS (SELECT model FROM ledger WHERE model IN ('logreg','mlp') GROUP BY model ORDER BY AVG(pr_auc) DESC LIMIT 1)
    , d AS (SELECT a.model, a.pr_auc - b.pr_auc AS diff FROM ledger a JOIN ledger b USING (rep, fold) WHERE b.model = (SELECT model FROM base) AND a.model <> b.model)
    , nt AS (SELECT MAX(n_train) AS n_train, GREATEST(1, round_even(MAX(n_train) / 4.0, 0)) AS n_test FROM ledger)
    , g AS (SELECT model, COUNT(*) AS k, AVG(diff) AS delta, AVG(diff) / sqrt(var_samp(diff) * (1.0::DOUBLE/COUNT(*) + MAX(n_test)::DOUBLE/MAX(n_train))) AS t FROM d, nt GROUP BY model)
    , p AS (SELECT *, ABS(t) AS t_abs, (k - 1)::DOUBLE AS df FROM g)
    , q AS (SELECT *, GREATEST(0, {_P_EVEN}) AS p_value FROM p)
    , h AS (SELECT *, LEAST(1, p_value * (COUNT(*) OVER () - ROW_NUMBER() OVER (ORDER BY p_value, model) + 1)) AS p_adjusted FROM q)
    SELECT model, (SELECT model FROM base) AS baseline, k, round(delta, 6) AS delta, round(t, 4) AS t, round(p_value, 6) AS p_value,
           round(p_adjusted, 6) AS p_adjusted, bool_and(p_adjusted < 0.05) OVER (ORDER BY p_value, model) AS rejected FROM h""",
)
def report_paired_comparison(spark, sf_dir):
    c = R.compare_to_baseline(D.ledger(spark, sf_dir))
    return c.select(
        "model", "baseline", "k", r6(F.col("delta")).alias("delta"), (F.round("t", 4) + 0.0).alias("t"),
        r6(F.col("p_value")).alias("p_value"), r6(F.col("p_adjusted")).alias("p_adjusted"), "rejected",
    )


_SUMM = ["sensitivity", "specificity", "pr_auc", "roc_auc", "f1", "brier", "fit_seconds"]


@register(
    "report_protocol_summary",
    LED + """SELECT model, COUNT(*) AS folds, COUNT(DISTINCT rep) AS repeats, MIN(config_json->>'$.feature_set') AS feature_set, MIN(config_json->>'$.source') AS source, """
    + ", ".join(f"round(AVG({m}), 9) AS {m}_mean, round(COALESCE(stddev_samp({m}), 0), 9) AS {m}_sd" for m in _SUMM)
    + ", " + ", ".join(f"SUM({c})::DOUBLE / COUNT(DISTINCT rep) AS {c}" for c in ("tn", "fp", "fn", "tp", "n"))
    + " FROM ledger WHERE (config_json->>'$.folds')::INT = 5 AND (config_json->>'$.repeats')::INT = 5 GROUP BY model",
)
def report_protocol_summary(spark, sf_dir):
    s = R.protocol_summary(D.ledger(spark, sf_dir))
    return s.select(
        "model", "folds", "repeats", "feature_set", "source",
        *[r9(F.col(f"{m}_{x}")).alias(f"{m}_{x}") for m in _SUMM for x in ("mean", "sd")], "tn", "fp", "fn", "tp", "n",
    )


@register(
    "report_best_per_metric",
    LED + ", m AS (SELECT model, " + ", ".join(f"round(AVG({m}), 9) AS {m}" for m in R.SUMMARY_METRICS) + " FROM ledger GROUP BY model)"
    + ", l AS (" + " UNION ALL ".join(f"SELECT model, '{m}' AS metric, {m} AS v, {'-' if m in R.LOWER_IS_BETTER else ''}{m} AS s FROM m WHERE {m} IS NOT NULL" for m in R.SUMMARY_METRICS) + ")"
    + " SELECT metric, MIN(v) AS best, string_agg(model, ',' ORDER BY model) AS models FROM l JOIN (SELECT metric, MAX(s) AS s FROM l GROUP BY metric) USING (metric, s) GROUP BY metric",
)
def report_best_per_metric(spark, sf_dir):
    led = D.ledger(spark, sf_dir)
    means = led.groupBy("model").agg(*[r9(F.avg(m)).alias(m) for m in R.SUMMARY_METRICS])
    return R.best_per_metric(means)


@register(
    "report_awaiting_models",
    LED + ", c(model) AS (VALUES " + ", ".join(f"('{n}')" for n in MC.names()) + ") SELECT model FROM c WHERE model NOT IN (SELECT model FROM ledger)",
)
def report_awaiting_models(spark, sf_dir):
    return R.awaiting(MC.catalog(spark).select("model"), D.ledger(spark, sf_dir))


@register(
    "report_latest_per_model",
    LED + """SELECT model, COUNT(*) OVER (PARTITION BY model) AS runs, rep, fold, round(roc_auc, 6) AS roc_auc, CAST(tp AS BIGINT) AS tp FROM ledger
             QUALIFY ROW_NUMBER() OVER (PARTITION BY model ORDER BY rep DESC, fold DESC) = 1""",
)
def report_latest_per_model(spark, sf_dir):
    t = R.latest_per_model(D.ledger(spark, sf_dir))
    return t.select("model", "runs", "rep", "fold", r6(F.col("roc_auc")).alias("roc_auc"), "tp")


@register(
    "report_reliability",
    LED + """SELECT 'logreg' AS model, round(AVG(sensitivity), 6) AS sensitivity, round(AVG(specificity), 6) AS specificity FROM ledger WHERE model = 'logreg'
             UNION ALL SELECT 'dense', NULL, NULL""",
)
def report_reliability(spark, sf_dir):
    led = D.ledger(spark, sf_dir)

    def one(m):
        return R.reliability(led, m).select(F.lit(m).alias("model"), r6(F.col("sensitivity")).alias("sensitivity"), r6(F.col("specificity")).alias("specificity"))

    return one("logreg").unionByName(one("dense"))


@register(
    "report_size_versus_metric",
    LED + "SELECT model, MIN(n_trainable_params)::BIGINT AS params, round(AVG(pr_auc), 6) AS pr_auc FROM ledger GROUP BY model",
)
def report_size_versus_metric(spark, sf_dir):
    return R.size_versus_metric(D.ledger(spark, sf_dir)).withColumn("pr_auc", r6(F.col("pr_auc")))


@register(
    "report_markdown",
    LED + """SELECT model, printf('%.3f', AVG(sensitivity)) || ' +/- ' || printf('%.3f', stddev_samp(sensitivity)) AS sensitivity, COUNT(*) AS folds FROM ledger GROUP BY model""",
)
def report_markdown(spark, sf_dir):
    """The rendered text, read back cell by cell."""
    led = D.ledger(spark, sf_dir)
    text = R.to_markdown(R.main_table(led, ["sensitivity"]))
    head, _, *body = [[c.strip() for c in line.strip("|").split("|")] for line in text.strip().split("\n")]
    df = spark.createDataFrame([tuple(r) for r in body], head)
    return df.select("model", "sensitivity", F.col("folds").cast("long").alias("folds"))


@register("model_catalog", LED + ", c(model, needs_special) AS (VALUES " + ", ".join(
    f"('{m['model']}', {str(m['needs_special']).upper()})" for m in MC.ENTRIES
) + ") SELECT c.model, c.needs_special, COUNT(l.model) AS ledger_rows FROM c LEFT JOIN ledger l ON l.model = c.model GROUP BY 1, 2")
def model_catalog(spark, sf_dir):
    led = D.ledger(spark, sf_dir).groupBy("model").agg(F.count("*").alias("ledger_rows"))
    out = MC.catalog(spark).select("model", "needs_special").join(led, "model", "left")
    return out.withColumn("ledger_rows", F.coalesce("ledger_rows", F.lit(0)))


# ---------------------------------------------------------------- tests between models


@register(
    "test_mcnemar_counts",
    ctes(SUBJECTS, SCORES) + """
    , c AS (SELECT ((p_a >= 0.5)::INT = cardio) AS a, ((p_b >= 0.5)::INT = cardio) AS b FROM scores)
    , n AS (SELECT COUNT(*) FILTER (a AND b) AS n_both_correct, COUNT(*) FILTER (a AND NOT b) AS n_a_only, COUNT(*) FILTER (NOT a AND b) AS n_b_only,
                   COUNT(*) FILTER (NOT a AND NOT b) AS n_both_wrong FROM c)
    SELECT *, n_a_only + n_b_only AS n_discordant, round(pow(ABS(n_a_only - n_b_only) - 1, 2) / (n_a_only + n_b_only), 6) AS statistic FROM n""",
)
def test_mcnemar_counts(spark, sf_dir):
    from .metric_queries import long_scores

    c = T.mcnemar(T.paired_correctness(long_scores(spark, sf_dir), "logreg", "mlp"))
    return c.select("n_both_correct", "n_a_only", "n_b_only", "n_both_wrong", "n_discordant", r6(F.col("statistic")).alias("statistic"))


@register("test_mcnemar")
def test_mcnemar(spark, sf_dir):
    """Per age group, with p-values and verdicts."""
    from ..functions.clinical import age_group_or_unknown
    from .metric_queries import long_scores

    band = D.subjects(spark, sf_dir).select(S.ID, age_group_or_unknown(F.col("age")).alias("age_group"))
    pred = long_scores(spark, sf_dir).join(band, S.ID)
    return T.mcnemar(T.paired_correctness(pred, "logreg", "mlp", by=["age_group"]))


_REP_MEANS = """
    , means AS (SELECT model, rep, AVG(roc_auc) AS auc FROM ledger GROUP BY model, rep)
    , d AS (SELECT b.model, a.auc - b.auc AS diff FROM means a JOIN means b USING (rep) WHERE a.model = 'logreg' AND b.model <> 'logreg')
    , g AS (SELECT model, COUNT(*) AS n, COUNT(*) - 1 AS df, AVG(diff) AS mean, stddev_samp(diff)/sqrt(COUNT(*)) AS se FROM d GROUP BY model)"""


def _rep_diffs(spark, sf_dir):
    led = D.ledger(spark, sf_dir)
    means = led.groupBy("model", "rep").agg(F.avg("roc_auc").alias("auc"))
    return T.paired_differences(means, ["rep"], "model", "auc", "logreg")


# Fixed value: two-sided 95 % and 90 % critical values of t at 4 degrees of freedom.
_T4 = {0.975: 2.7764451051977987, 0.95: 2.13184678133629}


@register(
    "test_paired_t",
    LED + _REP_MEANS + f"""
    SELECT model, n, df, round(mean, 6) AS mean, round(se, 9) AS se, round(mean/se, 3) AS t,
           round(mean - {_T4[0.975]}*se, 6) AS ci_low, round(mean + {_T4[0.975]}*se, 6) AS ci_high,
           round(1 - (ABS(mean/se)/sqrt(4 + pow(mean/se,2))) * (1 + 0.5*4/(4 + pow(mean/se,2))), 6) AS p_value FROM g""",
)
def test_paired_t(spark, sf_dir):
    t = T.paired_t(_rep_diffs(spark, sf_dir), ["model"])
    return t.select(
        "model", "n", "df", r6(F.col("mean")).alias("mean"), r9(F.col("se")).alias("se"), (F.round("t", 3) + 0.0).alias("t"),
        r6(F.col("ci_low")).alias("ci_low"), r6(F.col("ci_high")).alias("ci_high"), r6(F.col("p_value")).alias("p_value"),
    )


@register(
    "test_equivalence",
    LED + _REP_MEANS + f"""
    SELECT model, n, df, round(mean, 6) AS mean, round(mean - {_T4[0.95]}*se, 6) AS ci_low, round(mean + {_T4[0.95]}*se, 6) AS ci_high,
           round(GREATEST(ABS(mean - {_T4[0.95]}*se), ABS(mean + {_T4[0.95]}*se)), 6) AS bound,
           (mean - {_T4[0.95]}*se > -0.02 AND mean + {_T4[0.95]}*se < 0.02) AS equivalent FROM g""",
)
def test_equivalence(spark, sf_dir):
    t = T.equivalence(_rep_diffs(spark, sf_dir), ["model"], margin=0.02)
    return t.select("model", "n", "df", *[r6(F.col(c)).alias(c) for c in ("mean", "ci_low", "ci_high", "bound")], "equivalent")


@register(
    "test_corrected_resampled_t",
    LED + """
    , d AS (SELECT m.metric, a.rep, a.fold, CASE m.metric WHEN 'roc_auc' THEN a.roc_auc - b.roc_auc WHEN 'pr_auc' THEN a.pr_auc - b.pr_auc ELSE a.accuracy - b.accuracy END AS diff
            FROM ledger a JOIN ledger b USING (rep, fold), (VALUES ('roc_auc'), ('pr_auc'), ('accuracy')) m(metric) WHERE a.model = 'logreg' AND b.model = 'mlp')
    SELECT metric, COUNT(*) AS k, round(AVG(diff), 6) AS delta, round(AVG(diff)/sqrt(var_samp(diff)*(1.0::DOUBLE/COUNT(*) + 0.25::DOUBLE)), 4) AS t FROM d GROUP BY metric""",
)
def test_corrected_resampled_t(spark, sf_dir):
    led = D.ledger(spark, sf_dir).where(F.col("model").isin("logreg", "mlp"))
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("roc_auc", "pr_auc", "accuracy")])
    long = led.select("model", "rep", "fold", F.inline(cells))
    diffs = T.paired_differences(long, ["rep", "fold"], "model", "value", "logreg", by=["metric"])
    t = T.corrected_resampled_t(diffs, ["metric"], F.lit(4), F.lit(1))
    return t.select("metric", "k", r6(F.col("delta")).alias("delta"), (F.round("t", 4) + 0.0).alias("t"))


@register(
    "test_holm",
    LED + """
    , p AS (SELECT model, rep, round(1 - AVG(accuracy), 9) AS p_value FROM ledger GROUP BY model, rep)
    , a AS (SELECT *, LEAST(1, p_value * (COUNT(*) OVER () - ROW_NUMBER() OVER (ORDER BY p_value, model, rep) + 1)) AS adj FROM p)
    SELECT model, rep, p_value, round(adj, 6) AS p_adjusted, bool_and(adj < 0.9) OVER (ORDER BY p_value, model, rep) AS rejected FROM a""",
)
def test_holm(spark, sf_dir):
    """The step-down rule over fifteen numbers of the ledger that lie in (0, 1)."""
    led = D.ledger(spark, sf_dir)
    p = led.groupBy("model", "rep").agg(r9(1 - F.avg("accuracy")).alias("p_value"))
    return T.holm(p, alpha=0.9, tie=["model", "rep"]).withColumn("p_adjusted", r6(F.col("p_adjusted")))


@register(
    "test_verdicts",
    ctes(SUBJECTS, SCORES) + """
    , c AS (SELECT record_id % 400 AS site, ((p_a >= 0.5)::INT = cardio) AS a, ((p_b >= 0.5)::INT = cardio) AS b FROM scores)
    , n AS (SELECT site, COUNT(*) FILTER (a AND NOT b) AS x, COUNT(*) FILTER (NOT a AND b) AS y FROM c GROUP BY site)
    , p AS (SELECT *, x + y AS d, CASE WHEN x + y = 0 THEN 1 ELSE LEAST(1, 2 * (SELECT SUM(factorial(LEAST(x+y, 24)::INT)::DOUBLE / (factorial(i::INT)::DOUBLE * factorial(GREATEST(LEAST(x+y, 24)-i, 0)::INT)::DOUBLE)) FROM range(25) t(i) WHERE i <= LEAST(x, y)) * pow(0.5::DOUBLE, x+y)) END AS p FROM n)
    SELECT CASE WHEN d < 10 THEN 'inconclusive' WHEN d < 25 AND p >= 0.05 OR d >= 25 AND (abs(x - y) - 1) * (abs(x - y) - 1) / d::DOUBLE <= 3.841458820694124 THEN 'no significant difference' WHEN x > y THEN 'A is better' ELSE 'B is better' END AS verdict,
           COUNT(*) AS sites FROM p GROUP BY 1""",
)
def test_verdicts(spark, sf_dir):
    """Tests of 400 sites, exact below 25 discordant cases and by chi-square from there, counted by verdict."""
    from .metric_queries import long_scores

    pred = long_scores(spark, sf_dir).withColumn("site", F.col(S.ID) % 400)
    t = T.mcnemar(T.paired_correctness(pred, "logreg", "mlp", by=["site"]))
    v = F.regexp_extract("verdict", "^(inconclusive|no significant difference|A is better|B is better)", 1)
    return t.groupBy(v.alias("verdict")).agg(F.count("*").alias("sites"))
