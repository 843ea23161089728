"""Queries: model evaluation, experiments, batch scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import clinical as C
from ..functions.encoding import encode, feature_names, fixed_angles
from ..functions.numbers import r6, r9
from ..operators import fold_stats as FS, metrics as M, selection as SEL, splits as P
from ..plans import experiments as E, fold_trees as FT, harness as H, heads as HD, models as MD, scoring as SC
from ..session import new_path, stored
from ..sources import clinical_csv, driver_tables as D, result_files as RF
from .base import CLINICAL, FOLDS, SCORES, SUBJECTS, ctes, folds_sql, ledger_sql, register
from .clinical_and_contract import REQUESTS, requests
from .feature_queries import FOLDED, KEEP, TRAIN, _long, folded

LED = ctes(SUBJECTS, SCORES, FOLDS, ledger_sql())


def rows(spark, sf_dir):
    return D.subjects(spark, sf_dir).drop("cents")


def _evaluate(spark, sf_dir, models: dict, folds: int = 5, repeats: int = 5, threshold="train"):
    f = D.folds(spark, sf_dir, folds, repeats)
    led = H.evaluate(models, rows(spark, sf_dir), "cardio", f, threshold, {"folds": folds, "repeats": repeats, "source": "orders", "seed": S.BASE_SEED}, shared_k=8)
    return led


@register("model_logreg")
def model_logreg(spark, sf_dir):
    """Group-safe folds: copies of a feature tuple never lie on both sides."""
    df = rows(spark, sf_dir)
    f = P.repeated_group_folds(df.withColumn("group_id", P.feature_group()), "cardio", "group_id", 5, 5)
    return H.evaluate({"logreg": MD.build("logreg")}, df, "cardio", f, "train", {"folds": 5, "repeats": 5}, shared_k=8)


# Every third record of this table is one and the same row but for its class; none has an id.
_REPEATED = {"age": 18000, "height": 165.0, "weight": 70.0, "ap_hi": 120.0, "ap_lo": 80.0, "smoke": 0, "alco": 0, "active": 1, "gender": 1, "cholesterol": 1, "gluc": 1}


@register(
    "harness_repeated_rows",
    ctes(SUBJECTS) + """
    , c AS (SELECT cardio, COUNT(*) AS m FROM subjects GROUP BY cardio)
    , f AS (SELECT CAST(r.r AS INTEGER) AS rep, CAST(k.f AS INTEGER) AS fold, CAST(SUM(m // 5 + (k.f < m % 5)::INT) AS BIGINT) AS n,
                   CAST(SUM(cardio * (m // 5 + (k.f < m % 5)::INT)) AS BIGINT) AS n_pos
            FROM c, range(5) r(r), range(5) k(f) GROUP BY ALL)
    SELECT 'logreg' AS model, rep, fold, n, n_pos, CAST((SELECT SUM(m) FROM c) - n AS BIGINT) AS n_train, CAST((SELECT SUM(m) FROM c) AS BIGINT) AS record_ids FROM f""",
)
def harness_repeated_rows(spark, sf_dir):
    """A file without ids, a third of whose rows are copies: load, folds and evaluation over 5 x 5 folds."""
    plain = rows(spark, sf_dir)
    copied = plain.withColumns({c: F.when(F.col(S.ID) % 3 == 0, F.lit(v)).otherwise(F.col(c)).cast(plain.schema[c].dataType) for c, v in _REPEATED.items()})
    df = stored(clinical_csv.load_delimited(spark, clinical_csv.write_delimited(copied, "repeated-csv")), "repeated-rows")
    ids = df.select(S.ID).distinct().count()
    led = H.evaluate({"logreg": MD.build("logreg")}, df, "cardio", P.repeated_stratified_folds(df, "cardio"), 0.5, shared_k=8)
    return led.select("model", "rep", "fold", "n", "n_pos", "n_train", F.lit(ids).cast("long").alias("record_ids"))


def _trees(spark, sf_dir, models: dict):
    """A pass over the rows serves a level of the trees of all 5 x 5 training sets."""
    config = {"folds": 5, "repeats": 5, "source": "orders", "seed": S.BASE_SEED}
    return FT.evaluate_trees(models, rows(spark, sf_dir), "cardio", D.folds(spark, sf_dir, 5, 5), "train", config)


@register("model_trees")
def model_trees(spark, sf_dir):
    return _trees(spark, sf_dir, {"rf": FT.Forest()})


@register("model_boosted_trees")
def model_boosted_trees(spark, sf_dir):
    return _trees(spark, sf_dir, {"xgboost": FT.Boosting()})


@register("model_svm_rbf")
def model_svm_rbf(spark, sf_dir):
    return _evaluate(spark, sf_dir, {"svm_rbf": MD.build("svm_rbf")})


@register("model_mlp")
def model_mlp(spark, sf_dir):
    return _evaluate(spark, sf_dir, {"mlp": MD.build("mlp")})


@register("model_controls")
def model_controls(spark, sf_dir):
    """Both controls over 5 x 5 folds: fifty heads that share every pass."""
    f = D.folds(spark, sf_dir, 5, 5)
    config = {"folds": 5, "repeats": 5, "source": "orders", "seed": S.BASE_SEED}
    return HD.evaluate_heads(["control_c", "product_control"], rows(spark, sf_dir), "cardio", f, "train", config)


@register(
    "model_class_weights",
    ctes(SUBJECTS, folds_sql(5, 5)) + """
    , t AS (SELECT rep, CAST(u.f AS INTEGER) AS fold, cardio FROM folds JOIN range(5) u(f) ON u.f <> fold)
    SELECT rep, fold, cardio, COUNT(*) AS n, round(SUM(COUNT(*)) OVER (PARTITION BY rep, fold) / (2.0::DOUBLE * COUNT(*)), 6) AS weight FROM t GROUP BY rep, fold, cardio""",
)
def model_class_weights(spark, sf_dir):
    """The stage's weights, and the rows that get them, on each of the training sets."""
    from ..plans.stages import BalancedWeight

    f = stored(D.folds(spark, sf_dir, 5, 5), "class-folds")
    out = None
    for rep in range(5):
        for fold in range(5):
            train = f.where((F.col("rep") == rep) & (F.col("fold") != fold))
            w = BalancedWeight(target="cardio").fit(train).transform(train)
            part = w.groupBy("cardio").agg(F.count("*").alias("n"), r6(F.max("weight")).alias("weight")).withColumns({"rep": F.lit(rep), "fold": F.lit(fold)})
            out = part if out is None else out.unionByName(part)
    return out


@register("model_pca")
def model_pca(spark, sf_dir):
    """Retained variance of eight components over the encoded table."""
    df = encode(D.subjects(spark, sf_dir), True, [S.ID])
    names = feature_names(True)
    safe = df.select(S.ID, *[F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(f"f{i}") for i, n in enumerate(names)])
    fitted = MD.pca_reducer([f"f{i}" for i in range(len(names))], 8).fit(safe)
    v = MD.retained_variance(fitted)
    return fitted.transform(safe).agg(F.count("features").alias("rows")).withColumn("retained_variance", F.lit(v))


@register("model_importance_top")
def model_importance_top(spark, sf_dir):
    """Sixteen strongest of the 32 hybrid columns by tree importance, on the training side of a holdout."""
    df = P.holdout(rows(spark, sf_dir), "cardio").where(~F.col("is_test")).drop("is_test")
    fitted = MD.hybrid().fit(df)
    imp = fitted.stages[-1].featureImportances.toArray().tolist()
    names = MD.hybrid_columns()
    t = spark.createDataFrame([(n, float(v)) for n, v in zip(names, imp)], "feature string, value double")
    return SEL.top_features(t, 16)


@register("encode_compact_representation")
def encode_compact_representation(spark, sf_dir):
    """Eight columns per record, learned on the training side of a holdout and applied to all rows."""
    from ..plans.stages import ClinicalRepresentation

    df = P.holdout(rows(spark, sf_dir), "cardio")
    fitted = ClinicalRepresentation(k=8).fit(df.where(~F.col("is_test")).drop("is_test"))
    return fitted.transform(df).select(S.ID, "is_test", *fitted.output_columns())


@register(
    "score_batch_labels",
    ctes(SUBJECTS, SCORES) + """
    SELECT record_id, (p_a >= 0.5)::INT AS prediction, p_a AS risk_probability, CAST(round_even(p_a * 100, 0) AS INTEGER) AS risk_percentage,
           CASE WHEN p_a >= 0.5 THEN 'Higher estimated risk' ELSE 'Lower estimated risk' END AS risk_label,
           'Model-estimated risk only. This is not a medical diagnosis or clinical advice.' AS disclaimer FROM scores""",
)
def score_batch_labels(spark, sf_dir):
    s = D.scores(spark, sf_dir)
    return s.select(S.ID, *[c.alias(n) for n, c in SC.prediction_columns(F.col("p_a")).items()])


@register("score_batch")
def score_batch(spark, sf_dir):
    """Fit, save, load the first usable bundle, score all acceptable requests; the others follow with their reasons."""
    path = new_path(spark, "bundle")
    SC.save_bundle(MD.hybrid().fit(rows(spark, sf_dir)), path)
    model = SC.load_bundle([path + "-missing", path])
    scored, rejected = SC.score(requests(spark, sf_dir), model)
    return scored.unionByName(rejected, allowMissingColumns=True)


@register(
    "score_accepted_requests",
    ctes(SUBJECTS) + REQUESTS + """
    SELECT record_id, CAST(round_even(age * 365.25, 0) AS INTEGER) AS age_days FROM requests
    WHERE age BETWEEN 18 AND 120 AND height BETWEEN 100 AND 250 AND weight BETWEEN 20 AND 300 AND ap_hi BETWEEN 60 AND 250
      AND ap_lo BETWEEN 30 AND 150 AND ap_hi >= ap_lo AND gluc BETWEEN 1 AND 3""",
)
def score_accepted_requests(spark, sf_dir):
    from ..operators.contract import accepted

    return SC.to_canonical(accepted(requests(spark, sf_dir))).select(S.ID, F.col("age").alias("age_days"))


@register("scan_source_registry", ctes(SUBJECTS) + "SELECT cardio, COUNT(*) AS n FROM subjects GROUP BY cardio")
def scan_source_registry(spark, sf_dir):
    """The processed table is cached as Parquet (the second write is skipped) and loaded by source name."""
    path = new_path(spark, "processed")
    df = D.subjects(spark, sf_dir).select(*S.CLINICAL_SCHEMA.names)
    clinical_csv.cache_processed(df, path)
    clinical_csv.cache_processed(df.limit(1), path)
    return clinical_csv.load(spark, "clinical_parquet", path).groupBy("cardio").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- experiments

_SP = ["bmi", "ap_hi"]


@register(
    "experiment_spike",
    ctes(SUBJECTS, CLINICAL, folds_sql(5, 5), FOLDED, TRAIN, _long("long_train", "train", KEEP, _SP)) + """
    , st AS (SELECT rep, fold, AVG(value) FILTER (feature='bmi') AS mb, stddev_pop(value) FILTER (feature='bmi') AS sb,
                    AVG(value) FILTER (feature='ap_hi') AS ma, stddev_pop(value) FILTER (feature='ap_hi') AS sa FROM long_train GROUP BY rep, fold)
    SELECT record_id, rep, fold, round(sqrt(1 - 0.3::DOUBLE*0.3::DOUBLE) * (bmi - mb)/sb + 0.3::DOUBLE * (ap_hi - ma)/sa, 6) + 0.0 AS bmi FROM folded JOIN st USING (rep, fold)""",
)
def experiment_spike(spark, sf_dir):
    df = folded(spark, sf_dir)
    out = E.spike(df, FS.train_moments(df, _SP, 5), "bmi", "ap_hi", 0.3)
    return out.select(S.ID, "rep", "fold", r6(F.col("bmi")).alias("bmi"))


def _arms(spark, sf_dir, base=("age_years", "ap_hi", "ap_lo", "bmi")):
    from ..plans.stages import ChainProducts

    base = list(base)
    df = C.add_clinical(D.subjects(spark, sf_dir))
    med = {r["column"]: r["p50"] for r in _medians(df, base, D.row_bound(spark, sf_dir))}
    full = df.select(S.ID, *[F.coalesce(F.col(c), F.lit(med[c])).alias(c) for c in base])
    ang = fixed_angles(full, base).select(S.ID, *[F.col(c).alias(f"x{i}") for i, c in enumerate(base)])
    xs = [f"x{i}" for i in range(len(base))]
    chain = ChainProducts(inputCols=xs, prefix="c")
    return chain.transform(ang), xs, chain.output_columns()


def _medians(df, columns, bound):
    from ..operators.audit import numeric_profile

    return numeric_profile(df, columns, bound).collect()


@register("experiment_arm_grid")
def experiment_arm_grid(spark, sf_dir):
    """Raw angles, chain products and both, three label regimes of the whole table, shared folds, four draws each."""
    df, labels, arms = _grid(spark, sf_dir)
    return E.arm_grid(df, labels, arms, E_folds(spark, sf_dir))


def _grid(spark, sf_dir):
    df, xs, cs = _arms(spark, sf_dir)
    kinds = ("linear", "pairwise", "mixed")
    signals = df.withColumns({f"signal_{kind}": E.latent(kind, xs) for kind in kinds})
    df, labels = E.labels_by_median(signals, {(kind, draw): f"signal_{kind}" for kind in kinds for draw in range(4)}, 0.35, D.row_bound(spark, sf_dir))
    return df, labels, {"raw": xs, "products": cs, "raw+products": [*xs, *cs]}


def E_folds(spark, sf_dir, k: int = 5):
    return P.interleaved_folds(D.subjects(spark, sf_dir).select(S.ID), k).withColumn("rep", F.lit(0))


@register("experiment_block_ablation")
def experiment_block_ablation(spark, sf_dir):
    """Singles, pairs and triples of the chain products, cumulative after the raw columns and each alone (no increment)."""
    df, xs, cs = _arms(spark, sf_dir, ("age_years", "height", "weight", "ap_hi", "ap_lo", "bmi", "pulse_pressure", "map"))
    labelled = df.join(D.subjects(spark, sf_dir).select(S.ID, F.col("cardio").alias("label")), S.ID)
    n = len(xs)
    blocks = {"raw": xs, "raw+singles": xs + cs[:n], "raw+pairs": xs + cs[: 2 * n], "raw+triples": xs + cs}
    alone = {"singles": cs[:n], "pairs": cs[n : 2 * n], "triples": cs[2 * n :]}
    grid = stored(E.arm_grid(labelled, {("cardio", 0): "label"}, blocks | alone, E_folds(spark, sf_dir)), "block-ablation")
    single = E.contributions(grid, ["raw", *alone], "raw", ["auc"]).where(F.col("arm") != "raw").withColumn("increment", F.lit(None).cast("double"))
    return E.contributions(grid, list(blocks), "raw", ["auc"]).unionByName(single)


NULL_SQL = LED + """
    , s AS (SELECT 'ledger' AS regime, rep AS draw, fold, model AS arm, roc_auc AS auc FROM ledger)
    , fd AS (SELECT b.arm, a.auc - b.auc AS d FROM s a JOIN s b USING (draw, fold) WHERE a.arm = 'logreg' AND b.arm <> 'logreg')
    , sm AS (SELECT arm, draw, AVG(auc) AS auc FROM s GROUP BY arm, draw)
    , sd AS (SELECT b.arm, a.auc - b.auc AS d FROM sm a JOIN sm b USING (draw) WHERE a.arm = 'logreg' AND b.arm <> 'logreg')
    SELECT 'ledger' AS regime, x.arm, round(x.auc, 6) AS auc, round(x.sd, 6) AS sd, round(f.delta, 6) AS delta, round(f.t, 3) AS t_fold, round(g.t, 3) AS t_seed
    FROM (SELECT arm, AVG(auc) AS auc, stddev_pop(auc) AS sd FROM s GROUP BY arm) x
    LEFT JOIN (SELECT arm, AVG(d) AS delta, AVG(d)/(stddev_samp(d)/sqrt(COUNT(*))) AS t FROM fd GROUP BY arm) f ON f.arm = x.arm
    LEFT JOIN (SELECT arm, AVG(d)/(stddev_samp(d)/sqrt(COUNT(*))) AS t FROM sd GROUP BY arm) g ON g.arm = x.arm"""


def _null_scores(spark, sf_dir):
    led = D.ledger(spark, sf_dir)
    return led.select(F.lit("ledger").alias("regime"), F.col("rep").alias("draw"), "fold", F.col("model").alias("arm"), F.col("roc_auc").alias("auc"))


def _null_out(t):
    return t.select(
        "regime", "arm", r6(F.col("auc")).alias("auc"), r6(F.col("sd")).alias("sd"), r6(F.col("delta")).alias("delta"),
        (F.round("t_fold", 3) + 0.0).alias("t_fold"), (F.round("t_seed", 3) + 0.0).alias("t_seed"),
    )


@register("experiment_null_report", NULL_SQL)
def experiment_null_report(spark, sf_dir):
    return _null_out(E.null_test_report(_null_scores(spark, sf_dir), "logreg"))


@register("scan_nested_results", NULL_SQL)
def scan_nested_results(spark, sf_dir):
    """The report as one nested JSON document, read back and flattened."""
    path = new_path(spark, "results")
    RF.write_nested_results(E.null_test_report(_null_scores(spark, sf_dir), "logreg"), path)
    return _null_out(RF.read_nested_results(spark, path))


@register(
    "experiment_contributions",
    LED + """
    , m AS (SELECT model AS arm, metric, AVG(v) AS mean FROM (SELECT model, 'accuracy' AS metric, accuracy AS v FROM ledger UNION ALL SELECT model, 'roc_auc', roc_auc FROM ledger) GROUP BY ALL)
    , o(arm, step) AS (VALUES ('control_c', 0), ('mlp', 1), ('logreg', 2))
    , t AS (SELECT m.arm, step, metric, mean FROM m JOIN o ON o.arm = m.arm)
    SELECT arm, step, metric, round(mean, 9) AS mean, round(mean - MAX(CASE WHEN arm = 'control_c' THEN mean END) OVER (PARTITION BY metric), 9) AS delta,
           round(mean - LAG(mean) OVER (PARTITION BY metric ORDER BY step), 9) AS increment FROM t""",
)
def experiment_contributions(spark, sf_dir):
    led = D.ledger(spark, sf_dir).withColumnRenamed("model", "arm")
    t = E.contributions(led, ["control_c", "mlp", "logreg"], "control_c", ["accuracy", "roc_auc"])
    return t.withColumns({c: r9(F.col(c)) for c in ("mean", "delta", "increment")})


@register(
    "experiment_degradation",
    ctes(SUBJECTS, SCORES) + f"""
    , grid(size) AS (VALUES {', '.join(f'({n})' for n in E.SAMPLE_GRID)})
    , d AS (SELECT size, CAST(r AS INTEGER) AS repeat, (p_a >= 0.5)::INT = cardio AS ok,
                   ROW_NUMBER() OVER (PARTITION BY size, r ORDER BY substr(sha256(concat_ws('|', '{S.BASE_SEED}', 'degradation', CAST(size AS VARCHAR), CAST(r AS VARCHAR), CAST(record_id AS VARCHAR))), 1, 16), record_id) AS rn
            FROM scores, grid, range(3) t(r))
    , a AS (SELECT size, repeat, AVG(ok::INT) AS accuracy FROM d WHERE rn <= size GROUP BY size, repeat)
    SELECT size, round(AVG(accuracy), 9) AS mean, round(stddev_samp(accuracy), 9) AS sd, round(MIN(accuracy), 9) AS "min", round(MAX(accuracy), 9) AS "max", COUNT(*) AS repeats FROM a GROUP BY size""",
)
def experiment_degradation(spark, sf_dir):
    pred = D.scores(spark, sf_dir).select(S.ID, F.col("cardio").alias("y"), F.col("p_a").alias("p"))

    def accuracy(df, by):
        return M.with_rates(M.confusion(df, by), ["accuracy"])

    c = E.degradation_curve(pred, accuracy, "accuracy")
    return c.withColumns({x: r9(F.col(x)) for x in ("mean", "sd", "min", "max")})


@register("experiment_smallest_lift")
def experiment_smallest_lift(spark, sf_dir):
    """Smallest lift detected: single-column scores with the risk signal mixed in at rising strength, five repeats as draws."""
    signal = (F.col("cents") % 121).cast("double").alias("signal")
    df = stored(folded(spark, sf_dir, 5).select(S.ID, "rep", "fold", "cardio", "bmi", signal), "spiked")
    stats = FS.fitted(FS.train_moments(df, ["bmi", "signal"], 5))
    out = None
    for eps in (0.0, 0.1, 0.3):
        mixed = E.spike(df, stats, "bmi", "signal", eps).where(F.col("bmi").isNotNull())
        auc = M.roc_auc(mixed.select("rep", F.col("cardio").alias("y"), F.col("bmi").alias("p")), ["rep"], D.row_bound(spark, sf_dir))
        part = auc.select(F.lit("bmi").alias("regime"), F.col("rep").alias("draw"), F.lit(eps).alias("eps"), F.col("roc_auc").alias("auc"))
        out = part if out is None else out.unionByName(part)
    return E.smallest_detected_lift(out)
