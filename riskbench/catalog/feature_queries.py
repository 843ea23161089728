"""Queries: training-fold statistics, selection, attributions, feature crosses."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import clinical as C
from ..functions.numbers import r6
from ..operators import crosses as X, fold_stats as FS, selection as SEL, splits as P
from ..session import stored
from ..sources import driver_tables as D
from .base import CLINICAL, SUBJECTS, ctes, folds_sql, register

REPEATS = 5
FEATURES = S.CANDIDATE_FEATURES
_NUM = ["age_years", "bmi", "ap_hi", "ap_lo", "pulse_pressure"]


def _long(name: str, src: str, keep: str, features) -> str:
    parts = [f"SELECT {keep}, '{f}' AS feature, {f}::DOUBLE AS value FROM {src}" for f in features]
    return f"\n{name} AS (" + " UNION ALL ".join(parts) + ")"


FOLDED = "\nfolded AS (SELECT c.*, f.rep, f.fold FROM clinical c JOIN folds f USING (record_id))"
TRAIN = "\ntrain AS (SELECT x.* EXCLUDE (fold), CAST(t.f AS INTEGER) AS fold FROM folded x JOIN range(5) t(f) ON t.f <> x.fold)"
BASE = (SUBJECTS, CLINICAL, folds_sql(5, REPEATS), FOLDED, TRAIN)
MEDIANS = "\nmedians AS (SELECT rep, fold, feature, quantile_cont(value, 0.5) AS median FROM long_train GROUP BY rep, fold, feature)"
KEEP = "rep, fold, record_id, cardio"


def folded(spark, sf_dir, repeats: int = REPEATS):
    """Clinical rows with their fold in each repeat."""
    return P.with_stratified_folds(C.add_clinical(D.subjects(spark, sf_dir)), "cardio", 5, repeats)


def folded_once(spark, sf_dir, columns):
    """The same, written once for a fit and its application."""
    return stored(folded(spark, sf_dir).select(S.ID, "rep", "fold", *columns), "folded")


@register(
    "impute_train_medians",
    ctes(*BASE, _long("long_train", "train", KEEP, _NUM), MEDIANS) + "SELECT rep, fold, feature, round(median, 6) AS median FROM medians",
)
def impute_train_medians(spark, sf_dir):
    m = FS.train_medians(folded(spark, sf_dir), _NUM, 5, D.row_bound(spark, sf_dir))
    return m.withColumn("median", r6(F.col("median")))


@register(
    "impute_medians_applied",
    ctes(*BASE, _long("long_train", "train", KEEP, _NUM), MEDIANS, _long("long_test", "folded", KEEP, _NUM)) + """
    SELECT record_id, rep, fold, feature, round(COALESCE(value, median), 6) AS value FROM long_test JOIN medians USING (rep, fold, feature)""",
)
def impute_medians_applied(spark, sf_dir):
    df = folded_once(spark, sf_dir, _NUM)
    out = FS.impute(df, FS.fitted(FS.train_medians(df, _NUM, 5, D.row_bound(spark, sf_dir))), _NUM)
    return FS.long_values(out, _NUM, (S.ID, "rep", "fold")).withColumn("value", r6(F.col("value")))


_MODES = ["gender", "cholesterol", "gluc", "active", "ap_hi"]


@register(
    "impute_train_modes",
    ctes(*BASE, _long("long_train", "train", KEEP, _MODES)) + """
    SELECT rep, fold, feature, value AS mode FROM (SELECT rep, fold, feature, value, COUNT(*) AS n FROM long_train WHERE value IS NOT NULL GROUP BY ALL)
    QUALIFY ROW_NUMBER() OVER (PARTITION BY rep, fold, feature ORDER BY n DESC, value) = 1""",
)
def impute_train_modes(spark, sf_dir):
    return FS.train_modes(folded(spark, sf_dir), _MODES, 5)


@register(
    "scale_train_moments",
    ctes(*BASE, _long("long_train", "train", KEEP, _NUM)) + """
    SELECT rep, fold, feature, COUNT(value) AS n, round(AVG(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(MIN(value), 6) AS "min", round(MAX(value), 6) AS "max"
    FROM long_train GROUP BY rep, fold, feature""",
)
def scale_train_moments(spark, sf_dir):
    m = FS.train_moments(folded(spark, sf_dir), _NUM, 5)
    return m.withColumns({c: r6(F.col(c)) for c in ("mean", "sd", "min", "max")})


@register(
    "scale_standardised",
    ctes(*BASE, _long("long_train", "train", KEEP, _NUM), MEDIANS, _long("long_test", "folded", KEEP, _NUM)) + """
    , st AS (SELECT rep, fold, feature, AVG(COALESCE(value, median)) AS mean, stddev_pop(COALESCE(value, median)) AS sd
             FROM long_train JOIN medians USING (rep, fold, feature) GROUP BY rep, fold, feature)
    SELECT record_id, rep, fold, feature, round((COALESCE(value, median) - mean) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) + 0.0 AS value
    FROM long_test JOIN medians USING (rep, fold, feature) JOIN st USING (rep, fold, feature)""",
)
def scale_standardised(spark, sf_dir):
    """Median fill, then training mean and population sd of the filled rows."""
    df = folded_once(spark, sf_dir, _NUM)
    fill = FS.fitted(FS.train_medians(df, _NUM, 5, D.row_bound(spark, sf_dir)))
    filled = FS.impute(df, fill, _NUM)
    out = FS.standardise(filled, FS.fitted(FS.train_moments(df, _NUM, 5, fill)), _NUM)
    return FS.long_values(out, _NUM, (S.ID, "rep", "fold")).withColumn("value", r6(F.col("value")))


@register(
    "scale_range_angles",
    ctes(*BASE, _long("long_train", "train", KEEP, _NUM), _long("long_test", "folded", KEEP, _NUM)) + """
    , st AS (SELECT rep, fold, feature, MIN(value) AS lo, MAX(value) AS hi FROM long_train GROUP BY rep, fold, feature)
    SELECT record_id, rep, fold, feature, round(CASE WHEN value IS NOT NULL THEN LEAST(1, GREATEST(0, (value - lo) / CASE WHEN hi - lo < 1e-12 THEN 1 ELSE hi - lo END)) * pi() END, 6) AS value
    FROM long_test JOIN st USING (rep, fold, feature)""",
)
def scale_range_angles(spark, sf_dir):
    df = folded_once(spark, sf_dir, _NUM)
    out = FS.range_angles(df, FS.fitted(FS.train_moments(df, _NUM, 5)), _NUM)
    return FS.long_values(out, _NUM, (S.ID, "rep", "fold")).withColumn("value", r6(F.col("value")))


# ---------------------------------------------------------------- selection

FILLED = """
filled AS (SELECT rep, fold, record_id, cardio, feature, COALESCE(value, median) AS value FROM long_train JOIN medians USING (rep, fold, feature))"""


@register(
    "select_information",
    ctes(*BASE, _long("long_train", "train", KEEP, FEATURES), MEDIANS, FILLED) + """
    , q AS (SELECT rep, fold, feature, list_sort(list_distinct(quantile_cont(value, [0.125,0.25,0.375,0.5,0.625,0.75,0.875]))) AS edges FROM filled GROUP BY rep, fold, feature)
    , b AS (SELECT rep, fold, feature, cardio, len(list_filter(edges, lambda e: e <= value)) AS bin FROM filled JOIN q USING (rep, fold, feature))
    , j AS (SELECT rep, fold, feature, bin, cardio, COUNT(*)::DOUBLE AS n FROM b GROUP BY ALL)
    , w AS (SELECT *, SUM(n) OVER (PARTITION BY rep, fold, feature, bin) AS nb, SUM(n) OVER (PARTITION BY rep, fold, feature, cardio) AS ny,
                   SUM(n) OVER (PARTITION BY rep, fold, feature) AS nn FROM j)
    SELECT rep, fold, feature, round(GREATEST(SUM(n/nn * ln(n*nn/(nb*ny))), 0), 6) AS mi FROM w GROUP BY rep, fold, feature""",
)
def select_information(spark, sf_dir):
    mi = SEL.train_information(folded(spark, sf_dir), FEATURES, "cardio", 5, 8, D.row_bound(spark, sf_dir))
    return mi.withColumn("mi", r6(F.col("mi")))


@register(
    "select_spearman",
    ctes(SUBJECTS, CLINICAL, folds_sql(5, REPEATS), FOLDED, TRAIN, _long("long_train", "train", KEEP, FEATURES), MEDIANS, FILLED) + """
    , r AS (SELECT rep, fold, record_id, feature, RANK() OVER (PARTITION BY rep, fold, feature ORDER BY value) + (COUNT(*) OVER (PARTITION BY rep, fold, feature, value) - 1) / 2.0::DOUBLE AS rk FROM filled)
    , o(feature, pos) AS (VALUES """ + ", ".join(f"('{f}', {i})" for i, f in enumerate(FEATURES)) + """)
    , rr AS (SELECT r.*, pos FROM r JOIN o USING (feature))
    SELECT x.rep, x.fold, x.feature AS a, y.feature AS b, round(ABS(corr(x.rk, y.rk)), 6) AS rho
    FROM rr x JOIN rr y ON x.rep = y.rep AND x.fold = y.fold AND x.record_id = y.record_id AND x.pos < y.pos GROUP BY ALL""",
)
def select_spearman(spark, sf_dir):
    r = SEL.train_spearman(folded(spark, sf_dir), FEATURES, "cardio", 5, D.row_bound(spark, sf_dir))
    return r.withColumn("rho", r6(F.col("rho")))


@register("select_greedy")
def select_greedy(spark, sf_dir):
    """Selected features of each fold with their rationale."""
    return SEL.rationale(SEL.select_features(folded(spark, sf_dir), "cardio", 5, row_bound=D.row_bound(spark, sf_dir)))


@register("select_support_mask")
def select_support_mask(spark, sf_dir):
    return SEL.support(SEL.select_features(folded(spark, sf_dir), "cardio", 5, row_bound=D.row_bound(spark, sf_dir)))


SCREEN = """
screen_rank AS (SELECT rep, fold, feature, cardio, RANK() OVER w + (COUNT(*) OVER (PARTITION BY rep, fold, feature, value) - 1) / 2.0::DOUBLE AS rk
                FROM long_train WHERE value IS NOT NULL WINDOW w AS (PARTITION BY rep, fold, feature ORDER BY value)),
screen AS (SELECT rep, fold, feature, (SUM(rk) FILTER (cardio = 1) - SUM(cardio) * (SUM(cardio) + 1) / 2.0) / (SUM(cardio)::DOUBLE * SUM(1 - cardio)) AS auc
           FROM screen_rank GROUP BY rep, fold, feature),
top AS (SELECT *, ABS(auc - 0.5) AS strength, ROW_NUMBER() OVER (PARTITION BY rep, fold ORDER BY round(ABS(auc - 0.5), 9) DESC, feature) AS rk FROM screen)"""


def _screened(spark, sf_dir):
    s = SEL.train_screening(folded(spark, sf_dir), FEATURES, "cardio", 5, D.row_bound(spark, sf_dir))
    return s.withColumn("strength", F.round("strength", 9))


@register(
    "select_screening",
    ctes(*BASE, _long("long_train", "train", KEEP, FEATURES), SCREEN) + "SELECT rep, fold, feature, round(auc, 6) AS auc, round(strength, 6) AS strength, CAST(rk AS INTEGER) AS rank FROM top WHERE rk <= 8",
)
def select_screening(spark, sf_dir):
    t = SEL.top_per_fold(_screened(spark, sf_dir), "strength", 8)
    return t.select("rep", "fold", "feature", r6(F.col("auc")).alias("auc"), r6(F.col("strength")).alias("strength"), "rank")


@register(
    "select_stability",
    ctes(*BASE, _long("long_train", "train", KEEP, FEATURES), SCREEN) + "SELECT feature, COUNT(*) AS folds FROM top WHERE rk <= 6 GROUP BY feature",
)
def select_stability(spark, sf_dir):
    return SEL.stability(SEL.top_per_fold(_screened(spark, sf_dir), "strength", 6))


@register(
    "select_rationale",
    ctes(*BASE, _long("long_train", "train", KEEP, FEATURES), SCREEN) + ", why(feature, rationale) AS (VALUES "
    + ", ".join(f"('{k}', '{v}')" for k, v in SEL.RATIONALE.items()) + ") SELECT rep, fold, feature, rationale FROM top JOIN why USING (feature) WHERE rk <= 3",
)
def select_rationale(spark, sf_dir):
    top = SEL.top_per_fold(_screened(spark, sf_dir), "strength", 3)
    return SEL.rationale(top.select("rep", "fold", "feature"))


@register(
    "select_columns",
    ctes(SUBJECTS, CLINICAL) + "SELECT record_id, round(bmi, 6) AS bmi, ap_hi, cholesterol FROM clinical",
)
def select_columns(spark, sf_dir):
    from ..operators.contract import project

    df = project(C.add_clinical(D.subjects(spark, sf_dir)), [S.ID, "bmi", "ap_hi", "cholesterol"])
    return df.withColumn("bmi", r6(F.col("bmi")))


# ---------------------------------------------------------------- attributions

_ATTR = ["age_years", "bmi", "ap_hi", "ap_lo", "cholesterol", "height__missing", "weight__missing"]
ATTR_SQL = ctes(SUBJECTS, CLINICAL, """
flags AS (SELECT *, (height IS NULL)::INT AS height__missing, (weight IS NULL)::INT AS weight__missing FROM clinical)""",
    _long("attr_values", "flags", "record_id, cardio", _ATTR), """
attr_stats AS (SELECT feature, AVG(value) AS m, stddev_pop(value) AS s, corr(value, cardio) AS r FROM attr_values GROUP BY feature),
attributions AS (SELECT record_id, feature, COALESCE((value - m) / s * r, 0) AS value FROM attr_values JOIN attr_stats USING (feature))""")


def attributions(spark, sf_dir):
    """(record_id, feature, value): standardised value times its correlation with the label, as in a one-feature linear model."""
    df = C.add_clinical(D.subjects(spark, sf_dir)).withColumns(
        {"height__missing": F.col("height").isNull().cast("int"), "weight__missing": F.col("weight").isNull().cast("int")}
    )
    long = FS.long_values(df, _ATTR, (S.ID, "cardio"))
    known = F.when(F.col("value").isNotNull(), F.col("cardio"))
    stats = long.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.corr("value", known).alias("r"))
    z = (F.col("value") - F.col("m")) / F.col("s") * F.col("r")
    return long.join(F.broadcast(stats), "feature").select(S.ID, "feature", F.coalesce(z, F.lit(0.0)).alias("value"))


@register(
    "attribution_top_features",
    ATTR_SQL + """SELECT feature, round(importance, 6) AS importance, CAST(ROW_NUMBER() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank
                  FROM (SELECT feature, AVG(ABS(value)) AS importance FROM attributions GROUP BY feature) QUALIFY rank <= 5""",
)
def attribution_top_features(spark, sf_dir):
    return SEL.top_features(attributions(spark, sf_dir), 5).withColumn("importance", r6(F.col("importance")))


@register(
    "attribution_leakage_proxies",
    ATTR_SQL + """SELECT feature, rank FROM (SELECT feature, CAST(ROW_NUMBER() OVER (ORDER BY AVG(ABS(value)) DESC, feature) AS INTEGER) AS rank FROM attributions GROUP BY feature)
                  WHERE rank <= 5 AND feature IN ('height__missing', 'weight__missing', 'ap_lo')""",
)
def attribution_leakage_proxies(spark, sf_dir):
    hits = SEL.leakage_proxies(attributions(spark, sf_dir), ["height__missing", "weight__missing", "ap_lo"], top=5)
    return hits.select("feature", "rank")


@register(
    "attribution_signed_order",
    ctes(SUBJECTS, CLINICAL, _long("v", "clinical", "record_id, cardio", _NUM)) + """
    , m AS (SELECT feature, AVG(value) FILTER (cardio = 1) - AVG(value) FILTER (cardio = 0) AS value FROM v GROUP BY feature)
    , t AS (SELECT feature, value, CASE WHEN value > 0 THEN 'raises' WHEN value < 0 THEN 'lowers' ELSE 'neutral' END AS direction FROM m)
    SELECT feature, round(value, 6) AS value, direction, CAST(ROW_NUMBER() OVER (PARTITION BY direction ORDER BY ABS(t.value) DESC, feature) AS INTEGER) AS position,
           CAST(ROW_NUMBER() OVER (ORDER BY ABS(t.value) DESC, feature) AS INTEGER) AS by_size FROM t""",
)
def attribution_signed_order(spark, sf_dir):
    long = FS.long_values(C.add_clinical(D.subjects(spark, sf_dir)), _NUM, (S.ID, "cardio"))
    gap = long.groupBy("feature").agg(
        (F.avg(F.when(F.col("cardio") == 1, F.col("value"))) - F.avg(F.when(F.col("cardio") == 0, F.col("value")))).alias("value")
    )
    return SEL.signed_order(gap).withColumn("value", r6(F.col("value")))


# ---------------------------------------------------------------- crosses

_X = ["age_years", "ap_hi", "ap_lo", "bmi", "pulse_pressure", "cholesterol", "gluc", "active"]
BINNED = ctes(SUBJECTS, CLINICAL, """
edges AS (SELECT """ + ", ".join(f"list_sort(list_distinct(quantile_cont({c}::DOUBLE, [0.25, 0.5, 0.75]))) AS e_{c}" for c in _X) + " FROM clinical)",
    "\nbinned AS (SELECT record_id, " + ", ".join(
        f"CAST(CASE WHEN {c} IS NULL THEN len(e_{c}) ELSE len(list_filter(e_{c}, lambda e: e <= {c})) END AS INTEGER) AS {c}" for c in _X
    ) + " FROM clinical CROSS JOIN edges)")
MI_SQL = BINNED + _long(", lb", "binned", "record_id", _X).replace("\n,", ",") + """
    , o(feature, pos) AS (VALUES """ + ", ".join(f"('{f}', {i})" for i, f in enumerate(_X)) + """)
    , lo AS (SELECT record_id, feature, pos, value FROM lb JOIN o USING (feature))
    , j AS (SELECT x.pos AS i, y.pos AS j, x.feature AS a, y.feature AS b, x.value AS u, y.value AS v, COUNT(*)::DOUBLE AS n FROM lo x JOIN lo y ON x.record_id = y.record_id AND x.pos < y.pos GROUP BY ALL)
    , w AS (SELECT *, SUM(n) OVER (PARTITION BY i, j, u) AS nu, SUM(n) OVER (PARTITION BY i, j, v) AS nv, SUM(n) OVER (PARTITION BY i, j) AS nn FROM j)
    , raw AS (SELECT i, j, a, b, GREATEST(SUM(n/nn * ln(n*nn/(nu*nv))), 0) AS mi FROM w GROUP BY i, j, a, b)
    , mi AS (SELECT i, j, a, b, mi / MAX(mi) OVER () AS mi FROM raw)"""


def _binned(spark, sf_dir):
    df = C.add_clinical(D.subjects(spark, sf_dir))
    edges = X.quantile_edges(df, _X, 4, D.row_bound(spark, sf_dir))
    return X.discretise(df, _X, edges).select(S.ID, *_X)


@register("cross_quantile_bins", BINNED + f"SELECT record_id, {', '.join(_X)} FROM binned")
def cross_quantile_bins(spark, sf_dir):
    return _binned(spark, sf_dir)


def _mi(spark, sf_dir):
    return X.pairwise_information(_binned(spark, sf_dir), _X)


@register("cross_pairwise_information", MI_SQL + "SELECT i, j, a, b, round(mi, 6) AS mi FROM mi")
def cross_pairwise_information(spark, sf_dir):
    return _mi(spark, sf_dir).withColumn("mi", r6(F.col("mi")))


_SUBSETS = X.closed_chain(len(_X), 2) + X.closed_chain(len(_X), 3)
_COUPLED = MI_SQL + ", sub(position, i, j) AS (VALUES " + ", ".join(
    f"({p}, {min(a, b)}, {max(a, b)})" for p, s in enumerate(_SUBSETS) for n, a in enumerate(s) for b in s[n + 1 :]
) + ") , coupled AS (SELECT position, AVG(mi) AS coupling FROM sub JOIN mi USING (i, j) GROUP BY position)"


@register(
    "cross_couplings",
    _COUPLED + "SELECT position, CASE position " + " ".join(f"WHEN {p} THEN '{'*'.join(f'x{i}' for i in s)}'" for p, s in enumerate(_SUBSETS))
    + " END AS subset, round(coupling, 6) AS coupling FROM coupled",
)
def cross_couplings(spark, sf_dir):
    return X.couplings(_mi(spark, sf_dir), _SUBSETS).withColumn("coupling", r6(F.col("coupling")))


@register(
    "cross_permuted_couplings",
    _COUPLED + f"""
    , src AS (SELECT coupling, ROW_NUMBER() OVER (ORDER BY substr(sha256(concat_ws('|', '{S.BASE_SEED}', 'permute', CAST(position AS VARCHAR))), 1, 16), position) AS r FROM coupled)
    , dst AS (SELECT position, ROW_NUMBER() OVER (ORDER BY position) AS r FROM coupled)
    SELECT position, round(coupling, 6) AS coupling FROM dst JOIN src USING (r)""",
)
def cross_permuted_couplings(spark, sf_dir):
    c = X.couplings(_mi(spark, sf_dir), _SUBSETS)
    return X.permuted(c, S.BASE_SEED).select("position", r6(F.col("coupling")).alias("coupling"))


_P = ["ap_hi", "ap_lo", "bmi", "age_years"]


def _angles(spark, sf_dir):
    from ..functions.encoding import fixed_angles

    return fixed_angles(C.add_clinical(D.subjects(spark, sf_dir)), _P)


def _angle_sql() -> str:
    from ..functions.encoding import angle_bounds

    cols = []
    for i, c in enumerate(_P):
        lo, hi = angle_bounds(c)
        cols.append(f"CASE WHEN {c} IS NOT NULL THEN LEAST(1, GREATEST(0, ({c} - {lo}) / ({hi} - {lo})::DOUBLE)) * pi() END AS x{i}")
    return ctes(SUBJECTS, CLINICAL, f"\nang AS (SELECT record_id, {', '.join(cols)} FROM clinical)")


@register(
    "cross_chain_products",
    _angle_sql() + "SELECT record_id, " + ", ".join(
        "round(tanh(" + " * ".join(n.split("*")) + f"), 6) AS \"{n}\"" for n in X.chain_names(len(_P))
    ) + " FROM ang",
)
def cross_chain_products(spark, sf_dir):
    df = X.chain_products(_angles(spark, sf_dir), _P, keep=[S.ID])
    return df.select(S.ID, *[r6(F.col(f"`{n}`")).alias(n) for n in X.chain_names(len(_P))])


def _projection_sql() -> str:
    h, d = 6, 2
    first = ", ".join(
        "tanh(" + " + ".join(f"x{i} * {X._normal(S.BASE_SEED, 1, i, j, len(_P) ** -0.5)!r}::DOUBLE" for i in range(len(_P))) + f") AS h{j}" for j in range(h)
    )
    second = ", ".join(
        "round(tanh(" + " + ".join(f"h{i} * {X._normal(S.BASE_SEED, 2, i, j, h ** -0.5)!r}::DOUBLE" for i in range(h)) + f"), 6) + 0.0 AS z{j}" for j in range(d)
    )
    return _angle_sql() + f", hid AS (SELECT record_id, {first} FROM ang) SELECT record_id, {second} FROM hid"


@register("cross_random_projection", _projection_sql())
def cross_random_projection(spark, sf_dir):
    df = X.random_projection(_angles(spark, sf_dir), _P, hidden=6, d_out=2, keep=[S.ID])
    return df.select(S.ID, r6(F.col("z0")).alias("z0"), r6(F.col("z1")).alias("z1"))
