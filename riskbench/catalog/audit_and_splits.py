"""Queries: data audit, folds, holdouts, samples, split invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions.numbers import r6
from ..functions import clinical as C
from ..operators import audit as A, splits as P
from ..sources import driver_tables as D
from .base import CLINICAL, FEATURE_LIST, FOLD_META, FOLDS, SUBJECTS, ctes, folds_sql, register

SUB = ctes(SUBJECTS)
GROUPS_SQL = f"""
groups AS (SELECT {FEATURE_LIST}, CAST(SUM(1 - cardio) AS BIGINT) AS n0, CAST(SUM(cardio) AS BIGINT) AS n1
           FROM subjects GROUP BY {FEATURE_LIST})"""
GRP = ctes(SUBJECTS, GROUPS_SQL)


@register(
    "audit_class_balance",
    SUB + """SELECT COUNT(*) AS n, CAST(SUM(cardio) AS BIGINT) AS positive, CAST(SUM(1-cardio) AS BIGINT) AS negative,
                    round(AVG(cardio), 6) AS prevalence,
                    round(GREATEST(SUM(cardio), SUM(1-cardio)) / COUNT(*)::DOUBLE, 6) AS majority_class_accuracy FROM subjects""",
)
def audit_class_balance(spark, sf_dir):
    b = A.class_balance(D.subjects(spark, sf_dir))
    return b.withColumns({c: r6(F.col(c)) for c in ("prevalence", "majority_class_accuracy")})


@register(
    "audit_duplicates",
    SUB + f"""
    , exact AS (SELECT COUNT(*) AS g FROM (SELECT DISTINCT {FEATURE_LIST}, cardio FROM subjects))
    , feats AS (SELECT {FEATURE_LIST}, COUNT(*) AS c, SUM(cardio) AS p FROM subjects GROUP BY {FEATURE_LIST})
    SELECT CAST(SUM(c) AS BIGINT) AS n, CAST(SUM(c) AS BIGINT) - (SELECT g FROM exact) AS exact_rows,
           CAST(SUM(c) AS BIGINT) - COUNT(*) AS feature_identical_rows,
           COUNT(*) FILTER (p > 0 AND p < c) AS contradictory_groups,
           CAST(SUM(c) FILTER (p > 0 AND p < c) AS BIGINT) AS contradictory_rows,
           round(SUM(GREATEST(p, c - p)) / SUM(c)::DOUBLE, 4) AS label_noise_ceiling,
           round(SUM(GREATEST(p, c - p)) / SUM(c)::DOUBLE, 6) AS ceiling_6,
           round(1 - SUM(GREATEST(p, c - p)) / SUM(c)::DOUBLE, 6) AS disagreement_rate
    FROM feats""",
)
def audit_duplicates(spark, sf_dir):
    return A.duplicate_summary(A.feature_groups(D.subjects(spark, sf_dir)))


@register(
    "audit_ceiling_by_age_group",
    SUB + f"""
    , feats AS (SELECT {FEATURE_LIST}, COUNT(*) AS c, SUM(cardio) AS p FROM subjects GROUP BY {FEATURE_LIST})
    SELECT CASE WHEN age/365.25::DOUBLE < 40 THEN 'young' WHEN age/365.25::DOUBLE < 50 THEN 'middle' WHEN age/365.25::DOUBLE < 60 THEN 'older'
                WHEN age/365.25::DOUBLE < 70 THEN 'senior' ELSE 'elderly' END AS age_group,
           CAST(SUM(c) AS BIGINT) AS n, CAST(SUM(p) AS BIGINT) AS positive, COUNT(*) FILTER (p > 0 AND p < c) AS contradictory_groups,
           CAST(COALESCE(SUM(c) FILTER (p > 0 AND p < c), 0) AS BIGINT) AS contradictory_rows,
           round(SUM(GREATEST(p, c - p)) / SUM(c)::DOUBLE, 4) AS label_noise_ceiling
    FROM feats GROUP BY 1""",
)
def audit_ceiling_by_age_group(spark, sf_dir):
    df = D.subjects(spark, sf_dir).withColumn("age_group", C.age_group_or_unknown(F.col("age")))
    return A.ceiling_by(df, "age_group")


_ALL = S.ALL_COLUMNS


@register(
    "audit_missing",
    SUB + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", COUNT(*) - COUNT({c}) AS missing, round((COUNT(*) - COUNT({c})) * 100.0::DOUBLE / COUNT(*), 2) AS missing_pct FROM subjects"""
        for c in _ALL
    ),
)
def audit_missing(spark, sf_dir):
    return A.missing(D.subjects(spark, sf_dir), _ALL)


@register(
    "audit_numeric_profile",
    SUB + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", COUNT({c}) AS n, MIN({c})::DOUBLE AS "min", quantile_cont({c}::DOUBLE, 0.5) AS p50, MAX({c})::DOUBLE AS "max",
            round(AVG({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std FROM subjects"""
        for c in S.NUMERIC
    ),
)
def audit_numeric_profile(spark, sf_dir):
    p = A.numeric_profile(D.subjects(spark, sf_dir), row_bound=D.row_bound(spark, sf_dir))
    return p.withColumns({c: r6(F.col(c)) for c in ("mean", "std")})


@register(
    "audit_category_counts",
    SUB + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", COALESCE(CAST({c} AS VARCHAR), 'missing') AS level, COUNT(*) AS "rows" FROM subjects GROUP BY {c}"""
        for c in S.CATEGORICAL
    ),
)
def audit_category_counts(spark, sf_dir):
    return A.category_counts(D.subjects(spark, sf_dir))


@register(
    "audit_subgroups",
    ctes(SUBJECTS, CLINICAL) + """
    SELECT 'gender' AS "key", CAST(gender AS VARCHAR) AS level, COUNT(*) AS "rows", round(AVG(cardio), 6) AS prevalence FROM clinical GROUP BY gender
    UNION ALL
    SELECT 'age_group', COALESCE(age_group, 'unknown'), COUNT(*), round(AVG(cardio), 6) FROM clinical GROUP BY age_group""",
)
def audit_subgroups(spark, sf_dir):
    return A.subgroup_counts(D.subjects(spark, sf_dir)).withColumn("prevalence", r6(F.col("prevalence")))


@register(
    "audit_warnings",
    GRP + f"""
    , d AS (SELECT SUM(n0+n1) - SUM((n0>0)::INT + (n1>0)::INT) AS ex, SUM(n0+n1) FILTER (n0>0 AND n1>0) AS con,
                   round(SUM(GREATEST(n0,n1)) / SUM(n0+n1)::DOUBLE, 4) AS ceil FROM groups)
    , sparse AS (SELECT * REPLACE (CASE WHEN record_id % 4 = 0 THEN NULL ELSE weight END AS weight) FROM subjects)
    , m AS (SELECT round((COUNT(*) - COUNT(weight)) * 100.0::DOUBLE / COUNT(*), 2) AS pct FROM sparse)
    , g AS (SELECT MIN(c) / SUM(c)::DOUBLE AS share FROM (SELECT COUNT(*) AS c FROM subjects GROUP BY gender))
    SELECT 'high_missing' AS code, 'weight' AS "column", pct AS "value" FROM m WHERE pct > 20
    UNION ALL SELECT 'exact_duplicates', '', ex::DOUBLE FROM d WHERE ex > 0
    UNION ALL SELECT 'contradictory_rows', '', con::DOUBLE FROM d WHERE con > 0
    UNION ALL SELECT 'label_noise_ceiling', '', ceil FROM d WHERE con > 0
    UNION ALL SELECT 'gender_imbalance', 'gender', round(share, 6) FROM g WHERE share < 0.30
    UNION ALL SELECT 'majority_floor', 'cardio', round(GREATEST(AVG(cardio), 1 - AVG(cardio)), 6) FROM subjects""",
)
def audit_warnings(spark, sf_dir):
    df = D.subjects(spark, sf_dir)
    sparse = df.withColumn("weight", F.when(F.col(S.ID) % 4 != 0, F.col("weight")))
    w = A.warnings(sparse, A.feature_groups(df))
    return w.withColumn("value", r6(F.col("value")))


_REPORT = GRP + f"""
    , dup AS (SELECT SUM(n0+n1)::DOUBLE AS n, SUM(n0+n1)::DOUBLE - SUM((n0>0)::INT + (n1>0)::INT) AS ex, SUM(n0+n1)::DOUBLE - COUNT(*) AS fi, COUNT(*) FILTER (n0>0 AND n1>0)::DOUBLE AS cg,
                     COALESCE(SUM(n0+n1) FILTER (n0>0 AND n1>0), 0)::DOUBLE AS cr, round(SUM(GREATEST(n0,n1)) / SUM(n0+n1)::DOUBLE, 4) AS ceil FROM groups)
    , bal AS (SELECT COUNT(*)::DOUBLE AS n, SUM(cardio)::DOUBLE AS pos, SUM(1-cardio)::DOUBLE AS neg FROM subjects)
    , lev AS ({" UNION ALL ".join(f"SELECT '{c}' AS k, COALESCE(CAST({c} AS VARCHAR), 'missing') AS l, cardio FROM subjects" for c in S.CATEGORICAL)}
              UNION ALL SELECT 'age_group', CASE WHEN age/365.25::DOUBLE < 40 THEN 'young' WHEN age/365.25::DOUBLE < 50 THEN 'middle' WHEN age/365.25::DOUBLE < 60 THEN 'older'
                        WHEN age/365.25::DOUBLE < 70 THEN 'senior' ELSE 'elderly' END, cardio FROM subjects)
    , rep(section, "key", level, metric, "value") AS (
        SELECT 'class_balance', 'cardio', '', unnest(['n','positive','negative','prevalence','majority_class_accuracy']), unnest([n, pos, neg, pos/n, GREATEST(pos,neg)/n]) FROM bal
        UNION ALL SELECT 'duplicates', '', '', unnest(['exact_rows','feature_identical_rows','contradictory_groups','contradictory_rows','label_noise_ceiling']), unnest([ex, fi, cg, cr, ceil]) FROM dup
        UNION ALL {" UNION ALL ".join(f"SELECT 'missing', '{c}', '', unnest(['missing','missing_pct']), unnest([(COUNT(*)-COUNT({c}))::DOUBLE, round((COUNT(*)-COUNT({c}))*100.0::DOUBLE/COUNT(*), 2)]) FROM subjects" for c in _ALL)}
        UNION ALL {" UNION ALL ".join(f"SELECT 'numeric', '{c}', '', unnest(['p50','n','min','max','mean','std']), unnest([quantile_cont({c}::DOUBLE, 0.5), COUNT({c})::DOUBLE, MIN({c})::DOUBLE, MAX({c})::DOUBLE, AVG({c}), stddev_samp({c})]) FROM subjects" for c in S.NUMERIC)}
        UNION ALL SELECT 'categories', k, l, 'rows', COUNT(*)::DOUBLE FROM lev WHERE k <> 'age_group' GROUP BY k, l
        UNION ALL SELECT 'subgroups', k, l, unnest(['rows','prevalence']), unnest([COUNT(*)::DOUBLE, AVG(cardio)]) FROM lev WHERE k IN ('gender','age_group') GROUP BY k, l
        UNION ALL SELECT 'warnings', 'exact_duplicates', '', 'value', ex FROM dup WHERE ex > 0
        UNION ALL SELECT 'warnings', unnest(['contradictory_rows','label_noise_ceiling']), '', 'value', unnest([cr, ceil]) FROM dup WHERE cr > 0
        UNION ALL SELECT 'warnings', 'majority_floor', 'cardio', 'value', GREATEST(pos,neg)/n FROM bal)
    SELECT section, "key", level, metric, round("value", 6) AS "value" FROM rep"""


@register("audit_report", _REPORT)
def audit_report(spark, sf_dir):
    r = A.audit(D.subjects(spark, sf_dir), row_bound=D.row_bound(spark, sf_dir))
    return r.withColumn("value", r6(F.col("value")))


@register(
    "audit_duplicate_listing",
    GRP + """
    SELECT 'features' AS kind, COUNT(*) AS groups, CAST(SUM(n0+n1) AS BIGINT) AS "rows" FROM groups WHERE n0+n1 > 1
    UNION ALL
    SELECT 'exact', COUNT(*), CAST(SUM(n) AS BIGINT) FROM (SELECT n0 AS n FROM groups UNION ALL SELECT n1 FROM groups) WHERE n > 1""",
)
def audit_duplicate_listing(spark, sf_dir):
    return A.duplicate_listing(A.feature_groups(D.subjects(spark, sf_dir)))


_ORDER = ", ".join(f"{c} NULLS FIRST" for c in S.FEATURES)


@register(
    "audit_largest_groups",
    GRP + f"SELECT {FEATURE_LIST}, n0+n1 AS size FROM groups WHERE n0+n1 > 1 ORDER BY size DESC, {_ORDER} LIMIT 10",
)
def audit_largest_groups(spark, sf_dir):
    return A.largest_groups(A.feature_groups(D.subjects(spark, sf_dir)))


@register("audit_conflicting_groups", GRP + "SELECT * FROM groups WHERE n0 > 0 AND n1 > 0")
def audit_conflicting_groups(spark, sf_dir):
    return A.conflicting_groups(A.feature_groups(D.subjects(spark, sf_dir)))


@register(
    "audit_conflicting_top",
    GRP + f"SELECT * FROM groups WHERE n0 > 0 AND n1 > 0 ORDER BY {_ORDER} LIMIT 20",
)
def audit_conflicting_top(spark, sf_dir):
    return A.conflicting_groups(A.feature_groups(D.subjects(spark, sf_dir)), k=20)


@register(
    "audit_profile",
    SUB + "SELECT COUNT(*) AS \"rows\", 12 AS \"columns\", round(AVG(cardio), 6) AS prevalence, CAST(SUM(cardio) AS BIGINT) AS positive, CAST(SUM(1-cardio) AS BIGINT) AS negative, "
    + "CAST(" + " + ".join(f"(COUNT(*) - COUNT({c}))" for c in _ALL) + " AS BIGINT) AS missing_cells FROM subjects",
)
def audit_profile(spark, sf_dir):
    p = A.profile(D.subjects(spark, sf_dir).select(*_ALL))
    return p.withColumn("prevalence", r6(F.col("prevalence")))


# ---------------------------------------------------------------- folds


@register("split_stratified_folds", ctes(SUBJECTS, FOLDS) + "SELECT record_id, rep, fold FROM folds")
def split_stratified_folds(spark, sf_dir):
    return D.folds(spark, sf_dir).select(S.ID, "rep", "fold")


@register(
    "split_fold_metadata",
    ctes(SUBJECTS, FOLDS, FOLD_META) + """SELECT rep, fold, n_train, n_test, round(train_prevalence, 6) AS train_prevalence,
        round(test_prevalence, 6) AS test_prevalence FROM fold_meta""",
)
def split_fold_metadata(spark, sf_dir):
    m = P.fold_metadata(D.folds(spark, sf_dir), "cardio")
    return m.withColumns({c: r6(F.col(c)) for c in ("train_prevalence", "test_prevalence")})


def _grouped(spark, sf_dir):
    return D.subjects(spark, sf_dir).withColumn("group_id", P.feature_group())


def group_folds(spark, sf_dir, k: int = 5, repeats: int = 5):
    return P.repeated_group_folds(_grouped(spark, sf_dir), "cardio", "group_id", k, repeats)


@register("split_group_folds")
def split_group_folds(spark, sf_dir):
    return group_folds(spark, sf_dir).select(S.ID, "rep", "fold")


@register(
    "split_group_isolation",
    SUB + f"""SELECT CAST(r AS INTEGER) AS rep, (SELECT COUNT(*) FROM (SELECT DISTINCT {FEATURE_LIST} FROM subjects)) AS groups, 0::BIGINT AS split_groups
              FROM range(5) t(r)""",
)
def split_group_isolation(spark, sf_dir):
    return P.group_isolation(group_folds(spark, sf_dir), "group_id")


@register(
    "split_group_coverage",
    SUB + "SELECT CAST(r AS INTEGER) AS rep, (SELECT COUNT(*) FROM subjects) AS records, 1::BIGINT AS min_times, 1::BIGINT AS max_times FROM range(5) t(r)",
)
def split_group_coverage(spark, sf_dir):
    return P.coverage(group_folds(spark, sf_dir))


@register(
    "split_group_balance",
    SUB + """SELECT CAST(r AS INTEGER) AS rep, CAST(f AS INTEGER) AS fold, TRUE AS size_within_1pct, TRUE AS prevalence_within_1pct
             FROM range(5) t(r), range(5) u(f)""",
)
def split_group_balance(spark, sf_dir):
    f = group_folds(spark, sf_dir)
    n = D.row_bound(spark, sf_dir)
    m = P.fold_metadata(f, "cardio")
    return m.select(
        "rep",
        "fold",
        (F.abs(F.col("n_test") - F.lit(n / 5)) <= F.lit(n * 0.01)).alias("size_within_1pct"),
        (F.abs(F.col("test_prevalence") - F.col("train_prevalence")) <= F.lit(0.01)).alias("prevalence_within_1pct"),
    )


@register(
    "split_coverage",
    ctes(SUBJECTS, FOLDS) + """SELECT rep, COUNT(*) AS records, MIN(c) AS min_times, MAX(c) AS max_times
        FROM (SELECT rep, record_id, COUNT(*) AS c FROM folds GROUP BY rep, record_id) GROUP BY rep""",
)
def split_coverage(spark, sf_dir):
    return P.coverage(D.folds(spark, sf_dir))


@register(
    "split_fold_violations",
    ctes(SUBJECTS, FOLDS, FOLD_META) + """SELECT rep, fold, test_prevalence IN (0, 1) AS one_class_test, train_prevalence IN (0, 1) AS one_class_train FROM fold_meta""",
)
def split_fold_violations(spark, sf_dir):
    return P.fold_violations(D.folds(spark, sf_dir), "cardio")


@register(
    "split_duplicate_leakage",
    ctes(SUBJECTS, FOLDS, f"""
    gid AS (SELECT record_id, DENSE_RANK() OVER (ORDER BY {FEATURE_LIST}) AS g FROM subjects),
    fg AS (SELECT rep, fold, g, record_id FROM folds JOIN gid USING (record_id)),
    cross_groups AS (SELECT DISTINCT a.rep, a.fold, a.g FROM (SELECT DISTINCT rep, fold, g FROM fg) a
                     JOIN (SELECT DISTINCT rep, fold, g FROM fg) b ON a.rep = b.rep AND a.g = b.g AND a.fold <> b.fold)""")
    + """
    SELECT fg.rep, fg.fold, COUNT(DISTINCT c.g) AS crossing_groups, COUNT(c.g) AS affected_test_rows
    FROM fg LEFT JOIN cross_groups c ON c.rep = fg.rep AND c.fold = fg.fold AND c.g = fg.g GROUP BY fg.rep, fg.fold""",
)
def split_duplicate_leakage(spark, sf_dir):
    gid = _grouped(spark, sf_dir).select(S.ID, "group_id")
    return P.group_leakage(D.folds(spark, sf_dir).join(gid, S.ID), "group_id", 5)


@register(
    "split_holdout",
    SUB + f"""
    , r AS (SELECT record_id, cardio, ROW_NUMBER() OVER (PARTITION BY cardio ORDER BY substr(sha256(concat_ws('|', '{S.BASE_SEED}', 'holdout', '0.2', CAST(record_id AS VARCHAR))), 1, 16), record_id) AS rn,
                   COUNT(*) OVER (PARTITION BY cardio) AS n FROM subjects)
    SELECT record_id, rn <= LEAST(GREATEST(round_even(n * 0.2::DOUBLE, 0), 1), n - 1) AS is_test FROM r""",
)
def split_holdout(spark, sf_dir):
    return P.holdout(D.subjects(spark, sf_dir).select(S.ID, "cardio"), "cardio", 0.2).select(S.ID, "is_test")


@register(
    "split_cohort_holdout",
    SUB + """SELECT r_name AS cohort, r_name IN ('ASIA', 'EUROPE') AS is_test, COUNT(*) AS n, round(AVG(cardio), 6) AS prevalence
             FROM subjects JOIN orders ON o_orderkey = record_id JOIN customer ON c_custkey = o_custkey
             JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2""",
)
def split_cohort_holdout(spark, sf_dir):
    o = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(S.ID), "o_custkey")
    where = (
        D.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        .join(D.table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
        .join(D.table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
        .select("c_custkey", F.col("r_name").alias("cohort"))
    )
    df = D.subjects(spark, sf_dir).select(S.ID, "cardio").join(o, S.ID).join(where, F.col("o_custkey") == F.col("c_custkey"))
    split = P.cohort_holdout(df, "cohort", "cardio", ["ASIA", "EUROPE"])
    return split.groupBy("cohort", "is_test").agg(F.count("*").alias("n"), r6(F.avg("cardio")).alias("prevalence"))


def _order_sql(*tags) -> str:
    key = ", ".join(f"'{t}'" for t in (S.BASE_SEED, *tags))
    return f"ORDER BY substr(sha256(concat_ws('|', {key}, CAST(record_id AS VARCHAR))), 1, 16), record_id"


@register(
    "split_interleaved_folds",
    SUB + f"SELECT record_id, CAST((ROW_NUMBER() OVER ({_order_sql('interleave', 0)}) - 1) % 5 AS INTEGER) AS fold FROM subjects",
)
def split_interleaved_folds(spark, sf_dir):
    return P.interleaved_folds(D.subjects(spark, sf_dir).select(S.ID), 5)


@register(
    "split_balanced_sample",
    SUB + f"""
    (SELECT record_id, cardio FROM subjects WHERE cardio = 1 {_order_sql('balanced')} LIMIT 500)
    UNION ALL
    (SELECT record_id, cardio FROM subjects WHERE cardio = 0 {_order_sql('balanced')} LIMIT 501)""",
)
def split_balanced_sample(spark, sf_dir):
    return P.balanced_sample(D.subjects(spark, sf_dir).select(S.ID, "cardio"), "cardio", 1001)


@register("split_sample", SUB + f"SELECT record_id, cardio FROM subjects {_order_sql('sample')} LIMIT 1000")
def split_sample(spark, sf_dir):
    return P.sample(D.subjects(spark, sf_dir).select(S.ID, "cardio"), 1000)


@register("split_head", SUB + "SELECT record_id, cardio FROM subjects ORDER BY record_id LIMIT 1000")
def split_head(spark, sf_dir):
    return P.head(D.subjects(spark, sf_dir).select(S.ID, "cardio"), 1000)


@register(
    "split_derived_seeds",
    SUB + f"""SELECT record_id, CAST(('0x' || substr(sha256(concat_ws('|', '{S.BASE_SEED}', 'noise', CAST(record_id AS VARCHAR))), 1, 8)) AS BIGINT) AS seed FROM subjects""",
)
def split_derived_seeds(spark, sf_dir):
    return D.subjects(spark, sf_dir).select(S.ID, P.derive_seed(S.BASE_SEED, "noise", F.col(S.ID)).alias("seed"))


@register(
    "split_key_sets",
    ctes(SUBJECTS, folds_sql(5, 1)) + """
    , test AS (SELECT record_id FROM folds WHERE fold = 0), young AS (SELECT record_id FROM subjects WHERE age < 18000)
    SELECT 'difference' AS op, COUNT(*) AS n FROM (SELECT record_id FROM subjects EXCEPT SELECT record_id FROM test)
    UNION ALL SELECT 'intersection', COUNT(*) FROM (SELECT record_id FROM test INTERSECT SELECT record_id FROM young)
    UNION ALL SELECT 'union_all', COUNT(*) FROM (SELECT record_id FROM test UNION ALL SELECT record_id FROM young)""",
)
def split_key_sets(spark, sf_dir):
    all_rows = D.subjects(spark, sf_dir)
    test = D.folds(spark, sf_dir, 5, 1).where("fold = 0").select(S.ID)
    young = all_rows.where("age < 18000").select(S.ID)
    parts = {
        "difference": P.keys_minus(all_rows.select(S.ID), test),
        "intersection": P.keys_common(test, young),
        "union_all": P.stacked(test, young),
    }
    return P.stacked(*[t.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n") for k, t in parts.items()])
