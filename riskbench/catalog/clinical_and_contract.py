"""Queries over the clinical table: scans, contract checks, derived columns, encoding without statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import clinical as C, encoding as E
from ..functions.numbers import r6
from ..operators import contract as V
from ..sources import clinical_csv, driver_tables as D
from .base import CLINICAL, SUBJECTS, ctes, register

SUB = ctes(SUBJECTS)
CLIN = ctes(SUBJECTS, CLINICAL)


@register(
    "scan_clinical_csv",
    SUB + """
    SELECT cardio, COUNT(*) AS n, CAST(SUM(age) AS BIGINT) AS age_sum, COUNT(height) AS heights, COUNT(ap_hi) AS pressures,
           SUM(weight) AS weight_sum, CAST(SUM(smoke + alco + active) AS BIGINT) AS flags
    FROM subjects GROUP BY cardio""",
)
def scan_clinical_csv(spark, sf_dir):
    path = clinical_csv.write_delimited(D.subjects(spark, sf_dir).withColumn("id", F.col(S.ID)), "clinical-csv")
    df = clinical_csv.load_delimited(spark, path)
    return df.groupBy("cardio").agg(
        F.count("*").alias("n"), F.sum("age").alias("age_sum"), F.count("height").alias("heights"),
        F.count("ap_hi").alias("pressures"), F.sum("weight").alias("weight_sum"), F.sum(F.expr("smoke + alco + active")).alias("flags"),
    )


@register(
    "scan_projection",
    SUB + """SELECT age, height, weight, ap_hi, ap_lo, smoke, alco, active, gender, cholesterol, gluc, cardio FROM subjects""",
)
def scan_projection(spark, sf_dir):
    return V.project(D.subjects(spark, sf_dir), S.ALL_COLUMNS)


@register(
    "scan_numeric_coercion",
    SUB + """
    , texts AS (SELECT record_id, CASE WHEN record_id % 7 = 0 THEN 'n/a' WHEN record_id % 11 = 0 THEN '' ELSE CAST(CAST(height AS BIGINT) AS VARCHAR) END AS t
                FROM subjects)
    SELECT record_id, TRY_CAST(t AS DOUBLE) AS height FROM texts""",
)
def scan_numeric_coercion(spark, sf_dir):
    k = F.col(S.ID)
    text = F.when(k % 7 == 0, "n/a").when(k % 11 == 0, "").otherwise(F.col("height").cast("long").cast("string"))
    return clinical_csv.coerce_numeric(D.subjects(spark, sf_dir).select(S.ID, text.alias("height")), {"height": "double"})


@register(
    "scan_target_normalise",
    SUB + """SELECT cardio, COUNT(*) AS n FROM subjects GROUP BY cardio""",
)
def scan_target_normalise(spark, sf_dir):
    raw = D.subjects(spark, sf_dir).select(F.concat(F.lit(" "), F.col("cardio").cast("string"), F.lit(" ")).alias("cardio"))
    return clinical_csv.normalise_target(raw, "cardio").groupBy("cardio").agg(F.count("*").alias("n"))


@register(
    "scan_two_schema_targets",
    """
    SELECT 'quality' AS target, COUNT(*) AS n, COUNT(*) FILTER (quality = 1) AS positive, COUNT(*) FILTER (quality IS NULL) AS missing,
           round(AVG(quality), 6) AS prevalence FROM documents LEFT JOIN labels USING (doc_id)
    UNION ALL
    SELECT 'toxic', COUNT(*), COUNT(*) FILTER (toxic = 1), COUNT(*) FILTER (toxic IS NULL), round(AVG(toxic), 6)
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def scan_two_schema_targets(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents").select("doc_id")
    joined = docs.join(D.table(spark, sf_dir, "labels"), "doc_id", "left")
    cells = F.array(*[F.struct(F.lit(c).alias("target"), F.col(c).alias("v")) for c in ("quality", "toxic")])
    return joined.select(F.inline(cells)).groupBy("target").agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("v") == 1, 1)).alias("positive"),
        F.count(F.when(F.col("v").isNull(), 1)).alias("missing"),
        r6(F.avg("v")).alias("prevalence"),
    )


@register(
    "contract_domain_violations",
    SUB + """
    , broken AS (SELECT CASE WHEN record_id % 50 = 0 THEN 9 ELSE gender END AS gender,
                        CASE WHEN record_id % 70 = 0 THEN 0 WHEN record_id % 71 = 0 THEN NULL ELSE cholesterol END AS cholesterol FROM subjects)
    SELECT 'gender' AS "column", CAST(gender AS VARCHAR) AS "value", COUNT(*) AS "rows" FROM broken
      WHERE gender NOT IN (1,2) GROUP BY gender
    UNION ALL
    SELECT 'cholesterol', CAST(cholesterol AS VARCHAR), COUNT(*) FROM broken WHERE cholesterol NOT IN (1,2,3) GROUP BY cholesterol""",
)
def contract_domain_violations(spark, sf_dir):
    k = F.col(S.ID)
    broken = D.subjects(spark, sf_dir).withColumns(
        {
            "gender": F.when(k % 50 == 0, 9).otherwise(F.col("gender")),
            "cholesterol": F.when(k % 70 == 0, 0).when(k % 71 != 0, F.col("cholesterol")),
        }
    )
    return V.domain_violations(broken)


@register(
    "contract_target_violations",
    SUB + """
    , broken AS (SELECT CASE WHEN record_id % 90 = 0 THEN NULL WHEN record_id % 91 = 0 THEN 2 ELSE cardio END AS cardio FROM subjects)
    SELECT COUNT(*) FILTER (cardio IS NULL) AS null_targets, COUNT(*) FILTER (cardio NOT IN (0,1)) AS non_binary_targets FROM broken""",
)
def contract_target_violations(spark, sf_dir):
    k = F.col(S.ID)
    df = D.subjects(spark, sf_dir).withColumn("cardio", F.when(k % 91 == 0, 2).otherwise(F.col("cardio")))
    return V.target_violations(df.withColumn("cardio", F.when(k % 90 != 0, F.col("cardio"))))


@register("contract_validate", SUB + "SELECT COUNT(*) AS n FROM subjects")
def contract_validate(spark, sf_dir):
    return V.validate(D.subjects(spark, sf_dir)).agg(F.count("*").alias("n"))


REQUESTS = """
    , requests AS (SELECT record_id, CAST(FLOOR(age/365.25) AS INTEGER) AS age, CAST(height AS INTEGER) AS height, weight,
        CAST(ap_hi AS INTEGER) AS ap_hi, CAST(ap_lo AS INTEGER) AS ap_lo, smoke, alco, active, gender, cholesterol,
        CASE WHEN record_id % 83 = 0 THEN 4 ELSE gluc END AS gluc FROM subjects)"""


def requests(spark, sf_dir):
    """Scoring requests in the request layout: age in years, whole centimetres and millimetres of mercury."""
    df = D.subjects(spark, sf_dir)
    return df.select(
        S.ID,
        F.floor(F.col("age") / 365.25).cast("int").alias("age"),
        F.col("height").cast("int").alias("height"),
        "weight",
        F.col("ap_hi").cast("int").alias("ap_hi"),
        F.col("ap_lo").cast("int").alias("ap_lo"),
        "smoke", "alco", "active", "gender", "cholesterol",
        F.when(F.col(S.ID) % 83 == 0, 4).otherwise(F.col("gluc")).alias("gluc"),
    )


def _reasons_sql() -> str:
    parts = []
    for c, (lo, hi) in V.REQUEST_BOUNDS.items():
        parts.append(f"CASE WHEN {c} IS NULL THEN '{c}_missing;' ELSE '' END")
        parts.append(f"CASE WHEN {c} NOT BETWEEN {lo} AND {hi} THEN '{c}_range;' ELSE '' END")
    parts.append("CASE WHEN ap_hi < ap_lo THEN 'pressure_order;' ELSE '' END")
    return " || ".join(parts)


@register("contract_reject_reasons", SUB + REQUESTS + f"SELECT record_id, {_reasons_sql()} AS reasons FROM requests")
def contract_reject_reasons(spark, sf_dir):
    df = V.reject_reasons(requests(spark, sf_dir))
    return df.select(S.ID, F.when(F.size("reasons") > 0, F.concat(F.array_join("reasons", ";"), F.lit(";"))).otherwise("").alias("reasons"))


@register(
    "contract_pressure_order",
    SUB + "SELECT COUNT(*) AS inverted FROM subjects WHERE ap_hi < ap_lo",
)
def contract_pressure_order(spark, sf_dir):
    return D.subjects(spark, sf_dir).where(F.col("ap_hi") < F.col("ap_lo")).agg(F.count("*").alias("inverted"))


@register(
    "contract_age_to_days",
    SUB + REQUESTS + "SELECT record_id, CAST(round_even(age * 365.25, 0) AS INTEGER) AS age_days FROM requests",
)
def contract_age_to_days(spark, sf_dir):
    return requests(spark, sf_dir).select(S.ID, C.age_years_to_days(F.col("age")).alias("age_days"))


@register(
    "contract_evaluation_input",
    SUB + """SELECT COUNT(*) AS n, COUNT(*) - COUNT(DISTINCT record_id) AS repeated_ids, COUNT(*) FILTER (cardio IS NULL) AS bad_targets,
                    COUNT(*) FILTER (cents IS NULL) AS missing_groups,
                    COUNT(*) FILTER (isinf(height) OR isnan(height)) + COUNT(*) FILTER (isinf(weight) OR isnan(weight)) AS non_finite_features
             FROM subjects""",
)
def contract_evaluation_input(spark, sf_dir):
    return V.evaluation_input_checks(D.subjects(spark, sf_dir), "cardio", "cents", ["height", "weight"])


_FINITE = ["height", "weight", "ap_hi"]


@register(
    "contract_non_finite",
    SUB + """
    , b AS (SELECT CASE WHEN record_id % 77 = 0 THEN 'nan'::DOUBLE ELSE height END AS height,
                   CASE WHEN record_id % 78 = 0 THEN 'inf'::DOUBLE WHEN record_id % 79 = 0 THEN '-inf'::DOUBLE ELSE weight END AS weight, ap_hi FROM subjects)
    """ + " UNION ALL ".join(f"""SELECT '{c}' AS "column", COUNT(*) FILTER (isnan({c}) OR isinf({c})) AS non_finite FROM b""" for c in _FINITE),
)
def contract_non_finite(spark, sf_dir):
    k = F.col(S.ID)
    df = D.subjects(spark, sf_dir).withColumns(
        {
            "height": F.when(k % 77 == 0, float("nan")).otherwise(F.col("height")),
            "weight": F.when(k % 78 == 0, float("inf")).when(k % 79 == 0, float("-inf")).otherwise(F.col("weight")),
        }
    )
    return V.non_finite_counts(df, _FINITE)


# ---------------------------------------------------------------- derived columns

_NUM = ["height", "weight", "ap_hi", "ap_lo", "age_years", "bmi", "pulse_pressure", "map"]


@register(
    "clinical_features",
    CLIN + f"SELECT record_id, {', '.join(f'round({c}, 6) AS {c}' for c in _NUM)}, bmi_class, bp_group, age_group FROM clinical",
)
def clinical_features(spark, sf_dir):
    df = C.add_clinical(D.subjects(spark, sf_dir))
    return df.select(S.ID, *[r6(F.col(c)).alias(c) for c in _NUM], "bmi_class", "bp_group", "age_group")


@register(
    "clinical_cleaning",
    CLIN + """SELECT COUNT(*) AS n, COUNT(*) - COUNT(height) AS heights_missing, COUNT(*) - COUNT(weight) AS weights_missing,
              COUNT(*) - COUNT(ap_hi) AS ap_hi_missing, COUNT(*) - COUNT(ap_lo) AS ap_lo_missing FROM cleaned""",
)
def clinical_cleaning(spark, sf_dir):
    df = C.null_inverted_pressure(C.null_implausible(D.subjects(spark, sf_dir)))
    gone = {"heights_missing": "height", "weights_missing": "weight", "ap_hi_missing": "ap_hi", "ap_lo_missing": "ap_lo"}
    return df.agg(F.count("*").alias("n"), *[(F.count("*") - F.count(c)).alias(n) for n, c in gone.items()])


for _band in ("bmi_class", "bp_group", "age_group"):

    def _band_query(spark, sf_dir, band=_band):
        df = C.add_clinical(D.subjects(spark, sf_dir))
        return df.groupBy(band).agg(F.count("*").alias("n"), r6(F.avg("cardio")).alias("prevalence"))

    register(
        f"clinical_{_band}",
        CLIN + f"SELECT {_band}, COUNT(*) AS n, round(AVG(cardio), 6) AS prevalence FROM clinical GROUP BY {_band}",
    )(_band_query)


@register(
    "clinical_code_labels",
    SUB + """SELECT CASE gender WHEN 1 THEN 'Female' WHEN 2 THEN 'Male' END AS gender,
                    CASE cholesterol WHEN 1 THEN 'Normal' WHEN 2 THEN 'Above normal' WHEN 3 THEN 'Well above normal' END AS cholesterol,
                    COUNT(*) AS n FROM subjects GROUP BY 1, 2""",
)
def clinical_code_labels(spark, sf_dir):
    df = D.subjects(spark, sf_dir).groupBy("gender", "cholesterol").agg(F.count("*").alias("n"))
    return df.select(
        C.label_of(F.col("gender"), C.GENDER_LABELS).alias("gender"), C.label_of(F.col("cholesterol"), C.LEVEL_LABELS).alias("cholesterol"), "n"
    )


# ---------------------------------------------------------------- encoding

_ENC_SQL = ", ".join(
    [f"CAST({c} AS DOUBLE) AS {c}" for c in S.NUMERIC + S.BINARY_NUMERIC]
    + [f"""COALESCE(({c} = {v})::INT, 0)::DOUBLE AS "{c}={v}\"""" for c in S.CATEGORICAL for v in S.CATEGORIES[c][1:]]
    + [f"({c} IS NULL)::INT::DOUBLE AS {c}__missing" for c in S.NUMERIC]
)


@register("encode_one_hot", SUB + f"SELECT record_id, {_ENC_SQL} FROM subjects")
def encode_one_hot(spark, sf_dir):
    return E.encode(D.subjects(spark, sf_dir), add_missing_indicators=True, keep=[S.ID])


@register(
    "encode_missing_indicators",
    SUB + "SELECT " + ", ".join(f"CAST(COUNT(*) - COUNT({c}) AS DOUBLE) AS {c}__missing" for c in S.NUMERIC) + " FROM subjects",
)
def encode_missing_indicators(spark, sf_dir):
    enc = E.encode(D.subjects(spark, sf_dir), add_missing_indicators=True)
    return enc.agg(*[F.sum(f"{c}__missing").alias(f"{c}__missing") for c in S.NUMERIC])


@register(
    "encode_layout_means",
    SUB + ", enc AS (SELECT " + _ENC_SQL + " FROM subjects) "
    + " UNION ALL ".join(
        f"""SELECT {i} AS position, '{n}' AS feature, round(AVG("{n}"), 6) AS mean FROM enc"""
        for i, n in enumerate(
            S.NUMERIC + S.BINARY_NUMERIC + [f"{c}={v}" for c in S.CATEGORICAL for v in S.CATEGORIES[c][1:]] + [f"{c}__missing" for c in S.NUMERIC]
        )
    ),
)
def encode_layout_means(spark, sf_dir):
    names = E.feature_names(add_missing_indicators=True)
    enc = E.encode(D.subjects(spark, sf_dir), add_missing_indicators=True)
    one = enc.agg(*[F.avg(F.col(f"`{n}`")).alias(n) for n in names])
    cells = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("feature"), r6(F.col(f"`{n}`")).alias("mean")) for i, n in enumerate(names)])
    return one.select(F.inline(cells))


_ANGLE = ["age_years", "bmi", "ap_hi", "ap_lo", "pulse_pressure", "map", "cholesterol", "gender", "smoke"]


@register(
    "encode_fixed_angles",
    CLIN + "SELECT record_id, " + ", ".join(
        f"round(CASE WHEN {c} IS NOT NULL THEN LEAST(1, GREATEST(0, ({c} - {lo}) / ({hi} - {lo})::DOUBLE)) * pi() END, 6) AS {c}"
        for c, (lo, hi) in ((c, E.angle_bounds(c)) for c in _ANGLE)
    ) + " FROM clinical",
)
def encode_fixed_angles(spark, sf_dir):
    df = E.fixed_angles(C.add_clinical(D.subjects(spark, sf_dir)), _ANGLE)
    return df.select(S.ID, *[r6(F.col(c)).alias(c) for c in _ANGLE])
