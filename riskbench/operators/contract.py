"""Contract checks: required columns, domains, ranges, target, cross-field rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S
from ..functions.numbers import not_finite, sum_when
from ..functions.ordering import number_rows

# Inclusive bounds of a scoring request; age is in years here.
REQUEST_BOUNDS = {
    "age": (18, 120),
    "height": (100, 250),
    "weight": (20, 300),
    "ap_hi": (60, 250),
    "ap_lo": (30, 150),
    "smoke": (0, 1),
    "alco": (0, 1),
    "active": (0, 1),
    "gender": (1, 2),
    "cholesterol": (1, 3),
    "gluc": (1, 3),
}


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise S.ContractError(f"missing columns {missing}; found {df.columns}")


def reject_unknown_columns(df: DataFrame, allowed: Sequence[str]) -> None:
    extra = [c for c in df.columns if c not in allowed]
    if extra:
        raise S.ContractError(f"unexpected columns {extra}")


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Named columns in the given order; a missing one is an error."""
    require_columns(df, columns)
    return df.select(*columns)


def domain_violations(df: DataFrame, categories: dict[str, list[int]] | None = None) -> DataFrame:
    """(column, value, rows) of codes outside their domain, nulls allowed. One scan, all columns."""
    cats = categories or S.CATEGORIES
    bad = F.array(
        *[
            F.when(
                F.col(c).isNotNull() & ~F.col(c).isin(allowed),
                F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")),
            )
            for c, allowed in cats.items()
            if c in df.columns
        ]
    )
    return (
        df.select(F.explode(F.array_compact(bad)).alias("v"))
        .groupBy("v.column", "v.value")
        .agg(F.count("*").alias("rows"))
        .orderBy("column", "value")
    )


def target_violations(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """One row: null and non-binary targets."""
    t = F.col(target)
    return df.agg(
        sum_when(t.isNull()).cast("long").alias("null_targets"),
        sum_when(t.isNotNull() & ~t.isin(0, 1)).cast("long").alias("non_binary_targets"),
    )


def validate(df: DataFrame, require_target: bool = True) -> DataFrame:
    """Raise ContractError unless the table meets the contract; returns the table.

    One aggregation over the table; the offending values are only listed when there are some.
    """
    require_columns(df, S.ALL_COLUMNS if require_target else S.FEATURES)
    checks = [
        sum_when(F.col(c).isNotNull() & ~F.col(c).isin(allowed)).alias(c) for c, allowed in S.CATEGORIES.items()
    ]
    if require_target:
        t = F.col(S.TARGET)
        checks += [sum_when(t.isNull()).alias("_null"), sum_when(t.isNotNull() & ~t.isin(0, 1)).alias("_binary")]
    counts = df.agg(*checks).first().asDict()
    if any(counts[c] for c in S.CATEGORIES):
        some = domain_violations(df).limit(20).collect()
        raise S.ContractError(f"codes outside their domain: {[(r['column'], r['value'], r['rows']) for r in some]}")
    if require_target and counts["_null"]:
        raise S.ContractError(f"target {S.TARGET!r} is missing in {counts['_null']} rows")
    if require_target and counts["_binary"]:
        raise S.ContractError(f"target {S.TARGET!r} is not 0/1 in {counts['_binary']} rows")
    return df


def _reason(code: str, broken: Column) -> Column:
    return F.when(broken, F.lit(code))


def reject_reasons(df: DataFrame) -> DataFrame:
    """Add ``reasons``: the fields of a scoring request that break their range, and the pressure order."""
    checks = []
    for c, (lo, hi) in REQUEST_BOUNDS.items():
        checks.append(_reason(f"{c}_missing", F.col(c).isNull()))
        checks.append(_reason(f"{c}_range", ~F.col(c).between(lo, hi)))
    checks.append(_reason("pressure_order", F.col("ap_hi") < F.col("ap_lo")))
    return df.withColumn("reasons", F.array_compact(F.array(*checks)))


def accepted(df: DataFrame) -> DataFrame:
    return reject_reasons(df).where(F.size("reasons") == 0).drop("reasons")


def with_record_ids(df: DataFrame) -> DataFrame:
    """``df`` whose record ids tell all rows apart: its own where they do, else numbers of the rows by their content.

    Folds join and count by record id, so rows that repeat whole, or that come without ids, are numbered before anything else.
    """
    if S.ID in df.columns:
        missing = F.col(S.ID).isNull()
        if not df.groupBy(S.ID).count().where(missing | (F.col("count") > 1)).limit(1).count():
            return df
    return number_rows(df, S.ID, S.BASE_SEED)


def evaluation_input_checks(df: DataFrame, target: str, group: str | None = None, features: Sequence[str] = ()) -> DataFrame:
    """One row of counts that must be zero (except ``n``) before an evaluation starts."""
    t = F.col(target)
    per_id = df.groupBy(S.ID).agg(
        F.count("*").alias("_rows"),
        sum_when(t.isNull() | ~t.isin(0, 1)).alias("_target"),
        sum_when(F.col(group).isNull() if group else F.lit(False)).alias("_group"),
        *[sum_when(not_finite(F.col(c))).alias(f"_f_{c}") for c in features],
    )
    return per_id.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).cast("long").alias("n"),
        F.coalesce(F.sum(F.col("_rows") - 1), F.lit(0)).cast("long").alias("repeated_ids"),
        F.coalesce(F.sum("_target"), F.lit(0)).cast("long").alias("bad_targets"),
        F.coalesce(F.sum("_group"), F.lit(0)).cast("long").alias("missing_groups"),
        F.coalesce(sum((F.sum(f"_f_{c}") for c in features), F.lit(0)), F.lit(0)).cast("long").alias("non_finite_features"),
    )


def check_evaluation_input(df: DataFrame, target: str, group: str | None = None, features: Sequence[str] = ()) -> DataFrame:
    r = evaluation_input_checks(df, target, group, features).first().asDict()
    if r["n"] == 0:
        raise S.ContractError("no rows to evaluate")
    broken = {k: v for k, v in r.items() if k != "n" and v}
    if broken:
        raise S.ContractError(f"evaluation input is not usable: {broken}")
    return df


def non_finite_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, non_finite) with one scan."""
    row = df.agg(*[sum_when(not_finite(F.col(c))).cast("long").alias(c) for c in columns])
    return row.unpivot([], list(columns), "column", "non_finite")


def require_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    bad = {r["column"]: r["non_finite"] for r in non_finite_counts(df, columns).collect() if r["non_finite"]}
    if bad:
        raise S.ContractError(f"non-finite values: {bad}")
    return df
