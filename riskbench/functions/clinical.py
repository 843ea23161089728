"""Derived clinical columns. Nothing here is learned from data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import PLAUSIBLE

# Band edges (left-closed) and labels.
BMI_CLASS = ([18.5, 25.0, 30.0], ["underweight", "normal", "overweight", "obese"])
BP_GROUP = ([120, 130, 140, 180], ["normal", "elevated", "stage1", "stage2", "crisis"])
AGE_GROUP = ([40, 50, 60, 70], ["young", "middle", "older", "senior", "elderly"])
BMI_BOUNDS = (10, 80)
DAYS_PER_YEAR = 365.25
GENDER_LABELS = {1: "Female", 2: "Male"}
LEVEL_LABELS = {1: "Normal", 2: "Above normal", 3: "Well above normal"}
# End of fixed values.


def band(c: Column, edges_and_labels: tuple[list, list[str]]) -> Column:
    """Label of the left-closed band that holds the value; NULL stays NULL."""
    edges, labels = edges_and_labels
    chain = F.when(c < edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:-1]):
        chain = chain.when(c < edge, label)
    return chain.when(c >= edges[-1], labels[-1])


def null_implausible(df: DataFrame) -> DataFrame:
    """Measurements outside their inclusive range become missing."""
    return df.withColumns(
        {c: F.when(F.col(c).between(*PLAUSIBLE[c]), F.col(c)) for c in ("height", "weight", "ap_hi", "ap_lo")}
    )


def null_inverted_pressure(df: DataFrame) -> DataFrame:
    """Both pressures become missing where the systolic one is below the diastolic one."""
    inverted = F.coalesce(F.col("ap_hi") < F.col("ap_lo"), F.lit(False))
    return df.withColumns({c: F.when(~inverted, F.col(c)) for c in ("ap_hi", "ap_lo")})


def bmi(weight: Column, height: Column) -> Column:
    metres = height / 100.0
    value = F.try_divide(weight, metres * metres)
    return F.when(value.between(*BMI_BOUNDS), value)


def add_clinical(df: DataFrame) -> DataFrame:
    """Canonical columns plus age_years, bmi, pulse_pressure, map and the three bands."""
    hi, lo = F.col("ap_hi"), F.col("ap_lo")
    derived = null_inverted_pressure(null_implausible(df)).withColumns(
        {
            "age_years": F.col("age") / F.lit(DAYS_PER_YEAR),
            "bmi": bmi(F.col("weight"), F.col("height")),
            "pulse_pressure": hi - lo,
            "map": lo + (hi - lo) / 3.0,
        }
    )
    return derived.withColumns(
        {
            "bmi_class": band(F.col("bmi"), BMI_CLASS),
            "bp_group": band(hi, BP_GROUP),
            "age_group": band(F.col("age_years"), AGE_GROUP),
        }
    )


def age_group_or_unknown(age_days: Column) -> Column:
    """Age band as the audit reports it: a missing age is its own level."""
    return F.coalesce(band(age_days / F.lit(DAYS_PER_YEAR), AGE_GROUP), F.lit("unknown"))


def label_of(code: Column, labels: dict[int, str]) -> Column:
    chain = None
    for k, v in labels.items():
        chain = F.when(code == k, v) if chain is None else chain.when(code == k, v)
    return chain


def age_years_to_days(age: Column) -> Column:
    """Whole days, ties to even."""
    return F.bround(age * F.lit(DAYS_PER_YEAR)).cast("int")
