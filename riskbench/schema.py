"""The fixed contract of the clinical table."""

from __future__ import annotations

from pyspark.sql import types as T

# Column roles, category domains, plausible ranges and candidate features.
TARGET = "cardio"
NUMERIC = ["age", "height", "weight", "ap_hi", "ap_lo"]
BINARY_NUMERIC = ["smoke", "alco", "active"]
CATEGORICAL = ["gender", "cholesterol", "gluc"]
FEATURES = NUMERIC + BINARY_NUMERIC + CATEGORICAL
ALL_COLUMNS = FEATURES + [TARGET]
CATEGORIES = {"gender": [1, 2], "cholesterol": [1, 2, 3], "gluc": [1, 2, 3]}
PLAUSIBLE = {
    "age": (3650, 36500),
    "height": (100, 250),
    "weight": (20, 300),
    "ap_hi": (60, 250),
    "ap_lo": (30, 150),
}
CANDIDATE_FEATURES = [
    "age_years", "bmi", "ap_hi", "ap_lo", "pulse_pressure", "map",
    "cholesterol", "gluc", "active", "gender", "smoke", "alco",
]
SUBGROUP_KEYS = ["gender", "age_group"]
BASE_SEED = 20260830
# End of fixed values.

ID = "record_id"

CLINICAL_SCHEMA = T.StructType(
    [T.StructField(ID, T.LongType())]
    + [T.StructField(c, T.DoubleType() if c in NUMERIC[1:] else T.IntegerType()) for c in FEATURES]
    + [T.StructField(TARGET, T.IntegerType())]
)


class ContractError(ValueError):
    """A table breaks the contract."""
