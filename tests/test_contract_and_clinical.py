import math

import pytest
from pyspark.sql import functions as F

from riskbench import schema as S
from riskbench.functions import clinical as C, encoding as E
from riskbench.operators import audit as A, contract as V
from riskbench.plans import experiments as X
from riskbench.sources import clinical_csv as CSV, result_files as RF


def subjects(spark, rows):
    cols = ["record_id", "age", "height", "weight", "ap_hi", "ap_lo", "smoke", "alco", "active", "gender", "cholesterol", "gluc", "cardio"]
    types = {f.name: f.dataType.simpleString() for f in S.CLINICAL_SCHEMA}
    return spark.createDataFrame(rows, ", ".join(f"{c} {types[c]}" for c in cols))


GOOD = (1, 18393, 168.0, 62.0, 110.0, 80.0, 0, 0, 1, 2, 1, 1, 0)


def changed(**kw):
    cols = ["record_id", "age", "height", "weight", "ap_hi", "ap_lo", "smoke", "alco", "active", "gender", "cholesterol", "gluc", "cardio"]
    return tuple(kw.get(c, v) for c, v in zip(cols, GOOD))


def test_derived_columns(spark):
    r = C.add_clinical(subjects(spark, [GOOD])).first()
    assert math.isclose(r["bmi"], 21.9671, abs_tol=1e-4) and r["pulse_pressure"] == 30 and r["map"] == 90
    r = C.add_clinical(subjects(spark, [changed(ap_hi=90.0, ap_lo=110.0)])).first()
    assert r["ap_hi"] is None and r["ap_lo"] is None and r["map"] is None
    r = C.add_clinical(subjects(spark, [changed(height=75.0, weight=10.0)])).first()
    assert r["height"] is None and r["weight"] is None and r["bmi_class"] is None
    assert spark.range(1).select(C.age_years_to_days(F.lit(18)).alias("d")).first()["d"] == 6574


def test_bands_are_left_closed(spark):
    df = spark.createDataFrame([(v,) for v in (119.0, 120.0, 180.0, None)], "v double")
    assert [r[0] for r in df.select(C.band(F.col("v"), C.BP_GROUP)).collect()] == ["normal", "elevated", "crisis", None]


def test_validate(spark):
    V.validate(subjects(spark, [GOOD, changed(gender=None)]))
    for bad in (dict(gender=3), dict(cardio=None), dict(cardio=2)):
        with pytest.raises(S.ContractError):
            V.validate(subjects(spark, [GOOD, changed(**bad)]))
    with pytest.raises(S.ContractError, match="gluc"):
        V.validate(subjects(spark, [GOOD]).drop("gluc"))
    with pytest.raises(S.ContractError):
        V.reject_unknown_columns(subjects(spark, [GOOD]), ["age"])


def test_evaluation_input(spark):
    df = subjects(spark, [GOOD, changed(record_id=2)])
    V.check_evaluation_input(df, "cardio")
    for bad in (df.unionByName(df), df.withColumn("cardio", F.lit(None).cast("int")), df.limit(0)):
        with pytest.raises(S.ContractError):
            V.check_evaluation_input(bad, "cardio")
    with pytest.raises(S.ContractError):
        V.require_finite(df.withColumn("height", F.lit(float("nan"))), ["height"])


def test_encoding_layout(spark):
    names = E.feature_names()
    assert names[:8] == S.NUMERIC + S.BINARY_NUMERIC and len(names) == 18
    r = E.encode(subjects(spark, [changed(cholesterol=None, gluc=3, height=None)]), True).first().asDict()
    assert r["cholesterol=2"] == r["cholesterol=3"] == 0.0 and r["gluc=3"] == 1.0 and r["height__missing"] == 1.0
    with pytest.raises(S.ContractError):
        E.angle_bounds("unheard_of")


def test_delimited_source(spark, tmp_path):
    head = "id;" + ";".join(S.ALL_COLUMNS)
    (tmp_path / "a.csv").write_text(head + "\n1;18393;168;62;110;80;0;0;1;2;1;1;0\n2;18393;abc;;110;80;0;0;1;2;1;1;1\n")
    rows = CSV.load(spark, "clinical_csv", str(tmp_path / "a.csv")).orderBy("record_id").collect()
    assert rows[1]["height"] is None and rows[1]["weight"] is None and rows[1]["cardio"] == 1
    (tmp_path / "b.csv").write_text("id;age\n1;2\n")
    with pytest.raises(S.ContractError, match="height"):
        CSV.load_delimited(spark, str(tmp_path / "b.csv"))
    (tmp_path / "c.csv").write_text(head + "\n1;18393;168;62;110;80;0;0;1;2;1;1;yes\n")
    with pytest.raises(S.ContractError):
        CSV.load_delimited(spark, str(tmp_path / "c.csv"))
    with pytest.raises(KeyError, match="clinical_csv"):
        CSV.load(spark, "nowhere", "x")


def test_rows_without_unique_ids_are_numbered(spark, tmp_path, monkeypatch):
    """Whole rows repeated, ids and all, and a file without ids: each row gets an id of its own, the same for any layout."""
    from riskbench.functions import ordering as O

    head, line = ";".join(S.ALL_COLUMNS), "18393;168;62;110;80;0;0;1;2;1;1;0"
    other = "18394;;62;110;80;0;0;1;2;1;1;1"
    lines = [line] * 30 + [other, other, "18395;170;62;110;80;0;0;1;2;1;1;1"]
    (tmp_path / "none.csv").write_text("\n".join([head, *lines]) + "\n")
    (tmp_path / "twice.csv").write_text("\n".join(["id;" + head, *(f"{7 if x == line else i};{x}" for i, x in enumerate(lines))]) + "\n")
    (tmp_path / "turned.csv").write_text("\n".join([head, *lines[::-1]]) + "\n")
    plain = sorted(map(tuple, CSV.load_delimited(spark, str(tmp_path / "none.csv")).collect()))
    assert [r[0] for r in plain] == list(range(1, 34))
    for name in ("twice.csv", "turned.csv"):
        assert sorted(map(tuple, CSV.load_delimited(spark, str(tmp_path / name)).collect())) == plain
    monkeypatch.setattr(O, "COPIES_PER_BLOCK", 4)  # the thirty copies are written out in eight blocks
    blocks = O.number_rows(CSV.load_delimited(spark, str(tmp_path / "none.csv")), S.ID, S.BASE_SEED, rows_per_range=3)
    assert sorted(map(tuple, blocks.select(S.ID, *S.ALL_COLUMNS).collect())) == plain
    assert O.number_rows(spark.createDataFrame([], "a int"), "n").count() == 0
    own = subjects(spark, [changed()])
    assert V.with_record_ids(own) is own


def test_repeated_rows_are_evaluated(spark, tmp_path):
    """Planted whole-row copies pass load, folds and a fit per fold, each row once."""
    from riskbench.operators import splits as P
    from riskbench.plans import harness as H, models as MD

    planted = X.clinical_like(spark, 200).toPandas()
    planted["id"] = planted["record_id"].where(planted.index % 50 != 0, 1)  # some ids stand for several rows, too
    planted[["id", *S.ALL_COLUMNS]].to_csv(tmp_path / "planted.csv", sep=";", index=False)
    df = CSV.load(spark, "clinical_csv", str(tmp_path / "planted.csv"))
    assert df.count() == df.select(S.ID).distinct().count() == len(planted)
    led = H.evaluate({"logreg": MD.build("logreg")}, df, "cardio", P.repeated_stratified_folds(df, "cardio", 2, 1), 0.5)
    assert sum(r["n"] for r in led.collect()) == len(planted)


def test_audit_of_planted_traps(spark, tmp_path):
    df = X.clinical_like(spark, 200)
    d = A.duplicate_summary(A.feature_groups(df)).first()
    assert (d["n"], d["exact_rows"], d["feature_identical_rows"], d["contradictory_groups"], d["contradictory_rows"]) == (203, 2, 3, 1, 2)
    assert d["label_noise_ceiling"] == round(202 / 203, 4)
    m = {r["column"]: r["missing"] for r in A.missing(df).collect()}
    assert m["height"] == m["weight"] == m["ap_hi"] == m["ap_lo"] == 1
    codes = {r["code"] for r in A.warnings(df).collect()}
    assert {"exact_duplicates", "contradictory_rows", "majority_floor"} <= codes and "high_missing" not in codes
    report = A.audit(df)
    text = RF.write_audit(report, str(tmp_path / "audit"))
    back = RF.read_audit(spark, str(tmp_path / "audit"))
    assert back.count() == report.count() and "majority_class_accuracy" in text


def test_processed_cache(spark, tmp_path):
    df, path = subjects(spark, [GOOD]), str(tmp_path / "p")
    CSV.cache_processed(df, path)
    assert CSV.cache_processed(df.unionByName(df), path).count() == 1
    assert CSV.cache_processed(df.unionByName(df), path, force=True).count() == 2
