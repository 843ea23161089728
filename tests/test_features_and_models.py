import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from riskbench import schema as S
from riskbench.functions import clinical as C
from riskbench.operators import crosses as X, selection as SEL, similarity as N
from riskbench.plans import experiments as E, harness as H, models as MD, scoring as SC, stages as ST
from riskbench.sources import driver_tables as D


def test_greedy_rules():
    mi = {"ap_hi": 0.5, "map": 0.49, "bmi": 0.1, "age_years": 0.1}
    rho = {("ap_hi", "map"): 0.95, ("ap_hi", "bmi"): 0.0, ("ap_hi", "age_years"): 0.0, ("map", "bmi"): 0, ("map", "age_years"): 0, ("bmi", "age_years"): 0}
    assert [f for f, _ in SEL.greedy(mi, rho, 3, 0.5)] == ["ap_hi", "age_years", "bmi"]
    assert [f for f, _ in SEL.greedy(mi, rho, 2, 0.0)] == ["ap_hi", "map"]
    with pytest.raises(ValueError):
        SEL.greedy(mi, rho, 0, 0.5)


def test_hot_values_and_ranges_give_the_same_correlations(spark, monkeypatch):
    from riskbench.functions import ordering

    df = C.add_clinical(D.subjects(spark, SF)).join(D.folds(spark, SF, 3, 1).drop("cardio"), S.ID)
    names = ["ap_hi", "bmi", "smoke"]
    plain = {(r["fold"], r["a"], r["b"]): r["rho"] for r in SEL.train_spearman(df, names, "cardio", 3).collect()}
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 100)
    monkeypatch.setattr(SEL, "HOT_SHARE", 10)
    ranged = {(r["fold"], r["a"], r["b"]): r["rho"] for r in SEL.train_spearman(df, names, "cardio", 3).collect()}
    assert plain.keys() == ranged.keys() and all(math.isclose(plain[k], ranged[k], abs_tol=1e-9) for k in plain)


def test_rank_correlation_looks_ranks_up_without_shuffling_rows(spark, monkeypatch):
    """Joined, in one pass and in a pass a repeat: the same, missing values and a repeated id too; no task is handed the rows by id."""
    import re

    from riskbench.operators import selection as SEL

    rows = [(i, i % 2, rep, i * (rep + 1) % 3, float(i % 7) if i % 5 else None, float(i * i % 11), 1.0) for i in [7, 11, *range(60)] for rep in range(2)]
    df = spark.createDataFrame(rows, "record_id long, y int, rep int, fold int, a double, b double, c double")
    names, seen = ["a", "b", "c"], {}
    for most in (10**6, 60, 0):
        monkeypatch.setattr(SEL, "MOST_RANKS", most)
        seen[most] = {(r["rep"], r["fold"], r["a"], r["b"]): r["rho"] for r in SEL.train_spearman(df, names, "y", 3).collect()}
    assert len(seen[0]) == 2 * 3 * 3 and max(seen[0].values()) > 0.1
    for most in (10**6, 60):
        assert seen[most].keys() == seen[0].keys() and all(math.isclose(seen[most][k], v, abs_tol=1e-12) for k, v in seen[0].items())
    once = spark.createDataFrame(rows[4:], df.schema)
    plan = SEL._merged(once, names, 0)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange|Join", plan)


def test_chain_subsets():
    assert X.closed_chain(3, 4) == [] and X.closed_chain(3, 3) == [(0, 1, 2)]
    assert X.closed_chain(4, 2) == [(0, 1), (1, 2), (2, 3), (3, 0)]
    assert len(X.chain_subsets(8)) == 24 and X.chain_names(4)[4] == "x0*x1"


def test_permutation_keeps_the_values(spark):
    df = spark.createDataFrame([(i, i * 0.1) for i in range(12)], "position int, coupling double")
    a, b = X.permuted(df, 1), X.permuted(df, 2)
    assert sorted(r["coupling"] for r in a.collect()) == sorted(r["coupling"] for r in df.collect())
    assert [r["coupling"] for r in a.orderBy("position").collect()] != [r["coupling"] for r in b.orderBy("position").collect()]


def test_pairwise_information_of_equal_columns(spark):
    df = spark.createDataFrame([(i % 2, i % 2, (i // 2) % 2) for i in range(8)], "a int, b int, c int")
    mi = {(r["a"], r["b"]): r["mi"] for r in X.pairwise_information(df, ["a", "b", "c"], normalise=False).collect()}
    assert math.isclose(mi[("a", "b")], math.log(2)) and abs(mi[("a", "c")]) < 1e-12


def test_similarity_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 5))
    lab = rng.integers(0, 3, 40)
    df = spark.createDataFrame([(i, [float(x) for x in r], int(c)) for i, (r, c) in enumerate(zip(v, lab))], "id long, v array<double>, c int").repartition(4)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    k = (u @ u.T) ** 2
    for r in N.row_sums(df, "id", "v", "c").collect():
        assert math.isclose(r["similarity_sum"], k[r["id"]][lab == r["against"]].sum())
    t = N.total_similarity(df, "v").first()
    assert math.isclose(t["mean_similarity"], (k.sum() - 40) / (40 * 39))
    pairs = spark.createDataFrame([(0, 1), (3, 3), (7, 2)], "i long, j long")
    got = {(r["i"], r["j"]): r["similarity"] for r in N.pair_similarity(df, pairs, "id", "v").collect()}
    assert math.isclose(got[(0, 1)], k[0, 1]) and got[(3, 3)] == 1.0
    with pytest.raises(Exception, match="zero vector"):
        N.normalised(df.withColumn("v", F.array(F.lit(0.0))), "v").collect()
    assert N.content_key(df, "id", "v") == N.content_key(df.repartition(1), "id", "v") != N.content_key(df.limit(39), "id", "v")


def test_budget():
    assert N.guard_pairs(2000) is None and "3" in N.guard_pairs(3, 2, hard=False)
    with pytest.raises(N.BudgetError):
        N.guard_pairs(2001)


@pytest.fixture(scope="module")
def rows(spark):
    return D.subjects(spark, SF).drop("cents")


def test_ridge_logistic_optimum(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    y = (x @ [1.0, -2.0] + rng.logistic(size=300) > 0).astype(int)
    df = spark.createDataFrame([(int(b), float(a[0]), float(a[1])) for a, b in zip(x, y)], "cardio int, a double, b double")
    from pyspark.ml.feature import VectorAssembler

    m = ST.RidgeLogistic(C=0.5).fit(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df))
    w, c = m.coefficients.toArray(), m.intercept
    r = 1 / (1 + np.exp(-(x @ w + c))) - y  # gradient of loss + |w|^2 / (2 C) vanishes
    assert np.allclose(x.T @ r + w / 0.5, 0, atol=1e-3) and abs(r.sum()) < 1e-3


def test_harness_and_bundle(spark, rows, tmp_path):
    f = D.folds(spark, SF, 2, 1)
    led = H.evaluate({"logreg": MD.build("logreg", k=4)}, rows, "cardio", f, "train", {"folds": 2}).collect()
    assert len(led) == 2 and all(r["roc_auc"] > 0.75 and r["n_trainable_params"] == 5 and r["n"] + r["n_train"] == 1500 for r in led)
    with pytest.raises(S.ContractError):
        H.evaluate({"logreg": MD.build("logreg", k=4)}, rows, "cardio", f.where("record_id > 10"))
    fitted = MD.product_control(k=4).fit(rows)
    SC.save_bundle(fitted, str(tmp_path / "m"))
    again = SC.load_bundle([str(tmp_path / "none"), str(tmp_path / "m")])
    req = rows.where("height > 100 and ap_hi >= ap_lo and weight is not null").withColumn("age", F.lit(50)).drop("cardio")
    scored, rejected = SC.score(req, again)
    assert scored.count() + rejected.count() == req.count() and rejected.count() == 0
    assert scored.where("risk_probability between 0 and 1 and risk_percentage between 0 and 100").count() == req.count()
    with pytest.raises(SC.BundleError):
        SC.load_bundle([str(tmp_path / "none")])
    with pytest.raises(S.ContractError):
        SC.score(req.withColumn("extra", F.lit(1)), again)
    with pytest.raises(KeyError):
        MD.build("nothing")


def test_shared_representations_equal_fits_per_fold(spark, rows):
    f = D.folds(spark, SF, 3, 1)
    shared = ST.fit_representations(rows, "cardio", f, 3, 5)
    train = rows.join(f.where("fold <> 1").select(S.ID), S.ID)
    one = ST.ClinicalRepresentation(k=5).fit(train)
    for name in ("features", "medians", "means", "sds"):
        a, b = one.getOrDefault(name), shared[(0, 1)].getOrDefault(name)
        assert a == b if name == "features" else np.allclose(a, b)
    with pytest.raises(ValueError):
        MD.logreg(k=4, representation=shared[(0, 1)])


def test_spike_identity_and_degradation(spark, rows):
    assert E.spike(rows, None, "height", "age", 0.0) is rows
    from riskbench.operators import metrics as M

    pred = rows.select(S.ID, F.col("cardio").alias("y"), F.lit(1.0).alias("p"))
    c = E.degradation_curve(pred, lambda d, by: M.with_rates(M.confusion(d, by), ["accuracy"]), "accuracy", grid=(10, 100), repeats=2)
    assert [(r["size"], r["repeats"]) for r in c.orderBy("size").collect()] == [(10, 2), (100, 2)]


def test_synthetic_tables(spark):
    u = E.uniform_features(spark, 50).agg(F.min("x0").alias("a"), F.max("x7").alias("b")).first()
    assert 0 <= u["a"] and u["b"] <= math.pi
    g = spark.range(4000).select(E.gaussian(1, F.col("id")).alias("g")).agg(F.avg("g").alias("m"), F.stddev("g").alias("s")).first()
    assert abs(g["m"]) < 0.05 and abs(g["s"] - 1) < 0.05
    df = E.label_by_median(E.uniform_features(spark, 101).withColumn("signal", E.latent("pairwise", [f"x{i}" for i in range(8)])), "signal", 0.35, 0)
    assert df.agg(F.sum("label")).first()[0] == 50
