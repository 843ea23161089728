import pytest
from pyspark.sql import functions as F

from conftest import SF
from riskbench import schema as S
from riskbench.operators import splits as P
from riskbench.sources import driver_tables as D


def labels(spark, pos, neg):
    return spark.range(pos + neg).select(F.col("id").alias("record_id"), (F.col("id") < pos).cast("int").alias("cardio"))


@pytest.mark.parametrize("ranges", [False, True])
def test_stratified_folds(request, spark, ranges):
    if ranges:
        request.getfixturevalue("small_ranges")
    f = P.repeated_stratified_folds(labels(spark, 508, 410), "cardio", 5, 2)
    P.check_folds(f, "cardio")
    sizes = {(r["rep"], r["fold"], r["cardio"]): r["count"] for r in f.groupBy("rep", "fold", "cardio").count().collect()}
    assert [sizes[(0, i, 1)] for i in range(5)] == [102, 102, 102, 101, 101]
    assert [sizes[(1, i, 0)] for i in range(5)] == [82] * 5
    again = P.repeated_stratified_folds(labels(spark, 508, 410).repartition(3), "cardio", 5, 2)
    assert sorted(map(tuple, f.collect())) == sorted(map(tuple, again.collect()))
    other = P.repeated_stratified_folds(labels(spark, 508, 410), "cardio", 5, 2, seed=1)
    assert sorted(map(tuple, f.collect())) != sorted(map(tuple, other.collect()))


def test_ranges_give_the_same_folds(spark, monkeypatch):
    from riskbench.functions import ordering

    plain = P.repeated_stratified_folds(labels(spark, 508, 410), "cardio", 5, 2).collect()
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 40)
    ranged = P.repeated_stratified_folds(labels(spark, 508, 410), "cardio", 5, 2).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, ranged))


def test_published_fold_sizes(spark):
    f = D.folds(spark, SF).where("rep = 0")
    got = {r["fold"]: (r["n"], r["p"]) for r in f.groupBy("fold").agg(F.count("*").alias("n"), F.sum("cardio").alias("p")).collect()}
    assert [got[i] for i in range(5)] == [(301, 167), (300, 167), (300, 167), (300, 167), (299, 166)]


@pytest.mark.parametrize("ranges", [False, True])
def test_group_folds_with_a_hot_group(request, spark, ranges):
    """One group holds a third of the rows."""
    if ranges:
        request.getfixturevalue("small_ranges")
    df = spark.range(900).select(
        F.col("id").alias("record_id"),
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.floor(F.col("id") / 4)).cast("long").alias("group_id"),
        ((F.col("id") * 7919) % 10 < 4).cast("int").alias("cardio"),
    )
    f = P.repeated_group_folds(df, "cardio", "group_id", 5, 3)
    P.check_folds(f, "cardio", "group_id")
    assert f.count() == 2700
    m = P.fold_metadata(f, "cardio").collect()
    for rep in range(3):
        sizes = sorted(r["n_test"] for r in m if r["rep"] == rep)
        assert sizes[-1] == 300 and sizes[0] >= 140  # the rest is balanced around the hot group
    with pytest.raises(P.SplitError):
        P.repeated_group_folds(df.withColumn("group_id", F.lit(1)), "cardio", "group_id", 5, 1)


def test_small_group_split(spark):
    rows = [(i, i // 2, i % 2) for i in range(12)]
    df = spark.createDataFrame(rows, "record_id long, group_id long, cardio int")
    f = P.repeated_group_folds(df, "cardio", "group_id", 3, 2)
    P.check_folds(f, "cardio", "group_id")
    assert {r["n_test"] for r in P.fold_metadata(f, "cardio").collect()} == {4}


def test_feature_group_ids(spark):
    rows = [(1, None, 5), (2, 5, None), (3, 5, None)]
    df = spark.createDataFrame(rows, "record_id long, a int, b int").withColumn("g", P.feature_group(["a", "b"]))
    g = [r["g"] for r in df.orderBy("record_id").collect()]
    assert g[1] == g[2] and g[0] != g[1]


def test_leakage_counts(spark):
    rows = [(0, 0, "a"), (1, 1, "a"), (2, 0, "b"), (3, 0, "b"), (4, 1, "c")]
    f = spark.createDataFrame([(i, 0, fold, g) for i, fold, g in rows], "record_id long, rep int, fold int, group_id string")
    got = {r["fold"]: (r["crossing_groups"], r["affected_test_rows"]) for r in P.group_leakage(f, "group_id", 2).collect()}
    assert got == {0: (1, 1), 1: (1, 1)}
    assert P.group_isolation(f, "group_id").first()["split_groups"] == 1


def test_errors(spark):
    one = labels(spark, 5, 0)
    with pytest.raises(P.SplitError):
        P.repeated_stratified_folds(one, "cardio", 2, 1)
    with pytest.raises(P.SplitError):
        P.holdout(labels(spark, 5, 5), "cardio", 1.5)
    df = labels(spark, 4, 4).withColumn("cohort", F.lit(None).cast("string"))
    with pytest.raises(P.SplitError):
        P.cohort_holdout(df, "cohort", "cardio", ["x"])


def test_samples(spark, monkeypatch):
    df = labels(spark, 100, 200)
    a = sorted(r["record_id"] for r in P.sample(df, 50).collect())
    monkeypatch.setattr(P, "TOP_ROWS", 10)
    assert a == sorted(r["record_id"] for r in P.sample(df, 50).collect())
    b = P.balanced_sample(df, "cardio", 41).groupBy("cardio").count().collect()
    assert {r["cardio"]: r["count"] for r in b} == {1: 20, 0: 21}


def test_derived_seed(spark):
    import hashlib

    want = int.from_bytes(hashlib.sha256(b"7|split|3").digest()[:4], "big")
    assert spark.range(1).select(P.derive_seed(7, "split", 3).alias("s")).first()["s"] == want


def _by_sorting(rows, k, repeats):
    """(record_id, rep) -> fold, by sorting each class in the order of its draws."""
    import hashlib

    out = {}
    for rep in range(repeats):
        for c in (0, 1):
            key = lambda i: (hashlib.sha256(f"{S.BASE_SEED}|split|{k}|{rep}|{i}".encode()).hexdigest()[:16], i)  # noqa: E731, B023
            ids = sorted((i for i, y in rows if y == c), key=key)
            size, extra, at = len(ids) // k, len(ids) % k, 0
            for f in range(k):
                for i in ids[at : at + size + (f < extra)]:
                    out[(i, rep)] = f
                at += size + (f < extra)
    return out


@pytest.mark.parametrize("digits, most", [(3, 20_000), (1, 0), (2, 5), (3, 0)])
def test_folds_by_boundaries_as_by_sorting(spark, monkeypatch, digits, most):
    """However coarse the first histogram and however few rows may be collected, the folds are those of a full sort."""
    monkeypatch.setattr(P, "_DIGITS", digits)
    monkeypatch.setattr(P, "MOST_BOUNDARY", most)
    rows = [(i * 7, int(i % 3 == 0)) for i in range(401)]
    df = spark.createDataFrame([(i, y, f"x{i}") for i, y in rows], "record_id long, cardio int, other string").repartition(5)
    got = P.with_stratified_folds(df, "cardio", 4, 3)
    assert got.columns == ["record_id", "cardio", "other", "rep", "fold"]
    assert "Exchange" not in got.select("record_id", "rep", "fold")._jdf.queryExecution().executedPlan().toString().replace("Exchange RoundRobin", "")
    assert {(r["record_id"], r["rep"]): r["fold"] for r in got.collect()} == _by_sorting(rows, 4, 3)


@pytest.mark.parametrize("share, sizes", [(0.2, (101, 50)), (0.5, (3, 2)), (0.01, (40, 1)), (0.99, (7, 5))])
def test_holdout_by_boundaries(spark, share, sizes):
    df = spark.createDataFrame([(i, 0) for i in range(sizes[0])] + [(1000 + i, 1) for i in range(sizes[1])], "record_id long, cardio int")
    got = {r["cardio"]: (r["n"], r["t"]) for r in P.holdout(df, "cardio", share).groupBy("cardio").agg(F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect()}
    for c, n in enumerate(sizes):
        assert got[c] == (n, min(max(round(n * share), 1), n - 1))


def test_refused_targets(spark):
    for rows in ([(1, 0), (2, 2)], [(1, 1)], [(1, 0), (2, 1), (3, None)]):
        df = spark.createDataFrame(rows, "record_id long, cardio int")
        with pytest.raises(P.SplitError):
            P.repeated_stratified_folds(df, "cardio", 2, 1)
