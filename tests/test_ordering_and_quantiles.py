import numpy as np
import pytest
from pyspark.sql import functions as F

from riskbench.functions import ordering as O
from riskbench.operators import fold_stats as FS, quantiles as Q


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(7)
    v = np.where(rng.random(900) < 0.33, 5.0, np.round(rng.lognormal(1, 1.5, 900), 2))
    g = rng.integers(0, 2, 900)
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, v)], "g int, v double"), g, v


@pytest.mark.parametrize("ranges", [False, True])
def test_quantiles_match_numpy(request, spark, values, ranges):
    if ranges:
        request.getfixturevalue("small_ranges")
    df, g, v = values
    probs = [0.0, 0.125, 0.5, 0.77, 1.0]
    for r in Q.exact_quantiles(df, ["g"], "v", probs).collect():
        assert np.allclose([r[f"q{i}"] for i in range(5)], np.quantile(v[g == r["g"]], probs), rtol=1e-12)
    whole = Q.exact_quantiles(df, [], "v", [0.5]).first()
    assert whole["q0"] == np.median(v)


def test_cuts_cover_hot_values(spark, values, small_ranges):
    df, g, v = values
    cuts = {r["g"]: r["_cuts"] for r in O.fit_cuts(df, ["g"], "v").collect()}
    assert set(cuts) == {0, 1}
    assert all(len(c) > 5 and c == sorted(set(c)) for c in cuts.values())
    assert O.fit_cuts(df, ["g"], "v", row_bound=30) is None


def test_two_step_range_equals_plain_count(spark):
    cuts = [float(i) for i in range(300)]
    df = spark.range(0, 620).select((F.col("id") / 2.0).alias("x")).withColumn("c", F.array(*[F.lit(c) for c in cuts]))
    out = df.select("x", O._range_of(F.col("c"), F.col("x")).alias("r")).collect()
    assert all(r["r"] == sum(c < r["x"] for c in cuts) for r in out)


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_in_ranges(spark, values, descending):
    df, g, v = values
    d = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    plain = O.running_sums(d, ["g"], "v", ["n"], descending)
    cuts = O.fit_cuts(df, ["g"], "v", rows_per_range=25)
    ranged = O.running_sums(d, ["g"], "v", ["n"], descending, cuts).select(*plain.columns)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, ranged.collect()))


def test_rank_by_draw_in_ranges(spark):
    df = spark.range(1000).select(F.col("id").alias("record_id"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    df = df.withColumn("_draw", O.draw_key(1, "t", F.col("record_id")))
    plain = O.rank_by_draw(df, ["y"], "_draw", "record_id", 1000)
    ranged = O.rank_by_draw(df, ["y"], "_draw", "record_id", 1000, rows_per_range=60).select(*plain.columns)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, ranged.collect()))


@pytest.mark.parametrize("ranges", [False, True])
def test_training_statistics_are_fold_local(request, spark, ranges):
    if ranges:
        request.getfixturevalue("small_ranges")
    rng = np.random.default_rng(3)
    n, k = 400, 4
    fold = rng.integers(0, k, n)
    x = np.round(rng.normal(size=n) * 10, 1)
    null = rng.random(n) < 0.1
    y = rng.integers(0, 2, n)

    def table(xs):
        rows = [(i, 0, int(fold[i]), int(y[i]), None if null[i] else float(xs[i])) for i in range(n)]
        return spark.createDataFrame(rows, "record_id long, rep int, fold int, cardio int, x double")

    df = table(x)
    med = {r["fold"]: r["median"] for r in FS.train_medians(df, ["x"], k).collect()}
    mom = {r["fold"]: r for r in FS.train_moments(df, ["x"], k, FS.train_medians(df, ["x"], k)).collect()}
    for f in range(k):
        tr = (fold != f) & ~null
        m = np.median(x[tr])
        filled = np.where(null, m, x)[fold != f]
        assert np.isclose(med[f], m)
        assert np.isclose(mom[f]["mean"], filled.mean()) and np.isclose(mom[f]["sd"], filled.std())
    changed = np.where(fold == 1, 1e6, x)
    again = {r["fold"]: r["median"] for r in FS.train_medians(table(changed), ["x"], k).collect()}
    assert again[1] == med[1] and again[0] != med[0]


def test_cuts_grow_with_rows_not_with_the_largest_group(spark):
    """One large and many medium groups: at most one cut per range, and one more per group."""
    large = spark.range(40_000).select(F.lit(0).alias("g"), "id")
    medium = spark.range(20_000).select((1 + F.col("id") % 10).cast("int").alias("g"), "id")
    cuts = O.fit_cuts(large.unionByName(medium), ["g"], "id", rows_per_range=1000)
    per_group = {r["g"]: len(r["_cuts"]) for r in cuts.collect()}
    assert sum(per_group.values()) <= 60_000 / 1000 + len(per_group)
    assert len(per_group) == 11 and per_group[0] >= 39 and per_group[1] >= 2


def test_cache_hits_on_its_default_folder(spark):
    import uuid

    from riskbench.operators import similarity as N

    name = f"test-{uuid.uuid4().hex}"
    assert N.cached(spark.range(3), name).count() == 3
    assert N.cached(spark.range(5), name).count() == 3  # there already: nothing is written again
