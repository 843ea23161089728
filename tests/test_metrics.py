import math

import pytest
from pyspark.sql import functions as F

from riskbench.operators import metrics as M


def frame(spark, y, p):
    return spark.createDataFrame([(i, a, float(b)) for i, (a, b) in enumerate(zip(y, p))], "record_id long, y int, p double")


def one(df):
    return df.first().asDict()


def test_confusion_and_rates(spark):
    df = frame(spark, [1, 1, 1, 1, 0, 0, 0, 0], [0.9, 0.8, 0.4, 0.3, 0.7, 0.6, 0.2, 0.1])
    c = one(M.with_rates(M.confusion(df, [])))
    assert (c["tn"], c["fp"], c["fn"], c["tp"]) == (2, 2, 2, 2)
    assert c["sensitivity"] == c["specificity"] == c["f1"] == 0.5
    assert c["mcc"] == c["kappa"] == c["youden_j"] == 0.0


@pytest.mark.parametrize(
    "y, p, auc",
    [
        ([0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8], 0.75),
        ([0, 1, 0, 1], [0.5, 0.5, 0.5, 0.5], 0.5),
        ([1, 1, 1], [0.1, 0.2, 0.3], None),
    ],
)
def test_roc_auc(spark, y, p, auc):
    assert one(M.roc_auc(frame(spark, y, p), []))["roc_auc"] == auc


def test_average_precision(spark):
    assert math.isclose(one(M.average_precision(frame(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8]), []))["pr_auc"], 5 / 6)
    assert one(M.average_precision(frame(spark, [0, 0], [0.1, 0.4]), []))["pr_auc"] is None


def test_calibration(spark):
    assert math.isclose(one(M.brier(frame(spark, [1, 0], [0.8, 0.3]), []))["brier"], (0.04 + 0.09) / 2)
    assert one(M.ece(frame(spark, [1, 0], [1.0, 0.0]), []))["ece"] == 0.0
    assert one(M.ece(frame(spark, [0, 1], [1.0, 0.0]), []))["ece"] == 1.0
    bins = {r["p"]: r["b"] for r in frame(spark, [0] * 5, [0.0, 0.1, 0.1000001, 0.3, 1.0]).select("p", M.calibration_bin(F.col("p")).alias("b")).collect()}
    assert bins == {0.0: 0, 0.1: 0, 0.1000001: 1, 0.3: 2, 1.0: 9}


def test_thresholds_with_ties(spark):
    df = frame(spark, [1, 0, 1, 0], [0.9, 0.9, 0.4, 0.1])
    assert one(M.best_youden_threshold(df, []))["threshold"] == 0.4
    assert one(M.best_youden_threshold(frame(spark, [1, 0, 1, 0], [0.2, 0.2, 0.8, 0.8]), []))["threshold"] == 0.2
    assert one(M.threshold_at_sensitivity(df, [], 0.5))["threshold"] == 0.9
    assert one(M.threshold_at_sensitivity(df, [], 0.9))["threshold"] == 0.4
    assert one(M.threshold_at_sensitivity(frame(spark, [0, 0], [0.2, 0.3]), [], 0.9))["threshold"] == 0.2


def test_aggregate(spark):
    df = spark.createDataFrame([("m", 0.8), ("m", 0.9), ("m", 0.7), ("m", None)], "model string, accuracy double")
    a = one(M.aggregate(df, ["model"], ["accuracy"]))
    assert math.isclose(a["mean"], 0.8) and math.isclose(a["sd"], 0.1) and a["n_folds"] == 3 and a["max"] == 0.9


def brute(rows):
    """Definitions over plain lists."""
    y, p = rows["y"].tolist(), rows["p"].tolist()
    pos, neg = sum(y), len(y) - sum(y)
    pairs = sum((a > b) + 0.5 * (a == b) for a, ya in zip(p, y) if ya for b, yb in zip(p, y) if not yb)
    ap, tp, n = 0.0, 0, 0
    for s in sorted(set(p), reverse=True):
        hit = [a for a, q in zip(y, p) if q == s]
        tp, n = tp + sum(hit), n + len(hit)
        ap += sum(hit) / pos * tp / n
    best = (-9.0, None)
    for s in sorted(set(p)):
        j = sum(1 for a, q in zip(y, p) if a and q >= s) / pos + sum(1 for a, q in zip(y, p) if not a and q < s) / neg - 1
        best = max(best, (j, -s))
    return pairs / pos / neg, ap, -best[1]


@pytest.mark.parametrize("ranges", [False, True])
def test_summary_against_definitions(request, spark, scored, ranges):
    if ranges:
        request.getfixturevalue("small_ranges")
    df, rows = scored
    s = {r["g"]: r for r in M.summary(df, ["g"]).collect()}
    t = {r["g"]: r["threshold"] for r in M.best_youden_threshold(df, ["g"]).collect()}
    for g in (0, 1):
        auc, ap, thr = brute(rows[rows["g"] == g])
        assert math.isclose(s[g]["roc_auc"], auc, rel_tol=1e-9)
        assert math.isclose(s[g]["pr_auc"], ap, rel_tol=1e-9)
        assert t[g] == thr


def test_bootstrap(spark, scored):
    df, rows = scored
    ci = one(M.bootstrap_ci(df, [], n_boot=400))
    at = one(M.with_rates(M.confusion(df, []), ["sensitivity"]))["sensitivity"]
    half = 1.96 * math.sqrt(at * (1 - at) / rows["y"].sum())
    assert ci["n_boot_used"] == 400
    assert abs(ci["ci_low"] - (at - half)) < half / 2 and abs(ci["ci_high"] - (at + half)) < half / 2
    assert one(M.bootstrap_ci(df, [], n_boot=400)) == ci
    for wrong in ("logloss", ""):
        with pytest.raises(ValueError):
            M.bootstrap_ci(df, [], wrong)


def by_rows(y, p):
    """Metrics of rows, each by its definition."""
    import numpy as np

    pos, neg = p[y == 1], p[y == 0]
    gap = pos[:, None] - neg[None, :]
    cut = np.unique(p)[::-1]
    hits = np.array([(pos >= c).sum() for c in cut])
    everyone = np.array([(p >= c).sum() for c in cut])
    step = np.diff(np.concatenate([[0], hits]))
    bins = np.clip(np.ceil(p * 10) - 1, 0, 9)
    ece = sum(abs((y[bins == b] - p[bins == b]).sum()) for b in range(10)) / len(y)
    return {
        "sensitivity": (pos >= 0.5).mean(),
        "roc_auc": ((gap > 0) + 0.5 * (gap == 0)).mean(),
        "pr_auc": (step * hits / everyone).sum() / len(pos),
        "brier": ((p - y) ** 2).mean(),
        "ece": ece,
    }


@pytest.fixture(scope="module")
def two_hundred():
    import numpy as np

    rng = np.random.default_rng(3)
    y = (rng.random(200) < 0.35).astype(int)
    return y, np.round(np.clip(0.3 + 0.3 * y + rng.normal(0, 0.23, 200), 0.0, 0.98), 2) + 0.003


def test_sums_of_weighted_scores_equal_repeated_rows(two_hundred):
    """Two ranges, the upper one first, add up to the metrics of the rows written out."""
    import numpy as np

    y, p = two_hundred
    rng = np.random.default_rng(5)
    cut = np.unique(p)[::-1]
    w = [np.array([rng.multinomial((y == c).sum(), [((p == v) & (y == c)).sum() / (y == c).sum() for v in cut])]) for c in (1, 0)]
    up = [x[:, :40] for x in w]
    zero = np.zeros(1, "int64")
    total = M.replicate_sums(cut[:40], *up, zero, zero, 0.5)[0] + M.replicate_sums(
        cut[40:], w[0][:, 40:], w[1][:, 40:], up[0].sum(axis=1), up[1].sum(axis=1), 0.5
    )[0]
    n, pos, _, _, _, tp, sq, roc, pr, *gaps = total
    want = by_rows(np.repeat([1, 0], [pos, n - pos]).astype(int), np.concatenate([np.repeat(cut, x[0]) for x in w]))
    got = {"sensitivity": tp / pos, "roc_auc": roc / (pos * (n - pos)), "pr_auc": pr / pos, "brier": sq / n, "ece": sum(map(abs, gaps)) / n}
    assert all(math.isclose(got[m], want[m], rel_tol=1e-9) for m in want)


@pytest.mark.parametrize("rows_per_draw", [1_000_000, 30])
def test_bootstrap_of_curves_agrees_with_drawn_rows(spark, two_hundred, rows_per_draw):
    """Replicates have the distribution of metrics over resampled rows, whether scores are in one range or in several."""
    import numpy as np

    y, p = two_hundred
    rng = np.random.default_rng(11)
    drawn = [by_rows(y[i], p[i]) for i in (rng.integers(0, 200, 200) for _ in range(2000))]
    reps = M.bootstrap_replicates(frame(spark, y.tolist(), p.tolist()), [], rows_per_draw=rows_per_draw).toPandas()
    assert len(reps) == 2000 and reps["replicate"].is_unique
    for m in drawn[0]:
        want = np.array([d[m] for d in drawn])
        sd = want.std()
        assert abs(reps[m].mean() - want.mean()) < 0.15 * sd and 0.9 < reps[m].std() / sd < 1.1, m
        for q in (0.025, 0.975):
            assert abs(reps[m].quantile(q) - np.quantile(want, q)) < 0.35 * sd, (m, q)


def test_bootstrap_groups_null_keys_and_one_class(spark):
    rows = [("a", i % 2, i / 20) for i in range(20)] + [(None, i % 2, i / 20) for i in range(20)] + [("one", 1, 0.4)] * 5
    df = spark.createDataFrame(rows, "g string, y int, p double")
    got = {(r["g"], r["metric"]): r for r in M.bootstrap_cis(df, ["g"], ["roc_auc", "brier"], n_boot=60).collect()}
    assert {g for g, _ in got} == {"a", None}  # a group of one class has no replicate with two
    assert all(r["ci_low"] <= r["ci_high"] and r["n_boot_used"] == 60 for r in got.values())
    assert M.bootstrap_cis(df.where("false"), ["g"], n_boot=10).count() == 0


@pytest.mark.parametrize("y, p", [(2, 0.5), (None, 0.5), (1, None), (1, float("nan"))])
def test_bad_labels_and_scores_are_refused(spark, y, p):
    pred = spark.createDataFrame([(1, 0.5, 0), (0, 0.4, 0), (y, p, 0)], "y int, p double, g int")
    with pytest.raises(Exception, match="label must be|score is missing"):
        M.confusion(pred, ["g"]).collect()
    with pytest.raises(Exception, match="label must be|score is missing"):
        M.distinct_scores(pred, ["g"]).collect()
