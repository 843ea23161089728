import math

import pytest
from pyspark.sql import functions as F

from conftest import SF
from riskbench.functions import tails as T
from riskbench.operators import comparisons as CMP, ledger as L, subgroups as G
from riskbench.plans import model_catalog as MC, report as R
from riskbench.sources import driver_tables as D, ledger_files as LF


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_t_tails(spark):
    # published two-sided 5 % critical values, the Cauchy tail and the closed form at two degrees of freedom
    for df, t in [(1, 12.706), (2, 4.303), (4, 2.776), (9, 2.262), (24, 2.064), (120, 1.980)]:
        assert abs(value(spark, T.two_sided_p(F.lit(t), F.lit(df))) - 0.05) < 2e-4
        assert abs(value(spark, T.quantile(0.975, F.lit(df))) - t) < 2e-3
    assert math.isclose(value(spark, T.upper_tail(F.lit(1.0), F.lit(1))), 0.25)
    assert math.isclose(value(spark, T.upper_tail(F.lit(1.5), F.lit(2))), 0.5 * (1 - 1.5 / math.sqrt(2 + 2.25)))
    assert math.isclose(value(spark, T.upper_tail(F.lit(-1.0), F.lit(1))), 0.75)


def exact_tail(t, df):
    """P(|T| > t) for even degrees of freedom, by the finite series in 400 digits."""
    from decimal import Decimal as D, localcontext

    with localcontext() as ctx:
        ctx.prec = 400
        x = D(df) / (D(df) + D(t) ** 2)
        term = total = D(1)
        for j in range(1, df // 2):
            term *= x * (2 * j - 1) / (2 * j)
            total += term
        return float(1 - D(t) / (D(df) + D(t) ** 2).sqrt() * total)


def simpson_centre(t, df, n=20_000):
    """P(|T| <= t) by Simpson's rule on the density."""
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    f = [scale * (1 + (t * i / n) ** 2 / df) ** (-(df + 1) / 2) for i in range(n + 1)]
    return 2 * t / n / 3 * (f[0] + f[-1] + 4 * math.fsum(f[1:-1:2]) + 2 * math.fsum(f[2:-1:2]))


def test_t_tails_keep_their_digits_and_take_any_df(spark):
    whole = [(t, df) for t in (0.001, 0.7, 2.0, 40.0, 1e4) for df in (2, 4, 30, 200, 1000)]
    part = [(t, df) for t in (0.3, 2.0, 6.0) for df in (0.5, 2.5, 7.25, 333.3)]
    cases = spark.createDataFrame([(float(t), float(df)) for t, df in whole + part], "t double, df double")
    both = cases.select("t", "df", T.two_sided_p(F.col("t"), F.col("df")).alias("p"), T.central(F.col("t"), F.col("df")).alias("c"))
    got = {(r["t"], r["df"]): r for r in both.collect()}
    for t, df in whole:
        assert math.isclose(got[t, df]["p"], exact_tail(t, df), rel_tol=1e-10, abs_tol=1e-300), (t, df)
    for t, df in part:
        assert math.isclose(got[t, df]["c"], simpson_centre(t, df), rel_tol=1e-10), (t, df)
    assert exact_tail(40.0, 30) < 1e-26  # far below what one minus the centre could show


def test_t_tails_at_the_edges(spark):
    cases = spark.createDataFrame([(0.0, 3.0), (float("inf"), 3.0), (1.0, 0.0), (1.0, None), (None, 2.0), (float("nan"), 2.0), (-2.0, 4.0)], "t double, df double")
    got = [r["p"] for r in cases.coalesce(1).select(T.two_sided_p(F.col("t"), F.col("df")).alias("p")).collect()]
    assert got[:6] == [1.0, 0.0, None, None, None, None] and math.isclose(got[6], exact_tail(2.0, 4))


def test_t_quantile_has_no_end(spark):
    dfs = spark.createDataFrame([(1.0,), (2.0,), (2.5,), (50.0,), (0.0,)], "df double")
    p = 1 - 2.0**-40
    at = F.col("q")
    got = dfs.withColumn("q", T.quantile(p, F.col("df"))).withColumn("back", T.upper_tail(at, F.col("df"))).collect()
    for r in got[:4]:
        assert math.isclose(r["back"], 2.0**-40, rel_tol=1e-9)
    assert math.isclose(got[0]["q"], 1 / math.tan(math.pi * 2.0**-40), rel_tol=1e-9) and got[0]["q"] > 1e11
    assert got[4]["q"] is None
    assert [r["q"] for r in dfs.select(T.quantile(0.5, F.col("df")).alias("q")).collect()] == [0.0] * 4 + [None]


def test_chi_square_tail(spark):
    xs = [0.0, 1e-10, 0.5, 3.84, 7.99, 8.0, 20.0, 600.0, 1400.0, 1e6]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", T.chi2_1_upper(F.col("x")).alias("p")).collect():
        assert math.isclose(r["p"], math.erfc(math.sqrt(r["x"] / 2)), rel_tol=1e-11, abs_tol=1e-320)
    assert value(spark, T.chi2_1_upper(F.lit(None).cast("double"))) is None


def preds(spark, pairs):
    rows = [(i, m, y, p) for i, (y, a, b) in enumerate(pairs) for m, p in (("a", float(a)), ("b", float(b)))]
    return spark.createDataFrame(rows, "record_id long, model string, y int, p double")


def test_mcnemar(spark):
    five = preds(spark, [(1, 1, 0)] * 5 + [(1, 1, 1)] * 3)
    r = CMP.mcnemar(CMP.paired_correctness(five, "a", "b")).first()
    assert r["n_discordant"] == 5 and r["p_value"] == 0.0625 and r["verdict"].startswith("inconclusive")
    same = CMP.mcnemar(CMP.paired_correctness(preds(spark, [(1, 1, 1), (0, 1, 1)]), "a", "b")).first()
    assert same["p_value"] == 1.0 and same["method"] == "identical predictions"
    many = CMP.mcnemar(CMP.paired_correctness(preds(spark, [(1, 1, 0)] * 30 + [(1, 0, 1)] * 6), "a", "b")).first()
    assert math.isclose(many["statistic"], 23**2 / 36) and math.isclose(many["p_value"], math.erfc(math.sqrt(23**2 / 36 / 2)))
    assert many["verdict"].startswith("A is better")


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.001), ("b", 0.03), ("c", 0.04)], "model string, p_value double")
    got = {r["model"]: (round(r["p_adjusted"], 6), r["rejected"]) for r in CMP.holm(df).collect()}
    assert got == {"a": (0.003, True), "b": (0.06, False), "c": (0.04, False)}


def test_t_tests(spark):
    d = spark.createDataFrame([("x", v) for v in (0.1, 0.2, 0.3, 0.4)] + [("flat", 0.0)] * 3, "arm string, diff double")
    t = {r["arm"]: r for r in CMP.paired_t(d, ["arm"]).collect()}
    assert math.isclose(t["x"]["t"], 0.25 / (math.sqrt(1 / 60) / 2)) and t["x"]["verdict"].startswith("A > B")
    assert t["flat"]["p_value"] == 1.0 and t["flat"]["ci_low"] == 0.0
    e = {r["arm"]: r for r in CMP.equivalence(d, ["arm"], 0.05).collect()}
    assert e["flat"]["equivalent"] and not e["x"]["equivalent"] and e["x"]["bound"] > 0.25
    n = {r["arm"]: r for r in CMP.corrected_resampled_t(d, ["arm"], F.lit(4), F.lit(1)).collect()}
    assert n["flat"]["t"] == 0.0 and n["flat"]["p_value"] == 1.0
    assert math.isclose(n["x"]["t"], 0.25 / math.sqrt(1 / 60 * (0.25 + 0.25)))
    with pytest.raises(ValueError):
        CMP.equivalence(d, ["arm"], 0)


def test_gate(spark):
    table = spark.createDataFrame([("logreg", 0.7, 0.8), ("hybrid_x", 0.7, 0.8)], "model string, sensitivity double, specificity double")
    with pytest.raises(R.ReportError, match="control"):
        R.refuse_if_incomplete(table)
    ok = table.unionByName(spark.createDataFrame([("control_c", 0.6, 0.7)], table.schema))
    assert R.refuse_if_incomplete(ok)
    assert R.refuse_if_incomplete(ok.withColumn("majority_class_accuracy", F.lit(0.5))) == []
    with pytest.raises(R.ReportError, match="specificity"):
        R.refuse_if_incomplete(ok.drop("specificity"))


def test_ledger_files(spark, tmp_path):
    led = D.ledger(spark, SF, 3, 2)
    led = spark.createDataFrame(led.toPandas(), led.schema)
    path = str(tmp_path / "led")
    LF.append(led, path)
    LF.append(led, path)
    assert LF.read(spark, path).count() == 2 * led.count() == 36
    csv = tmp_path / "x.csv"
    csv.write_text(
        'model,config_json,roc_auc,rep,fold\n'
        'logreg,"{""folds"":5,""repeats"":5,""source"":""a,b""}",0.7,0,1\n'
        "short,1\n"
        'mlp,not json,abc,0,2\n'
        ',"{}",0.5,0,3\n'
    )
    rows = {r["model"]: r for r in LF.read_csv(spark, str(csv)).collect()}
    assert set(rows) == {"logreg", "mlp"} and rows["mlp"]["roc_auc"] is None and rows["logreg"]["fold"] == 1
    kept = R.protocol_summary(LF.read_csv(spark, str(csv)).withColumns({c: F.lit(1) for c in ("tn", "fp", "fn", "tp", "n")}))
    assert [r["model"] for r in kept.collect()] == ["logreg"] and kept.first()["source"] == "a,b"


def test_ledger_runs_are_published_last(spark, tmp_path):
    rows = spark.createDataFrame([("7", 0, f, 0.5 + f) for f in range(3)], "model string, rep int, fold int, roc_auc double")
    path = str(tmp_path / "led")
    with pytest.raises(FileNotFoundError):
        LF.read(spark, path)
    first = LF.append(rows, path)
    LF.append(rows.where("fold = 0"), path, {"note": "again"})
    rows.withColumn("run_no", F.lit(3)).write.partitionBy("model").parquet(f"{path}/rows/run_id=runhalf")  # no manifest entry
    got = LF.read(spark, path)
    assert got.count() == 4 and {r["note"] for r in got.collect()} == {None, "again"}
    assert [(r["run_no"], r["rows"]) for r in LF.runs(spark, path).orderBy("run_no").collect()] == [(1, 3), (2, 1)]
    latest = R.latest_per_model(got).first()
    assert (latest["model"], latest["runs"], latest["run_no"], latest["fold"], latest["note"]) == ("7", 4, 2, 0, "again")
    assert got.where(F.col("run_id") == first).count() == 3
    LF.append(rows.where("false"), path)
    assert LF.read(spark, path).count() == 4 and LF.runs(spark, path).count() == 2
    with pytest.raises(ValueError, match="run_no"):
        LF.append(rows.withColumn("run_no", F.lit(1)), path)


def test_out_of_fold_takes_the_last_repeat(spark):
    df = spark.createDataFrame([("m", 0, 1, 7, 0, 0.1), ("m", 1, 2, 7, 0, 0.9)], "model string, rep int, fold int, record_id long, y int, p double")
    assert L.out_of_fold(df).first()["p"] == 0.9


def test_subgroups(spark):
    rows = [(i % 2, 0.2 + 0.6 * (i % 2), "a" if i < 40 else "b", "x" if i < 79 else "y") for i in range(80)]
    df = spark.createDataFrame(rows, "y int, p double, g string, h string")
    t = {(r["key"], r["level"]): r for r in G.subgroup_table(df, ["g", "h"]).collect()}
    assert t[("ALL", "ALL")]["n"] == 80 and t[("g", "a")]["reportable"]
    assert not t[("h", "y")]["reportable"] and t[("h", "y")]["sensitivity"] is None
    table = G.subgroup_table(df, ["g", "h"])
    assert {r["key"] for r in G.disparity(table).collect()} == {"g"}
    assert any("n too small" in r["level"] for r in G.format_table(table).collect())
    with pytest.raises(ValueError):
        G.worst_subgroup(table.where("key = 'ALL'"))


def test_catalog(spark):
    assert [r["model"] for r in MC.catalog(spark).collect()] == MC.names()
    with pytest.raises(KeyError, match="logreg"):
        MC.spec("nothing")


def test_exact_binomial_for_many_cases(spark):
    from fractions import Fraction
    from math import comb

    from riskbench.functions.tails import binomial_two_sided

    cases = [(0, 5), (3, 10), (40, 100), (700, 1500)]
    got = spark.createDataFrame(cases, "k int, n int").select("k", "n", binomial_two_sided(F.col("k"), F.col("n")).alias("p")).collect()
    for r in got:
        want = min(1.0, float(Fraction(2 * sum(comb(r["n"], i) for i in range(r["k"] + 1)), 2 ** r["n"])))
        assert abs(r["p"] - want) < 1e-9 * want
