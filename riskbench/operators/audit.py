"""Data audit: class balance, duplicates, label noise, missing values, profiles, subgroups, warnings.

Everything about duplicates comes from one aggregation to distinct feature tuples (nulls equal), combined before the
shuffle; a group of copies of any size is one row after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .. import schema as S
from ..functions.clinical import age_group_or_unknown
from ..functions.numbers import sum_when
from .quantiles import exact_quantiles


def class_balance(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """(n, positive, negative, prevalence, majority_class_accuracy)."""
    t = F.col(target)
    c = df.agg(
        F.count("*").alias("n"), sum_when(t == 1).cast("long").alias("positive"), sum_when(t == 0).cast("long").alias("negative")
    )
    n = F.col("n")
    return c.select(
        "n",
        "positive",
        "negative",
        F.try_divide(F.col("positive"), n).alias("prevalence"),
        F.try_divide(F.greatest("positive", "negative"), n).alias("majority_class_accuracy"),
    )


def feature_groups(df: DataFrame, features: Sequence[str] = S.FEATURES, target: str = S.TARGET) -> DataFrame:
    """One row per distinct feature tuple with label counts ``n0`` and ``n1``."""
    t = F.col(target)
    return df.groupBy(*features).agg(sum_when(t == 0).cast("long").alias("n0"), sum_when(t == 1).cast("long").alias("n1"))


def duplicate_summary(groups: DataFrame) -> DataFrame:
    """One row over ``feature_groups``: duplicates, contradictions and the accuracy ceiling they imply."""
    n0, n1 = F.col("n0"), F.col("n1")
    both = (n0 > 0) & (n1 > 0)
    c = groups.agg(
        F.sum(n0 + n1).alias("n"),
        F.count("*").alias("feature_groups"),
        F.sum((n0 > 0).cast("long") + (n1 > 0).cast("long")).alias("exact_groups"),
        sum_when(both).cast("long").alias("contradictory_groups"),
        sum_when(both, n0 + n1).cast("long").alias("contradictory_rows"),
        F.sum(F.greatest(n0, n1)).alias("best_correct"),
    )
    share = F.try_divide(F.col("best_correct"), F.col("n"))
    return c.select(
        "n",
        (F.col("n") - F.col("exact_groups")).alias("exact_rows"),
        (F.col("n") - F.col("feature_groups")).alias("feature_identical_rows"),
        "contradictory_groups",
        "contradictory_rows",
        F.round(share, 4).alias("label_noise_ceiling"),
        F.round(share, 6).alias("ceiling_6"),
        F.round(1 - share, 6).alias("disagreement_rate"),
    )


def ceiling_by(df: DataFrame, key: str, features: Sequence[str] = S.FEATURES, target: str = S.TARGET) -> DataFrame:
    """Accuracy ceiling per level of a key that is a function of the features."""
    groups = feature_groups(df, [*features, key], target)
    n0, n1 = F.col("n0"), F.col("n1")
    both = (n0 > 0) & (n1 > 0)
    return groups.groupBy(key).agg(
        F.sum(n0 + n1).alias("n"),
        F.sum(n1).alias("positive"),
        sum_when(both).cast("long").alias("contradictory_groups"),
        sum_when(both, n0 + n1).cast("long").alias("contradictory_rows"),
        F.round(F.sum(F.greatest(n0, n1)) / F.sum(n0 + n1), 4).alias("label_noise_ceiling"),
    )


def missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, missing, missing_pct) with one scan."""
    cols = list(columns or df.columns)
    one = df.agg(F.count("*").alias("_n"), *[sum_when(F.col(c).isNull()).cast("long").alias(c) for c in cols])
    long = one.unpivot(["_n"], cols, "column", "missing")
    return long.select("column", "missing", F.round(F.try_divide(F.col("missing") * 100.0, F.col("_n")), 2).alias("missing_pct"))


def melt(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), name: str = "column", value: str = "value") -> DataFrame:
    """Long table (keep..., column, value), values as double."""
    cells = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])
    return df.select(*keep, F.inline(cells))


def numeric_profile(df: DataFrame, columns: Sequence[str] = S.NUMERIC, row_bound: int | None = None, approximate: bool = False) -> DataFrame:
    """(column, n, min, p50, max, mean, std), nulls skipped; sample sd, NULL for fewer than two values.

    The exact median goes through distinct-value counts and running sums; ``approximate`` uses the sketch instead.
    """
    long = melt(df, columns)
    basic = long.groupBy("column").agg(
        F.count("value").alias("n"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        *([F.percentile_approx("value", 0.5, 10_000).alias("p50")] if approximate else []),
    )
    if approximate:
        return basic
    median = exact_quantiles(long, ["column"], "value", [0.5], row_bound).withColumnRenamed("q0", "p50")
    return basic.join(F.broadcast(median), "column", "left")  # one row per profiled column


def category_counts(df: DataFrame, columns: Sequence[str] = S.CATEGORICAL) -> DataFrame:
    """(column, level, rows); a missing code is its own level."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias("level")) for c in columns])
    return df.select(F.inline(cells)).groupBy("column", "level").agg(F.count("*").alias("rows"))


def subgroup_counts(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """(key, level, rows, prevalence) for gender (null dropped) and age group (null is ``unknown``)."""
    cells = F.array_compact(
        F.array(
            F.when(F.col("gender").isNotNull(), F.struct(F.lit("gender").alias("key"), F.col("gender").cast("string").alias("level"))),
            F.struct(F.lit("age_group").alias("key"), age_group_or_unknown(F.col("age")).alias("level")),
        )
    )
    return (
        df.select(target, F.inline(cells))
        .groupBy("key", "level")
        .agg(F.count("*").alias("rows"), F.avg(target).alias("prevalence"))
    )


def group_rows(groups: DataFrame, exact: bool) -> DataFrame:
    """(size) of each group of copies: exact rows (features and label) or feature-identical rows."""
    if exact:
        return groups.select(F.explode(F.array("n0", "n1")).alias("size")).where("size > 0")
    return groups.select((F.col("n0") + F.col("n1")).alias("size"))


def duplicate_listing(groups: DataFrame) -> DataFrame:
    """(kind, groups, rows): all rows in groups of more than one, for exact and feature-identical copies."""
    cells = F.array(
        F.struct(F.lit("exact").alias("kind"), F.array("n0", "n1").alias("sizes")),
        F.struct(F.lit("features").alias("kind"), F.array(F.col("n0") + F.col("n1")).alias("sizes")),
    )
    dup = groups.select(F.inline(cells)).select("kind", F.filter("sizes", lambda v: v > 1).alias("sizes"))
    return dup.groupBy("kind").agg(
        F.sum(F.size("sizes")).cast("long").alias("groups"),
        F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, v: a + v)).alias("rows"),
    )


def largest_groups(groups: DataFrame, features: Sequence[str] = S.FEATURES, k: int = 10) -> DataFrame:
    """The k largest groups of copies, ties by feature values."""
    g = groups.select(*features, (F.col("n0") + F.col("n1")).alias("size")).where("size > 1")
    return g.orderBy(F.desc("size"), *features).limit(k)


def conflicting_groups(groups: DataFrame, features: Sequence[str] = S.FEATURES, k: int | None = None) -> DataFrame:
    """Label counts of groups with both labels; the first k by feature values if k is given."""
    g = groups.where("n0 > 0 and n1 > 0").select(*features, "n0", "n1")
    return g.orderBy(*features).limit(k) if k else g


def warnings(df: DataFrame, groups: DataFrame | None = None, target: str = S.TARGET) -> DataFrame:
    """(code, column, value) rows: high missing rate, duplicates, contradictions, gender imbalance, majority floor."""
    groups = groups if groups is not None else feature_groups(df, target=target)
    row = "code string, column string, value double"
    miss = missing(df, S.ALL_COLUMNS).where("missing_pct > 20").select(
        F.lit("high_missing").alias("code"), "column", F.col("missing_pct").alias("value")
    )
    d = duplicate_summary(groups)
    dups = d.select(
        F.inline(
            F.array_compact(
                F.array(
                    F.when(F.col("exact_rows") > 0, _warn("exact_duplicates", F.col("exact_rows"))),
                    F.when(F.col("contradictory_rows") > 0, _warn("contradictory_rows", F.col("contradictory_rows"))),
                    F.when(F.col("contradictory_rows") > 0, _warn("label_noise_ceiling", F.col("label_noise_ceiling"))),
                )
            )
        )
    )
    gender = subgroup_counts(df, target).where("key = 'gender'").agg(
        F.try_divide(F.min("rows"), F.sum("rows")).alias("share")
    )
    skewed = gender.where("share < 0.30").select(F.inline(F.array(_warn("gender_imbalance", F.col("share"), "gender"))))
    floor = class_balance(df, target).select(F.inline(F.array(_warn("majority_floor", F.col("majority_class_accuracy"), target))))
    out = miss
    for part in (dups, skewed, floor):
        out = out.unionByName(part)
    return out.to(df.sparkSession.createDataFrame([], row).schema)


def _warn(code: str, value, column: str = ""):
    return F.struct(F.lit(code).alias("code"), F.lit(column).alias("column"), value.cast("double").alias("value"))


def audit(df: DataFrame, target: str = S.TARGET, row_bound: int | None = None) -> DataFrame:
    """The whole report as one tidy table (section, key, level, metric, value). The table is validated first.

    Four passes over the columns they need: one global aggregation, one over levels, one over feature tuples, one for the
    exact medians. Each ends in a few rows; the report and its warnings are put together from those.
    """
    from .contract import validate

    validate(df)
    base = df.select(*S.ALL_COLUMNS)
    t = F.col(target)
    wanted = {("", "n"): F.count("*"), ("", "positive"): sum_when(t == 1), ("", "negative"): sum_when(t == 0)}
    wanted |= {(c, "missing"): sum_when(F.col(c).isNull()) for c in S.ALL_COLUMNS}
    for c in S.NUMERIC:
        v = F.col(c).cast("double")
        wanted |= {(c, "n"): F.count(v), (c, "min"): F.min(v), (c, "max"): F.max(v), (c, "mean"): F.avg(v), (c, "std"): F.stddev_samp(v)}
    got = dict(zip(wanted, base.agg(*[w.cast("double").alias(f"v{i}") for i, w in enumerate(wanted.values())]).first()))
    n = got[("", "n")]

    def pairs(name: str, level):
        return F.struct(F.lit(name).alias("key"), level.alias("level"))

    cells = [pairs(c, F.coalesce(F.col(c).cast("string"), F.lit("missing"))) for c in S.CATEGORICAL]
    cells.append(pairs("age_group", age_group_or_unknown(F.col("age"))))
    levels = base.select(t.alias("_y"), F.inline(F.array(*cells))).groupBy("key", "level").agg(F.count("*").alias("rows"), F.avg("_y").alias("prevalence")).collect()
    dup = duplicate_summary(feature_groups(base, target=target)).first()
    medians = exact_quantiles(melt(base, S.NUMERIC), ["column"], "value", [0.5], row_bound).collect()
    median = {r["column"]: r["q0"] for r in medians}

    out: list[tuple] = []

    def add(section: str, key: str, level: str, **values) -> None:
        out.extend((section, key, level, m, None if v is None else float(v)) for m, v in values.items())

    floor = max(got[("", "positive")], got[("", "negative")]) / n if n else None
    prevalence = got[("", "positive")] / n if n else None
    add("class_balance", target, "", n=n, positive=got[("", "positive")], negative=got[("", "negative")], prevalence=prevalence, majority_class_accuracy=floor)
    shown = ["exact_rows", "feature_identical_rows", "contradictory_groups", "contradictory_rows", "label_noise_ceiling"]
    add("duplicates", "", "", **{m: dup[m] for m in shown})
    pct = {c: round(100 * got[(c, "missing")] / n, 2) if n else None for c in S.ALL_COLUMNS}
    for c in S.ALL_COLUMNS:
        add("missing", c, "", missing=got[(c, "missing")], missing_pct=pct[c])
    for c in S.NUMERIC:
        add("numeric", c, "", p50=median.get(c), **{m: got[(c, m)] for m in ("n", "min", "max", "mean", "std")})
    for r in levels:
        if r["key"] in S.CATEGORICAL:
            add("categories", r["key"], r["level"], rows=r["rows"])
        if r["key"] in S.SUBGROUP_KEYS and (r["key"], r["level"]) != ("gender", "missing"):
            add("subgroups", r["key"], r["level"], rows=r["rows"], prevalence=r["prevalence"])

    genders = [r["rows"] for r in levels if r["key"] == "gender" and r["level"] != "missing"]
    for c, p in pct.items():
        if p and p > 20:
            add("warnings", "high_missing", c, value=p)
    if dup["exact_rows"]:
        add("warnings", "exact_duplicates", "", value=dup["exact_rows"])
    if dup["contradictory_rows"]:
        add("warnings", "contradictory_rows", "", value=dup["contradictory_rows"])
        add("warnings", "label_noise_ceiling", "", value=dup["label_noise_ceiling"])
    if genders and min(genders) / sum(genders) < 0.30:
        add("warnings", "gender_imbalance", "gender", value=min(genders) / sum(genders))
    if floor is not None:
        add("warnings", "majority_floor", target, value=floor)
    return df.sparkSession.createDataFrame(out, "section string, key string, level string, metric string, value double")


def profile(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """One row: rows, columns, prevalence, target counts, total missing cells."""
    t = F.col(target)
    cells = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0))
    return df.agg(
        F.count("*").alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.avg(t).alias("prevalence"),
        sum_when(t == 1).cast("long").alias("positive"),
        sum_when(t == 0).cast("long").alias("negative"),
        F.sum(cells).alias("missing_cells"),
    )
