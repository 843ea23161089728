"""Feature statistics and fold-local selection.

Mutual information is the plug-in estimate over quantile bins, in nats (the nearest-neighbour estimator of common
libraries is not used). Selection is greedy: relevance minus a penalty times the largest rank correlation with a feature
already chosen.
"""

from __future__ import annotations

import math
from functools import reduce
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import ordering as O
from ..functions.joins import join_hot_apart
from ..functions.numbers import count_below
from ..schema import CANDIDATE_FEATURES, ID, ContractError
from ..session import stored
from . import fold_stats as FS
from .contract import require_columns

GROUP = ["rep", "fold", "feature"]
HOT_SHARE = 1000
MOST_RANKS = 2_000_000  # ranks (of values in training sets) that a pass over the rows looks up

# Why each candidate is offered.
RATIONALE = {
    "age_years": "age in years",
    "bmi": "weight relative to height",
    "ap_hi": "systolic pressure, the strongest single signal",
    "ap_lo": "diastolic pressure",
    "pulse_pressure": "gap between the two pressures",
    "map": "mean arterial pressure, one number for both pressures",
    "cholesterol": "ordered cholesterol level",
    "gluc": "ordered glucose level",
    "active": "physical activity flag",
    "gender": "kept for subgroup reports",
    "smoke": "smoking flag",
    "alco": "alcohol flag",
}
# End of fixed values.


def rationale(df: DataFrame, column: str = "feature") -> DataFrame:
    """Attach the rationale text to a table of features; an unknown feature is an error."""
    unknown = df.where(F.col(column).isNull() | ~F.col(column).isin(list(RATIONALE))).select(column).distinct().limit(5).collect()
    if unknown:
        raise KeyError(f"unknown features {[r[0] for r in unknown]}")
    dim = df.sparkSession.createDataFrame(list(RATIONALE.items()), f"{column} string, rationale string")
    return df.join(F.broadcast(dim), column)


def binned_information(values: DataFrame, edges: DataFrame, groups: Sequence[str] = tuple(GROUP)) -> DataFrame:
    """(groups..., mi): mutual information of the binned value with the label, in nats."""
    groups = list(groups)
    binned = values.join(F.broadcast(edges), groups).groupBy(*groups, count_below(F.col("edges"), F.col("value"), strict=False).alias("bin")).agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1")
    )
    return label_information(binned, groups)


def label_information(binned: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Mutual information from label counts per bin: sum of n_by * log(n_by * n / (n_b * n_y)) / n."""
    groups = list(groups)
    whole = W.partitionBy(*groups)  # a few bins per group
    t = binned.select(
        *groups,
        "n0",
        "n1",
        (F.col("n0") + F.col("n1")).cast("double").alias("nb"),
        F.sum("n0").over(whole).cast("double").alias("t0"),
        F.sum("n1").over(whole).cast("double").alias("t1"),
    )

    def term(n: str, t_y: str) -> Column:
        c = F.col(n).cast("double")
        return F.when(c > 0, c * F.log(c * (F.col("t0") + F.col("t1")) / (F.col("nb") * F.col(t_y)))).otherwise(0.0)

    total = F.sum(term("n0", "t0") + term("n1", "t1")) / F.sum("nb")
    return t.groupBy(*groups).agg(F.greatest(total, F.lit(0.0)).alias("mi"))


def prepared(df: DataFrame, features: Sequence[str], target: str, k: int, row_bound: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, fill, values): the columns that selection reads, the training medians, the distinct training values.

    Rows and values are written once, since several passes read a few columns each; the medians are a small local table.
    """
    rows = stored(df.select(ID, target, "rep", "fold", *features), "candidates")
    fill = FS.fitted(FS.train_medians(rows, features, k, row_bound))
    return rows, fill, stored(FS.train_values(rows, features, target, k, fill), "train-values")


def train_information(df: DataFrame, features: Sequence[str], target: str, k: int, n_bins: int = 8, row_bound: int | None = None) -> DataFrame:
    """(rep, fold, feature, mi) on median-filled training rows of each fold."""
    _, _, values = prepared(df, features, target, k, row_bound)
    return binned_information(values, FS.value_edges(values, n_bins, row_bound))


def train_screening(df: DataFrame, features: Sequence[str], target: str, k: int, row_bound: int | None = None) -> DataFrame:
    """(rep, fold, feature, auc, strength): ROC-AUC of each single feature on the training rows, missing values left out."""
    values = FS.train_values(df, features, target, k)
    cuts = O.fit_cuts(values, GROUP, "value", row_bound)
    run = O.running_sums(values, GROUP, "value", ["n0", "n1"], descending=True, cuts=cuts)
    s = run.groupBy(*GROUP).agg(
        F.sum(F.col("n0") * (F.col("cum_n1") - F.col("n1") / 2.0)).alias("u"), F.sum("n0").alias("neg"), F.sum("n1").alias("pos")
    )
    auc = F.try_divide(F.col("u"), F.col("pos").cast("double") * F.col("neg"))
    return s.select(*GROUP, auc.alias("auc"), F.abs(auc - 0.5).alias("strength"))


def top_per_fold(scores: DataFrame, by: str, k: int) -> DataFrame:
    """The k best features of each fold, ties by name; adds ``rank``. A dozen rows per fold."""
    w = W.partitionBy("rep", "fold").orderBy(F.desc(by), "feature")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def stability(selected: DataFrame) -> DataFrame:
    """(feature, folds): in how many folds each feature was selected."""
    return selected.groupBy("feature").agg(F.count("*").alias("folds")).orderBy(F.desc("folds"), "feature")


# ---------------------------------------------------------------- rank correlation


def _pair_correlations(ranks: DataFrame, features: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """(groups..., a, b, rho) with a < b in list order, from one column of centred ranks per feature; undefined is 0.

    Centred ranks sum to zero, so a correlation needs only sums of products.
    """
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    at = {p: i for i, p in enumerate(pairs)}
    one = ranks.groupBy(*groups).agg(*[F.sum(F.col(a) * F.col(b)).alias(f"_s{at[(a, b)]}") for a, b in pairs])

    def s(a: str, b: str) -> Column:
        return F.col(f"_s{at[(a, b)]}")

    cells = F.array(
        *[
            F.struct(
                F.lit(a).alias("a"),
                F.lit(b).alias("b"),
                F.coalesce(F.abs(F.try_divide(s(a, b), F.sqrt(s(a, a)) * F.sqrt(s(b, b)))), F.lit(0.0)).alias("rho"),
            )
            for a, b in pairs
            if a != b
        ]
    )
    return one.select(*groups, F.inline(cells))


def train_spearman(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    k: int,
    row_bound: int | None = None,
    fill: DataFrame | None = None,
    values: DataFrame | None = None,
) -> DataFrame:
    """(rep, fold, a, b, rho): absolute Spearman correlation on median-filled training rows.

    Ranks are found per distinct value and fold. Where the ranks of a repeat are few enough (``MOST_RANKS``) they go to the tasks, which
    look them up and add up the products of all training sets, so no row is shuffled or copied; where they are not, they are joined
    to the rows. ``fill`` and ``values`` come from ``prepared``, if it has run already.
    """
    features = list(features)
    if fill is None or values is None:
        df, fill, values = prepared(df, features, target, k, row_bound)
    values = values.withColumn("n", F.col("n0") + F.col("n1"))
    run = O.running_sums(values, GROUP, "value", ["n"], cuts=O.fit_cuts(values, GROUP, "value", row_bound))
    centred = (F.col("cum_n") - (F.col("n") - 1) / 2.0 - (F.col("total_n") + 1) / 2.0) / F.col("total_n")
    rank = run.select(*GROUP, "value", centred.alias("rank"))
    per_rep = {r["rep"]: r["count"] for r in values.groupBy("rep").count().collect()}
    if max(per_rep.values(), default=0) > MOST_RANKS:
        return _joined_spearman(df, features, k, row_bound, fill, rank)
    rows, passes = _merged(df, features, min(per_rep, default=0)), []
    for rep in sorted(per_rep):
        if not passes or sum(per_rep[r] for r in passes[-1]) + per_rep[rep] > MOST_RANKS:
            passes.append([])
        passes[-1].append(rep)
    out = [cell for reps in passes for cell in _looked_up_spearman(rows, features, k, fill, rank, reps)]
    return df.sparkSession.createDataFrame(out, f"rep {df.schema['rep'].dataType.simpleString()}, fold int, a string, b string, rho double")


def _merged(df: DataFrame, features: Sequence[str], rep: int) -> DataFrame:
    """(rep, fold, features): rows of one record id count once; only ids that repeat, which one repeat tells, are shuffled."""
    rows = df.select("rep", "fold", ID, *[F.col(f).cast("double").alias(f) for f in features])
    again = rows.where(F.col("rep") == rep).groupBy(F.col(ID).alias("_again")).count().where("count > 1").select("_again")
    names = ["rep", "fold", *features]
    if again.isEmpty():
        return rows.select(*names)
    met = F.col(ID).eqNullSafe(F.col("_again"))
    merged = rows.join(again, met, "left_semi").groupBy("rep", "fold", ID).agg(*[F.max(f).alias(f) for f in features])
    return rows.join(again, met, "left_anti").select(*names).unionByName(merged.select(*names))


def _looked_up_spearman(rows: DataFrame, features: list[str], k: int, fill: DataFrame, rank: DataFrame, reps: Sequence[int]) -> list[tuple]:
    """(rep, fold, a, b, rho) of some repeats, from one pass over their rows."""
    import numpy as np

    position = F.array_position(F.array(*map(F.lit, features)), F.col("feature")).cast("int") - 1
    got = rank.where(F.col("rep").isin(list(reps))).select("rep", "fold", position.alias("feature"), "value", "rank").toArrow()
    rep, fold, feature, value, ranks = (got[c].to_numpy() for c in ("rep", "fold", "feature", "value", "rank"))
    place = {r: i for i, r in enumerate(reps)}
    at = np.array([place[r] for r in rep.tolist()], np.int64) * k + fold
    medians = {(place[r["rep"]] * k + r["fold"], r["feature"]): r["median"] for r in fill.collect() if r["rep"] in place}
    # Of each feature: its values, ascending, and their rank in every training set; behind them the rank of a missing value.
    tables = []
    for i, f in enumerate(features):
        own = feature == i
        known, where = np.unique(value[own], return_inverse=True)
        table = np.zeros((len(reps) * k, len(known) + 1))
        table[at[own], where] = ranks[own]
        for s in range(len(reps) * k):
            m = medians.get((s, f))
            j = np.searchsorted(known, m) if m is not None else len(known)
            table[s, -1] = table[s, j] if j < len(known) and known[j] == m else 0.0
        tables.append((known, table))
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast((tables, place))  # MOST_RANKS numbers, and as many values at most
    width = len(features)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        tables, place = held.value
        sums = np.zeros((len(place) * k, width, width))
        for batch in batches:
            own, fold = batch.column("rep").to_numpy(zero_copy_only=False), batch.column("fold").to_numpy(zero_copy_only=False)
            index = []
            for f, (known, _) in zip(features, tables):
                column = batch.column(f)
                x = column.fill_null(0.0).to_numpy(zero_copy_only=False)
                index.append(np.where(column.is_null().to_numpy(zero_copy_only=False), len(known), np.minimum(np.searchsorted(known, x), len(known))))
            for r, p in place.items():
                here = np.flatnonzero(own == r)
                part = [i[here] for i in index]
                for f in range(k):
                    train = (fold[here] != f).astype(float)
                    z = np.stack([table[p * k + f].take(i) for (_, table), i in zip(tables, part)])
                    sums[p * k + f] += (z * train) @ z.T
        flat = sums.reshape(len(sums), -1)
        at = np.repeat(np.arange(len(flat), dtype=np.int32), width * width), np.tile(np.arange(width * width, dtype=np.int32), len(flat))
        yield pa.RecordBatch.from_arrays([*map(pa.array, at), pa.array(flat.ravel())], ["at", "place", "value"])

    found = rows.where(F.col("rep").isin(list(reps))).mapInArrow(run, "at int, place int, value double").groupBy("at", "place").agg(F.sum("value").alias("value")).toArrow()
    held.unpersist()
    sums = np.zeros((len(reps) * k, width * width))
    sums[found["at"].to_numpy(), found["place"].to_numpy()] = found["value"].to_numpy()
    out = []
    for s, gram in enumerate(sums.reshape(-1, width, width)):
        if not (at == s).any():
            continue
        for i in range(width):
            for j in range(i + 1, width):
                size = float(np.sqrt(gram[i, i]) * np.sqrt(gram[j, j]))
                out.append((int(reps[s // k]), s % k, features[i], features[j], abs(float(gram[i, j]) / size) if size else 0.0))
    return out


def _joined_spearman(df: DataFrame, features: list[str], k: int, row_bound: int | None, fill: DataFrame, rank: DataFrame) -> DataFrame:
    """(rep, fold, a, b, rho) where the distinct values are too many to look them up: ranks packed into one array per value and joined
    to the rows once; common values (flags, codes, missing) are broadcast."""
    long = FS.long_values(df, features, ("rep", "fold", ID)).withColumn("missing", F.col("value").isNull())
    seen = long.groupBy("rep", "feature", "value", "missing").agg(F.count("*").alias("rows"))
    folds = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold")
    per_fold = seen.select("*", folds).join(F.broadcast(fill), GROUP)
    ranked = per_fold.withColumn("original", F.col("value")).withColumn("value", F.coalesce("value", "median")).join(rank, [*GROUP, "value"], "left")
    packed = ranked.groupBy("rep", "feature", F.coalesce("original", F.lit(0.0)).alias("value"), "missing").agg(
        F.first("rows").alias("rows"), *[F.max(F.when(F.col("fold") == f, F.col("rank"))).alias(f"r{f}") for f in range(k)]
    )
    lookup = packed.select("rep", "feature", "value", "missing", "rows", F.array(*[f"r{f}" for f in range(k)]).alias("ranks"))
    n = row_bound or df.groupBy("rep").count().agg(F.max("count")).first()[0]
    is_hot = F.col("rows") > F.lit(n / HOT_SHARE)
    keys = ["rep", "feature", "value", "missing"]
    rows = long.withColumn("value", F.coalesce("value", F.lit(0.0)))
    joined = join_hot_apart(rows, lookup.where(is_hot).drop("rows"), lookup.where(~is_hot).drop("rows"), keys)
    by_row = joined.groupBy("rep", "fold", ID).agg(*[F.max(F.when(F.col("feature") == f, F.col("ranks"))).alias(f) for f in features])
    train = FS.training_rows(by_row, k)
    at = F.col("fold") + 1
    picked = train.select("rep", "fold", *[F.element_at(f, at).alias(f) for f in features])
    return _pair_correlations(picked, features, ["rep", "fold"])


# ---------------------------------------------------------------- greedy selection


def greedy(mi: dict[str, float], rho: dict[tuple[str, str], float], k: int, penalty: float) -> list[tuple[str, float]]:
    """Ordered (feature, score): first the largest relevance, then relevance - penalty * redundancy; near ties by name.

    The arguments are the dozen relevances and their pairwise correlations of one fold.
    """
    if k < 1 or penalty < 0:
        raise ValueError("k must be >= 1 and the penalty >= 0")
    both = rho | {(b, a): r for (a, b), r in rho.items()}
    redundancy = {f: 0.0 for f in CANDIDATE_FEATURES if f in mi}  # with the choices so far
    chosen: list[tuple[str, float]] = []
    while redundancy and len(chosen) < k:
        score = {f: mi[f] - penalty * r for f, r in redundancy.items()}

        def ahead(a: str, b: str) -> str:
            tied = bool(chosen) and math.isclose(score[b], score[a], rel_tol=1e-5, abs_tol=1e-8)  # noqa: B023
            return b if score[b] > score[a] or (tied and b < a) else a  # noqa: B023

        pick = reduce(ahead, redundancy)
        met = [both.get((f, pick), 0.0) for f in redundancy]
        redundancy = {f: max(r, m) if chosen else m for (f, r), m in zip(redundancy.items(), met) if f != pick}
        chosen.append((pick, score[pick]))
    return chosen


def select_features(
    df: DataFrame, target: str, k_folds: int, k: int = 8, penalty: float = 0.5, n_bins: int = 8, row_bound: int | None = None
) -> DataFrame:
    """(rep, fold, rank, feature, score): selection on the training rows of every fold."""
    return fit_selection(df, target, k_folds, k, penalty, n_bins, row_bound)[0]


def fit_selection(
    df: DataFrame, target: str, k_folds: int, k: int = 8, penalty: float = 0.5, n_bins: int = 8, row_bound: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The selection, the training medians (rep, fold, feature, median), and the stored candidate columns.

    The statistics are Spark jobs over all folds together; the greedy step reads 12 relevances and 66 correlations per fold.
    """
    require_columns(df, CANDIDATE_FEATURES)
    rows, fill, values = prepared(df, CANDIDATE_FEATURES, target, k_folds, row_bound)
    mi = binned_information(values, FS.value_edges(values, n_bins, row_bound)).collect()
    rho = train_spearman(rows, CANDIDATE_FEATURES, target, k_folds, row_bound, fill, values).collect()
    if not mi:
        raise ContractError("no rows to select features from")
    by_fold: dict[tuple[int, int], tuple[dict, dict]] = {}
    for r in mi:
        by_fold.setdefault((r["rep"], r["fold"]), ({}, {}))[0][r["feature"]] = r["mi"]
    for r in rho:
        by_fold[(r["rep"], r["fold"])][1][(r["a"], r["b"])] = r["rho"]
    out = [
        (rep, fold, i, f, float(s))
        for (rep, fold), (m, c) in sorted(by_fold.items())
        for i, (f, s) in enumerate(greedy(m, c, k, penalty), 1)
    ]
    chosen = df.sparkSession.createDataFrame(out, "rep int, fold int, rank int, feature string, score double")
    return chosen, fill, rows


def support(selected: DataFrame) -> DataFrame:
    """(rep, fold, feature, selected) for every candidate."""
    marks = selected.groupBy("rep", "fold").agg(F.collect_set("feature").alias("_s"))  # at most 12 names
    cells = F.explode(F.array(*[F.lit(f) for f in CANDIDATE_FEATURES])).alias("feature")
    return marks.select("rep", "fold", "_s", cells).select("rep", "fold", "feature", F.array_contains("_s", F.col("feature")).alias("selected"))


def selected_names(selected: DataFrame, rep: int, fold: int) -> list[str]:
    rows = selected.where((F.col("rep") == rep) & (F.col("fold") == fold)).orderBy("rank").collect()
    if not rows:
        raise ContractError(f"no selection fitted for rep {rep} fold {fold}")
    return [r["feature"] for r in rows]


# ---------------------------------------------------------------- attributions


def top_features(attributions: DataFrame, k: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, importance, rank): mean absolute attribution, largest first, ties by name."""
    g = attributions.groupBy(*by, "feature").agg(F.avg(F.abs("value")).alias("importance"))
    r = g.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("importance"), "feature")))
    return r.where(F.col("rank") <= k) if k else r


def leakage_proxies(attributions: DataFrame, suspects: Sequence[str], top: int = 3) -> DataFrame:
    """Suspect features (missing indicators) among the strongest ones."""
    return top_features(attributions, top).where(F.col("feature").isin(list(suspects)))


def signed_order(attributions: DataFrame) -> DataFrame:
    """(feature, value, direction, position): positive values largest first, negative ones smallest first, and the order by size."""
    m = attributions.groupBy("feature").agg(F.avg("value").alias("value"))
    side = F.when(F.col("value") > 0, "raises").when(F.col("value") < 0, "lowers").otherwise("neutral")
    t = m.withColumn("direction", side)
    inside = W.partitionBy("direction").orderBy(F.desc(F.abs("value")), "feature")
    overall = W.partitionBy().orderBy(F.desc(F.abs("value")), "feature")  # one row per feature
    return t.withColumns({"position": F.row_number().over(inside), "by_size": F.row_number().over(overall)})
