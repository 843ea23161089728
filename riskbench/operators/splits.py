"""Folds, holdouts, samples and their invariants.

Randomness is a hash of (seed, tags, record id): the same folds on any cluster and any partitioning. Folds are a long
table (record_id, rep, fold); the training rows of a fold are the rows of the same rep in the other folds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import schema as S
from ..functions import ordering as O
from ..functions.joins import join_hot_apart
from ..functions.numbers import sum_when
from ..session import stored


class SplitError(ValueError):
    """A split cannot be made or breaks an invariant."""


def class_counts(df: DataFrame, target: str) -> dict[int, int]:
    """Rows per class; the classes 0 and 1, and no others, are required."""
    rows = df.groupBy(target).count().limit(3).collect()
    counts = {r[target]: r["count"] for r in rows}
    if set(counts) != {0, 1}:
        raise SplitError(f"need exactly two classes, 0 and 1, found {sorted(map(str, counts))}")
    return counts


_DIGITS = 3  # hexadecimal digits of a draw that one histogram tells apart
MOST_BOUNDARY = 20_000  # rows that may share a bucket with a boundary when they are collected


def boundary_draws(df: DataFrame, target: str, draws: Sequence[Column], wanted) -> dict[tuple[int, int], list[tuple[str, int]]]:
    """The exact (draw, record_id) at given positions of each class in the order of several draws, without sorting the rows.

    ``wanted(n)`` lists 1-based positions in a class of ``n`` rows; the result is keyed by (class, number of the draw). A histogram of the leading
    digits leaves one bucket per boundary; only the rows in these are counted by further digits, until few enough are left to
    be collected. Each step is a scan with a map-side count; draws are uniform, so two or three steps do for any table.
    """
    rows = df.select(F.col(target).alias("_c"), F.col(S.ID).alias("_id"), F.posexplode(F.array(*draws)).alias("_at", "_draw"))

    def lead(digits: int) -> Column:
        return F.substring("_draw", 1, digits)

    def inside(keys: list[str], digits: int) -> DataFrame:
        return rows.where(F.concat_ws("|", "_c", "_at", lead(digits)).isin(keys))

    def histogram(part: DataFrame, digits: int) -> dict[tuple[int, int], list[tuple[str, int]]]:
        t = part.groupBy("_c", "_at", lead(digits).alias("_lead")).count().toArrow()
        out: dict = {}
        for c, at, key, n in zip(*(t[x].to_pylist() for x in ("_c", "_at", "_lead", "count"))):
            out.setdefault((c, at), []).append((key, n))
        return {k: sorted(v) for k, v in out.items()}

    digits = _DIGITS
    seen = histogram(rows, digits)
    counts = {c: sum(n for _, n in v) for (c, at), v in seen.items() if at == 0}
    if set(counts) != {0, 1}:
        raise SplitError(f"need exactly two classes, 0 and 1, found {sorted(map(str, counts))}")
    # (class, draw, position) -> rows before the bucket, the bucket, rows in it
    todo = {(c, at, q): (0, "", n) for c, n in counts.items() for at in range(len(draws)) for q in wanted(n)}
    while True:
        for (c, at, q), (before, bucket, _) in list(todo.items()):
            for key, n in seen[(c, at)]:
                if not key.startswith(bucket):
                    continue
                if before + n >= q:
                    todo[(c, at, q)] = before, key, n
                    break
                before += n
        keys = sorted({f"{c}|{at}|{bucket}" for (c, at, _), (_, bucket, _) in todo.items()})
        size = sum({(c, at, bucket): n for (c, at, _), (_, bucket, n) in todo.items()}.values())
        if size <= MOST_BOUNDARY or digits >= 16:
            break
        part, digits = inside(keys, digits), digits + _DIGITS
        seen = histogram(part, digits)
    found: dict[tuple, list] = {}
    for r in inside(keys, digits).collect() if todo else ():
        found.setdefault((r["_c"], r["_at"], r["_draw"][:digits]), []).append((r["_draw"], r["_id"]))
    out: dict[tuple[int, int], list[tuple[str, int]]] = {(c, at): [] for c in counts for at in range(len(draws))}
    for (c, at, q), (before, bucket, _) in sorted(todo.items()):
        out[(c, at)].append(sorted(found[(c, at, bucket)])[q - before - 1])
    return out


def _beyond(draw: Column, cuts: Sequence[tuple[str, int]]) -> Column:
    """How many of the cuts lie before a row."""
    after = [((draw > d) | ((draw == d) & (F.col(S.ID) > i))).cast("int") for d, i in cuts]
    return sum(after[1:], after[0]) if after else F.lit(0)


def with_stratified_folds(df: DataFrame, target: str, k: int = 5, repeats: int = 5, seed: int = S.BASE_SEED) -> DataFrame:
    """Every row of ``df`` once per repeat, with ``rep`` and ``fold``: per repeat and class, shuffle and cut into k chunks, the first ones
    taking the remainder. Folds are a column expression; no row is sorted or shuffled."""
    if k < 2 or repeats < 1:
        raise SplitError("need k >= 2 and repeats >= 1")

    def ends(n: int) -> list[int]:
        if n < k:
            raise SplitError(f"the smaller class has fewer than {k} rows")
        return [(n // k) * (f + 1) + min(n % k, f + 1) for f in range(k - 1)]

    draws = [O.draw_key(seed, "split", k, F.lit(rep), F.col(S.ID)) for rep in range(repeats)]
    cuts = boundary_draws(df, target, draws, ends)
    drawn = df.withColumns({f"_draw_{rep}": d for rep, d in enumerate(draws)})
    fold = [F.when(F.col(target) == 1, _beyond(F.col(f"_draw_{rep}"), cuts[(1, rep)])).otherwise(_beyond(F.col(f"_draw_{rep}"), cuts[(0, rep)])) for rep in range(repeats)]
    return drawn.select(*df.columns, F.posexplode(F.array(*fold)).alias("rep", "fold"))


def repeated_stratified_folds(df: DataFrame, target: str, k: int = 5, repeats: int = 5, seed: int = S.BASE_SEED) -> DataFrame:
    """(record_id, target, rep, fold) by ``with_stratified_folds``."""
    return with_stratified_folds(df.select(S.ID, target), target, k, repeats, seed)


def holdout(df: DataFrame, target: str, test_size: float = 0.2, seed: int = S.BASE_SEED) -> DataFrame:
    """Add boolean ``is_test``: per class, round-half-even(n * test_size) rows, at least 1 and at most n - 1."""
    if not 0.0 < test_size < 1.0:
        raise SplitError("test_size must be in (0, 1)")
    draw = O.draw_key(seed, "holdout", test_size, F.col(S.ID))
    cuts = boundary_draws(df, target, [draw], lambda n: [q for q in [min(max(round(n * test_size), 1), n - 1)] if q])
    drawn = df.withColumn("_draw", draw)
    side = F.when(F.col(target) == 1, _beyond(F.col("_draw"), cuts[(1, 0)])).otherwise(_beyond(F.col("_draw"), cuts[(0, 0)]))
    # A class of one row has no cut: it stays out of the test side.
    single = [c for (c, _), v in cuts.items() if not v]
    return drawn.select(*df.columns, ((side == 0) & ~F.col(target).isin(single) if single else side == 0).alias("is_test"))


def cohort_holdout(df: DataFrame, cohort: str, target: str, test_cohorts: Sequence[str]) -> DataFrame:
    """Add boolean ``is_test`` for the listed cohorts."""
    inside = F.coalesce(F.col(cohort).isin(list(test_cohorts)), F.lit(False))
    c = df.agg(
        F.count(cohort).alias("known"),
        sum_when(inside).alias("test"),
        sum_when(inside & (F.col(target) == 1)).alias("test_pos"),
        sum_when(~inside).alias("train"),
        sum_when(~inside & (F.col(target) == 1)).alias("train_pos"),
    ).first()
    if not c["known"]:
        raise SplitError("no row has a cohort; report subgroup metrics instead")
    if not c["test"]:
        raise SplitError(f"no rows match test cohorts {list(test_cohorts)}")
    for side in ("train", "test"):
        if not 0 < c[f"{side}_pos"] < c[side]:
            raise SplitError(f"the {side} side has a single class")
    return df.withColumn("is_test", inside)


def interleaved_folds(df: DataFrame, k: int, seed: int = S.BASE_SEED, draw: int = 0) -> DataFrame:
    """Add ``fold``: every k-th row of a permutation."""
    n = df.count()
    rows = df.withColumn("_draw", O.draw_key(seed, "interleave", draw, F.col(S.ID)))
    ranked = O.rank_by_draw(rows, [], "_draw", S.ID, n, out="_position")
    return ranked.withColumn("fold", ((F.col("_position") - 1) % k).cast("int")).drop("_draw", "_position")


# ---------------------------------------------------------------- feature groups


def feature_group(features: Sequence[str] = S.FEATURES) -> Column:
    """64-bit id of the feature values. The mask of nulls is hashed too, since the hash skips nulls.

    Two groups with one id would be kept on one side together, which is safe for splitting. Counts of groups use the
    values themselves.
    """
    mask = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in features])
    return F.xxhash64(*[F.col(c) for c in features], mask)


_INDIVIDUAL_SHARE = 1000  # a group above 1 / (1000 k) of all rows is placed on its own
_EXACT_SIZE = 64  # smaller groups form strata of exact (size, positives)


def _strata(groups: DataFrame, total: int, k: int) -> DataFrame:
    """Add ``stratum``: groups that can be exchanged for each other. Their number does not grow with the data."""
    n, pos = F.col("n"), F.col("pos")
    big = n > F.lit(total / (_INDIVIDUAL_SHARE * k))
    alone = F.concat(F.lit("g"), F.col("group_id").cast("string"))
    exact = F.concat_ws("|", F.lit("e"), n.cast("string"), pos.cast("string"))
    coarse = F.concat_ws(
        "|", F.lit("c"), F.floor(F.log2(n) * 8).cast("string"), F.floor(pos / n * 16).cast("string")
    )
    return groups.withColumn(
        "stratum", F.when(big & (n > 1), alone).when(n <= _EXACT_SIZE, exact).otherwise(coarse)
    )


def _quotas(strata: list, k: int, repeats: int, seed: int) -> list[tuple]:
    """Groups of each stratum per fold, for each repeat: even shares, the rest to the folds that balance best.

    ``strata`` is small (see ``_strata``). Balance is the squared distance of size, positives and negatives from equal.
    """
    import hashlib

    total_n = sum(s["rows"] for s in strata)
    total_p = sum(s["positives"] for s in strata)
    order = sorted(strata, key=lambda s: (-s["rows"] / s["m"], -s["positives"] / s["rows"], s["stratum"]))
    out = []
    for rep in range(repeats):
        size, positive = [0.0] * k, [0.0] * k
        prefer = sorted(range(k), key=lambda f: hashlib.sha256(f"{seed}|fold-order|{rep}|{f}".encode()).hexdigest())
        for s in order:
            n_each, p_each = s["rows"] / s["m"], s["positives"] / s["m"]
            base, extra = divmod(s["m"], k)
            share = [base] * k
            for f in range(k):
                size[f] += base * n_each
                positive[f] += base * p_each
            for _ in range(extra):

                def cost(f: int) -> tuple:
                    def change(load: float, add: float, goal: float) -> float:
                        return ((load + add - goal) ** 2 - (load - goal) ** 2) / max(goal, 1.0) ** 2

                    neg = size[f] - positive[f]
                    return (
                        change(size[f], n_each, total_n / k)
                        + change(positive[f], p_each, total_p / k)
                        + change(neg, n_each - p_each, (total_n - total_p) / k),
                        share[f],
                        prefer.index(f),
                    )

                f = min(range(k), key=cost)
                share[f] += 1
                size[f] += n_each
                positive[f] += p_each
            ends, run = [], 0
            for f in range(k):
                run += share[f]
                ends.append(run)
            out.append((s["stratum"], rep, ends))
    return out


def repeated_group_folds(
    df: DataFrame, target: str, group: str, k: int = 5, repeats: int = 5, seed: int = S.BASE_SEED
) -> DataFrame:
    """(record_id, target, group, rep, fold) with whole groups in one fold, balanced by size and class.

    Groups are counted once. Groups of equal size and positives are interchangeable, so a small table of quotas per
    stratum decides how many go to each fold, and the hash order inside the stratum decides which. Large groups are
    strata of their own; their rows get the fold from a small broadcast table and are never shuffled by group.
    """
    counts = class_counts(df, target)
    total = sum(counts.values())
    if df.where(F.col(group).isNull()).limit(1).count():
        raise SplitError("every row needs a group")
    groups = df.groupBy(F.col(group).alias("group_id")).agg(F.count("*").alias("n"), F.sum(target).alias("pos"))
    strata_of = stored(_strata(groups, total, k), "groups")
    strata = strata_of.groupBy("stratum").agg(
        F.count("*").alias("m"), F.sum("n").alias("rows"), F.sum("pos").alias("positives")
    ).collect()  # at most a few ten thousand rows by construction
    n_groups = sum(s["m"] for s in strata)
    if n_groups < k:
        raise SplitError(f"{n_groups} groups cannot fill {k} folds")
    spark = df.sparkSession
    quotas = spark.createDataFrame(_quotas(strata, k, repeats, seed), "stratum string, rep int, ends array<long>")

    small = strata_of.where(~F.col("stratum").startswith("g"))
    reps = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("rep")
    drawn = small.select("group_id", "stratum", reps).withColumn(
        "_draw", O.draw_key(seed, "groups", F.col("rep"), F.col("group_id"))
    )
    largest = max((s["m"] for s in strata), default=1)
    ranked = O.rank_by_draw(drawn, ["rep", "stratum"], "_draw", "group_id", largest)
    dealt = ranked.join(F.broadcast(quotas), ["stratum", "rep"]).select(  # strata x repeats, bounded above
        "group_id", "rep", F.size(F.filter("ends", lambda e: e < F.col("position"))).alias("fold")
    )
    alone = quotas.where(F.col("stratum").startswith("g")).select(
        F.expr("cast(substr(stratum, 2) as bigint)").alias("group_id"),
        "rep",
        F.size(F.filter("ends", lambda e: e < 1)).alias("fold"),
    )
    rows = df.select(S.ID, target, F.col(group).alias("group_id"))
    out = join_hot_apart(rows, alone, dealt, ["group_id"])
    return out.select(S.ID, target, F.col("group_id").alias(group), "rep", "fold")


# ---------------------------------------------------------------- metadata and invariants


def fold_metadata(folds: DataFrame, target: str) -> DataFrame:
    """(rep, fold, n_train, n_test, train_prevalence, test_prevalence); train = total of the rep minus the fold."""
    g = folds.groupBy("rep", "fold").agg(F.count("*").alias("n_test"), F.sum(target).cast("double").alias("_pos"))
    rep = W.partitionBy("rep")  # k rows per rep
    n_all, pos_all = F.sum("n_test").over(rep), F.sum("_pos").over(rep)
    return g.select(
        "rep",
        "fold",
        (n_all - F.col("n_test")).alias("n_train"),
        "n_test",
        ((pos_all - F.col("_pos")) / (n_all - F.col("n_test"))).alias("train_prevalence"),
        (F.col("_pos") / F.col("n_test")).alias("test_prevalence"),
    )


def coverage(folds: DataFrame) -> DataFrame:
    """(rep, records, min_times, max_times): each record must be tested exactly once per repeat."""
    per = folds.groupBy("rep", S.ID).count()
    return per.groupBy("rep").agg(
        F.count("*").alias("records"), F.min("count").alias("min_times"), F.max("count").alias("max_times")
    )


def _fold_counts(folds: DataFrame, group: str, k: int) -> DataFrame:
    return folds.groupBy("rep", group).agg(
        *[sum_when(F.col("fold") == f).cast("long").alias(f"c{f}") for f in range(k)]
    )


def group_leakage(folds: DataFrame, group: str, k: int) -> DataFrame:
    """(rep, fold, crossing_groups, affected_test_rows): groups that lie on both sides of a fold.

    One aggregation to counts per (rep, group, fold): a group crosses fold f if it has rows in f and elsewhere.
    """
    per = _fold_counts(folds, group, k)
    total = sum((F.col(f"c{f}") for f in range(k)), F.lit(0))
    cells = per.select(
        "rep",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f).alias("fold"),
                        ((F.col(f"c{f}") > 0) & (F.col(f"c{f}") < total)).alias("crosses"),
                        F.col(f"c{f}").alias("rows"),
                    )
                    for f in range(k)
                ]
            )
        ),
    )
    return cells.groupBy("rep", "fold").agg(
        sum_when(F.col("crosses")).cast("long").alias("crossing_groups"),
        sum_when(F.col("crosses"), F.col("rows")).cast("long").alias("affected_test_rows"),
    )


def group_isolation(folds: DataFrame, group: str) -> DataFrame:
    """(rep, groups, split_groups): the number of groups with rows in more than one fold must be zero."""
    per = folds.groupBy("rep", group).agg(F.min("fold").alias("lo"), F.max("fold").alias("hi"))
    return per.groupBy("rep").agg(
        F.count("*").alias("groups"), sum_when(F.col("lo") != F.col("hi")).cast("long").alias("split_groups")
    )


def fold_violations(folds: DataFrame, target: str) -> DataFrame:
    """(rep, fold, one_class_test, one_class_train) flags."""
    m = fold_metadata(folds, target)
    return m.select(
        "rep",
        "fold",
        F.col("test_prevalence").isin(0.0, 1.0).alias("one_class_test"),
        F.col("train_prevalence").isin(0.0, 1.0).alias("one_class_train"),
    )


def check_folds(folds: DataFrame, target: str, group: str | None = None) -> DataFrame:
    """Raise SplitError unless each record is tested once per repeat, both sides have both classes, groups stay whole."""
    bad = coverage(folds).where((F.col("min_times") != 1) | (F.col("max_times") != 1)).limit(1).collect()
    if bad:
        raise SplitError(f"repeat {bad[0]['rep']} does not test each record exactly once")
    one = fold_violations(folds, target).where("one_class_test or one_class_train").limit(1).collect()
    if one:
        raise SplitError(f"rep {one[0]['rep']} fold {one[0]['fold']} has a single class on one side")
    if group and group_isolation(folds, group).where("split_groups > 0").limit(1).count():
        raise SplitError("a group lies on both sides of a split")
    return folds


# ---------------------------------------------------------------- samples and sets


TOP_ROWS = 100_000  # up to here a top-n heap per task is best; larger samples are ranked in ranges


def _first_by_draw(keyed: DataFrame, n: int) -> DataFrame:
    """The first n rows in hash order.

    For a top-n heap, rows far behind the n-th are filtered out first by the leading bits of the hash, so that it sees about
    n rows and not n per task; should too few rows pass, all are used. Larger samples are ranked in ranges.
    """
    total = keyed.count()
    if n > TOP_ROWS:
        ranked = O.rank_by_draw(keyed, [], "_draw", S.ID, total, out="_position")
        return ranked.where(F.col("_position") <= n).drop("_draw", "_position")
    near = n + 10 * math.sqrt(n) + 100
    if near < total:
        lead = F.conv(F.substring("_draw", 1, 8), 16, 10).cast("long")
        some = keyed.where(lead < F.lit(math.ceil(near / total * 2**32)))
        keyed = some if some.count() >= n else keyed
    return keyed.orderBy("_draw", S.ID).limit(n).drop("_draw")


def balanced_sample(df: DataFrame, target: str, n: int, seed: int = S.BASE_SEED) -> DataFrame:
    """n // 2 positives and n - n // 2 negatives by hash order; all rows of a class that has fewer."""
    keyed = df.withColumn("_draw", O.draw_key(seed, "balanced", F.col(S.ID)))
    positive = _first_by_draw(keyed.where(F.col(target) == 1), n // 2)
    return positive.unionByName(_first_by_draw(keyed.where(F.col(target) == 0), n - n // 2))


def sample(df: DataFrame, n: int, seed: int = S.BASE_SEED, tag: str | int = "sample") -> DataFrame:
    """n rows without replacement, the first n in hash order."""
    return _first_by_draw(df.withColumn("_draw", O.draw_key(seed, tag, F.col(S.ID))), n)


def head(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(S.ID).limit(n)


def derive_seed(base: int, *tags: str | int | Column) -> Column:
    """First four bytes, big-endian, of SHA-256 over base and tags joined by ``|``."""
    cols = [t.cast("string") if isinstance(t, Column) else F.lit(str(t)) for t in tags]
    digest = F.sha2(F.concat_ws("|", F.lit(str(base)), *cols), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def keys_minus(a: DataFrame, b: DataFrame, key: str = S.ID) -> DataFrame:
    return a.join(b.select(key), key, "left_anti")


def keys_common(a: DataFrame, b: DataFrame, key: str = S.ID) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def stacked(*tables: DataFrame) -> DataFrame:
    """Union that keeps duplicates, columns by name."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
