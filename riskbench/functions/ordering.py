"""Ranks and running sums that do not put a whole group on one task.

A window over ``partitionBy(model, fold)`` or ``partitionBy(class)`` sorts the group on one task. That is right for
groups of a few million rows and wrong beyond. Both helpers here therefore cut large groups into ranges of the order
key, work inside each range, and add the total of the ranges before it. The result is the same, row for row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..session import stored
from .numbers import count_below

ROWS_PER_RANGE = 4_000_000
MAX_CUTS = 4096
COPIES_PER_BLOCK = 1_000_000  # copies of one row that a task writes out
_FAN = 64


def fit_cuts(
    df: DataFrame,
    groups: Sequence[str],
    order: str,
    row_bound: int | None = None,
    rows_per_range: int | None = None,
) -> DataFrame | None:
    """Cut points of the order key for every group above ``rows_per_range`` rows; None if there is no such group.

    ``row_bound`` is a known upper bound of any group's rows (for example the row count in the Parquet footers): when it is
    small enough, no job runs. The result holds at most one cut per ``rows_per_range`` input rows, so it stays small.
    """
    rows_per_range = rows_per_range or ROWS_PER_RANGE
    if row_bound is not None and row_bound <= rows_per_range:
        return None
    groups = list(groups)
    sizes = df.where(F.col(order).isNotNull()).groupBy(*groups).count().where(F.col("count") > rows_per_range).collect()
    if not sizes:
        return None
    grid = min(MAX_CUTS, max(r["count"] for r in sizes) // rows_per_range + 1)
    probs = [i / (grid + 1) for i in range(1, grid + 1)]
    large = df.sparkSession.createDataFrame(
        [tuple(r[g] for g in groups) for r in sizes] if groups else [(1,)],
        T.StructType([df.schema[g] for g in groups]) if groups else "one int",
    )
    big = df.join(F.broadcast(large), groups, "left_semi") if groups else df
    cuts = big.groupBy(*groups).agg(F.percentile_approx(F.col(order), probs, 10_000).alias("_grid"), F.count(order).alias("_n"))
    # The grid suits the largest group; a smaller one keeps as many of its points, evenly spaced, as its own size asks for.
    own = F.least(F.lit(grid), F.floor(F.col("_n") / rows_per_range) + 1).cast("int")
    evenly = F.transform(F.sequence(F.lit(1), own), lambda i: F.get("_grid", F.round(i * (grid + 1) / (own + 1)).cast("int") - 1))
    cuts = cuts.select(*groups, F.array_sort(F.array_distinct(evenly)).alias("_cuts"))
    rows = [tuple(r) for r in cuts.collect()]
    return df.sparkSession.createDataFrame(rows, T.StructType([df.schema[g] for g in groups] + [cuts.schema["_cuts"]]))


def _range_of(cuts: Column, x: Column) -> Column:
    """Number of cuts below ``x``, in two steps of at most 64 comparisons each."""
    coarse = F.filter(cuts, lambda e, i: (i + 1) % _FAN == 0)
    step = count_below(coarse, x)
    return step * _FAN + count_below(F.slice(cuts, step * _FAN + 1, _FAN), x)


def with_range(df: DataFrame, groups: list[str], order: str, cuts: DataFrame | None) -> DataFrame:
    """Add ``_range``, the 0-based place of a row's range in the ascending order; one range where nothing is cut."""
    if cuts is None:
        return df.withColumn("_range", F.lit(0))
    if groups:
        joined = df.join(F.broadcast(cuts), groups, "left")  # at most one cut per ROWS_PER_RANGE input rows
    else:
        joined = df.withColumn("_cuts", F.array(*[F.lit(float(c)) for c in cuts.first()["_cuts"]]))
    return joined.withColumn("_range", F.coalesce(_range_of(F.col("_cuts"), F.col(order)), F.lit(0))).drop("_cuts")


def running_sums(
    df: DataFrame,
    groups: Sequence[str],
    order: str,
    values: Sequence[str],
    descending: bool = False,
    cuts: DataFrame | None = None,
) -> DataFrame:
    """Add ``cum_<v>`` (up to and including the row) and ``total_<v>`` for each value column.

    ``order`` must be unique inside a group, as it is after aggregating to distinct values, and not null.
    """
    groups = list(groups)

    def by(c: str) -> Column:
        return F.col(c).desc() if descending else F.col(c).asc()

    if cuts is None:
        whole = W.partitionBy(*groups)
        upto = whole.orderBy(by(order)).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns(
            {f"cum_{v}": F.sum(v).over(upto) for v in values} | {f"total_{v}": F.sum(v).over(whole) for v in values}
        )

    ranged = with_range(df, groups, order, cuts)
    keys = groups + ["_range"]
    before = W.partitionBy(*groups).orderBy(by("_range")).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys)
        .agg(*[F.sum(v).alias(v) for v in values])
        .select(
            *keys,
            *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_before_{v}") for v in values],
            *[F.sum(v).over(W.partitionBy(*groups)).alias(f"total_{v}") for v in values],
        )
    )
    upto = W.partitionBy(*keys).orderBy(by(order)).rowsBetween(W.unboundedPreceding, 0)
    if groups:
        joined = ranged.join(offsets, keys)
    else:
        # One row per range, MAX_CUTS + 1 at most. Null-safe, as from a plain equality the planner infers a filter on the sums
        # that holds the expression behind ``_range``, whose column they lack.
        joined = ranged.join(F.broadcast(offsets.withColumnRenamed("_range", "_at")), F.col("_range").eqNullSafe(F.col("_at"))).drop("_at")
    out = joined.withColumns({f"cum_{v}": F.sum(v).over(upto) + F.col(f"_before_{v}") for v in values})
    return out.drop("_range", *[f"_before_{v}" for v in values])


def draw_key(seed: int, *parts: str | int | Column) -> Column:
    """A reproducible uniform order key: the first 64 bits of SHA-256 over seed, tags and columns."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), *cols), 256), 1, 16)


def rank_by_draw(
    df: DataFrame,
    groups: Sequence[str],
    draw: str,
    tie: str,
    largest_group: int,
    out: str = "position",
    rows_per_range: int | None = None,
) -> DataFrame:
    """1-based position in each group in the order of a ``draw_key`` column.

    The key is uniform, so equal slices of its leading 32 bits are equal shares of the rows; no cut points are fitted.
    """
    groups = list(groups)
    slices = max(1, -(-largest_group // (rows_per_range or ROWS_PER_RANGE)))
    if not groups:  # never the whole table on one task
        slices = max(slices, _FAN)
    if slices == 1:
        return df.withColumn(out, F.row_number().over(W.partitionBy(*groups).orderBy(draw, tie)).cast("long"))
    lead = F.conv(F.substring(draw, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    ranged = df.withColumn("_range", F.floor(lead * slices).cast("int"))
    keys = groups + ["_range"]
    counts = ranged.groupBy(*keys).agg(F.count("*").alias("_n"))
    if groups:
        before = W.partitionBy(*groups).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
        offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    else:
        total, rows = 0, []
        for r in sorted(tuple(r) for r in counts.collect()):  # one row per slice
            rows.append((r[0], total))
            total += r[1]
        offsets = F.broadcast(df.sparkSession.createDataFrame(rows, "_range int, _before long"))
    local = W.partitionBy(*keys).orderBy(draw, tie)
    return (
        ranged.join(offsets, keys)
        .withColumn(out, F.row_number().over(local) + F.col("_before"))
        .drop("_range", "_before")
    )


def number_rows(df: DataFrame, out: str, seed: int = 0, rows_per_range: int | None = None) -> DataFrame:
    """Every row with a number of its own, 1 to n in the order of a hash: the same on any cluster and for any file layout.

    Rows equal in every column are counted first, so a row that is repeated without end costs one row a task; its copies are
    then written out with their occurrence number, in blocks that are spread where there are many. The hash covers the row
    and its occurrence, so copies lie apart in the order and no range is hot. ``out`` is replaced if it is there; an empty
    table stays empty; NULLs are values like others.
    """
    names = [c for c in df.columns if c != out]
    counted = stored(df.groupBy(*names).agg(F.count("*").alias("_n")), "row-counts")
    last = F.col("_n") - 1
    few = counted.where(F.col("_n") <= COPIES_PER_BLOCK).select(*names, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_copy"))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / COPIES_PER_BLOCK))).alias("_block")
    spread = counted.where(F.col("_n") > COPIES_PER_BLOCK).select("*", block).repartition(F.xxhash64(*names, "_block"))
    first = F.col("_block") * COPIES_PER_BLOCK
    copies = F.explode(F.sequence(first, F.least(first + (COPIES_PER_BLOCK - 1), last))).alias("_copy")
    rows = few.unionByName(spread.select(*names, copies))
    text = F.to_json(F.struct(*names)) if names else F.lit("")
    drawn = rows.withColumn("_tie", F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("_copy").cast("string"), text), 256))
    drawn = drawn.withColumn("_draw", F.substring("_tie", 1, 16))
    total = counted.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    numbered = rank_by_draw(drawn, [], "_draw", "_tie", total, out, rows_per_range)
    return numbered.select(out, *names)
