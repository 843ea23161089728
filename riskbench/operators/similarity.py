"""Squared-cosine similarity of all rows, without listing all pairs.

The similarity of two unit vectors is k(x, y) = (x . y)^2, the inner product of their outer products. So the matrix of all
pairs is never needed as rows: sums over it come from one d x d moment matrix, and single entries come from two equi-joins
on the pairs that are asked for. ``pair_features`` gives the explicit map whose inner products are the similarities, for
any linear method on top.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import is_complete, shared_dir

MAX_SAMPLES = 2000
SECONDS_PER_PAIR = 0.004


class BudgetError(ValueError):
    """An all-pairs evaluation is too large."""


def width_of(df: DataFrame, vector: str) -> int:
    """The common width of the vectors; differing widths or missing vectors are an error."""
    r = df.agg(F.min(F.size(vector)).alias("lo"), F.max(F.size(vector)).alias("hi"), F.count(F.when(F.col(vector).isNull(), 1)).alias("nulls")).first()
    if r["lo"] is None or r["lo"] != r["hi"] or r["nulls"]:
        raise ValueError(f"vectors must have one width, found {r['lo']} to {r['hi']}, {r['nulls']} missing")
    return r["lo"]


def normalised(df: DataFrame, vector: str, out: str = "unit") -> DataFrame:
    """Add the unit vector in double precision; a zero vector is an error when the row is evaluated."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    safe = F.when(norm > 0, norm).otherwise(F.raise_error(F.lit("zero vector cannot be normalised")).cast("double"))
    return df.withColumn("_norm", safe).withColumn(out, F.transform(vector, lambda x: x.cast("double") / F.col("_norm"))).drop("_norm")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def moment(units: DataFrame, unit: str, width: int, by: Sequence[str] = ()) -> DataFrame:
    """(by..., i, j, m): sums of products of unit coordinates. width * width rows per group.

    Each task adds up its own rows as matrix products and emits one matrix per group it has seen; Spark adds the tasks' matrices.
    """
    by = list(by)
    key_fields = ", ".join(f"{units.schema[c].name} {units.schema[c].dataType.simpleString()}" for c in by)
    schema = (key_fields + ", " if by else "") + "i int, j int, m double"

    def partial(batches):
        import numpy as np
        import pandas as pd

        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            groups = pdf.groupby(by, dropna=False)[unit] if by else [((), pdf[unit])]
            for k, v in groups:
                if len(v):
                    x = np.stack(v.to_numpy())
                    sums[k] = sums.get(k, 0.0) + x.T @ x
        i, j = np.divmod(np.arange(width * width), width)
        for k, m in sums.items():
            keys = dict(zip(by, k if isinstance(k, tuple) else (k,)))
            yield pd.DataFrame({**keys, "i": i.astype("int32"), "j": j.astype("int32"), "m": m.ravel()})

    return units.select(*by, unit).mapInPandas(partial, schema).groupBy(*by, "i", "j").agg(F.sum("m").alias("m"))


MAX_MOMENTS = 8_000_000


def _matrices(df: DataFrame, vector: str, by: str, width: int) -> dict:
    """Moment matrix of each group, on the driver to be sent to the tasks: groups x width^2 numbers, checked.

    The group is a class label or a fold. Its number of levels is counted first.
    """
    import numpy as np

    levels = df.select(by).distinct().limit(MAX_MOMENTS // (width * width) + 1).count()
    if levels * width * width > MAX_MOMENTS:
        raise BudgetError(f"{levels} groups of {width} x {width} moments are too many to send to every task")
    out: dict = {}
    for r in moment(normalised(df, vector), "unit", width, [by]).collect():
        out.setdefault(r[by], np.zeros((width, width)))[r["i"], r["j"]] = r["m"]
    return out


def _quadratic_sums(units: DataFrame, keep: Sequence[str], matrices: dict, against: str, against_type: str) -> DataFrame:
    """(keep..., against, total): x' M x of each row with each group's moment matrix."""
    fields = ", ".join(f"{units.schema[c].name} {units.schema[c].dataType.simpleString()}" for c in keep)

    def forms(batches):
        import numpy as np

        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["unit"].to_numpy())
            for level, m in matrices.items():
                out = pdf[list(keep)].copy()
                out[against] = level
                out["total"] = ((x @ m) * x).sum(1)
                yield out

    return units.select(*keep, "unit").mapInPandas(forms, f"{fields}, {against} {against_type}, total double")


def row_sums(df: DataFrame, key: str, vector: str, by: str) -> DataFrame:
    """(key, own group, against, similarity_sum): similarity of each row summed over all rows of each group, itself included.

    Linear in the rows: one pass for the groups' moment matrices, one for the rows.
    """
    width = width_of(df, vector)
    mats = _matrices(df, vector, by, width)
    out = _quadratic_sums(normalised(df, vector), [key, by], mats, "against", df.schema[by].dataType.simpleString())
    return out.withColumnRenamed("total", "similarity_sum")


def total_similarity(df: DataFrame, vector: str) -> DataFrame:
    """One row: rows, sum over all ordered pairs, mean over unordered pairs of different rows."""
    width = width_of(df, vector)
    units = normalised(df, vector).select("unit")
    n = units.count()
    s = moment(units, "unit", width).agg(F.sum(F.col("m") * F.col("m")).alias("all_pairs"))
    pairs = n * (n - 1)
    return s.select(
        F.lit(n).cast("long").alias("n"), "all_pairs", F.try_divide(F.col("all_pairs") - n, F.lit(float(pairs))).alias("mean_similarity")
    )


def cross_mean(test: DataFrame, train: DataFrame, key: str, vector: str, by: str) -> DataFrame:
    """(key, by, rows, mean_similarity): mean similarity of each test row to the training rows of each group."""
    width = width_of(train, vector)
    if width_of(test, vector) != width:
        raise ValueError("test and training vectors differ in width")
    mats = _matrices(train, vector, by, width)
    sizes = train.groupBy(by).agg(F.count("*").alias("rows"))  # one row per group, counted in _matrices
    out = _quadratic_sums(normalised(test, vector), [key], mats, by, train.schema[by].dataType.simpleString())
    return out.join(F.broadcast(sizes), by).select(key, by, "rows", (F.col("total") / F.col("rows")).alias("mean_similarity"))


def pair_similarity(df: DataFrame, pairs: DataFrame, key: str, vector: str) -> DataFrame:
    """(i, j, ..., similarity) for the pairs asked for: two equi-joins, linear in the pairs. The diagonal is 1."""
    units = normalised(df, vector)
    a = units.select(F.col(key).alias("i"), F.col("unit").alias("_u"))
    b = units.select(F.col(key).alias("j"), F.col("unit").alias("_v"))
    d = dot(F.col("_u"), F.col("_v"))
    return pairs.join(a, "i").join(b, "j").withColumn("similarity", F.when(F.col("i") == F.col("j"), 1.0).otherwise(d * d)).drop("_u", "_v")


def pair_features(df: DataFrame, vector: str, keep: Sequence[str], out: str = "features") -> DataFrame:
    """Explicit map: width * (width + 1) / 2 numbers whose inner product is the similarity."""
    width = width_of(df, vector)
    root2 = F.sqrt(F.lit(2.0))
    cells = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(width - 1)),
            lambda i: F.transform(
                F.sequence(i, F.lit(width - 1)),
                lambda j: F.get("unit", i) * F.get("unit", j) * F.when(i == j, F.lit(1.0)).otherwise(root2),
            ),
        )
    )
    return normalised(df, vector).select(*keep, cells.alias(out))


def slice_pairs(pairs: DataFrame, rows: DataFrame, cols: DataFrame, key: str) -> DataFrame:
    """The requested pairs whose ends lie in two row sets."""
    left = pairs.join(rows.select(F.col(key).alias("i")), "i", "left_semi")
    return left.join(cols.select(F.col(key).alias("j")), "j", "left_semi")


def kernel_checks(entries: DataFrame, units: DataFrame, unit: str = "unit") -> DataFrame:
    """One row: largest distance of the diagonal from 1 over all rows, largest |k(i,j) - k(j,i)| over entries given both ways."""
    d = dot(F.col(unit), F.col(unit))
    diag = units.agg(F.count("*").alias("rows"), F.max(F.abs(d * d - 1)).alias("diagonal_gap"))
    lo, hi = F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi")
    both = entries.groupBy(lo, hi).agg((F.max("similarity") - F.min("similarity")).alias("gap"), F.count("*").alias("n"))
    sym = both.agg(F.sum("n").alias("entries"), F.max("gap").alias("gap"))
    r = sym.first()  # one row
    return diag.withColumns({"entries": F.lit(r["entries"]).cast("long"), "symmetry_gap": F.lit(r["gap"]).cast("double")})


def pair_budget(n_train: Column, n_test: Column, seconds_per_pair: float = SECONDS_PER_PAIR) -> dict[str, Column]:
    """Pairs of a full evaluation: strict upper triangle of the training rows plus test x training."""
    train = (n_train * (n_train - 1) / 2).cast("long")
    test = (n_test * n_train).cast("long")
    return {"train_pairs": train, "test_pairs": test, "total_pairs": train + test, "est_seconds": (train + test) * F.lit(seconds_per_pair)}


def guard_pairs(n: int, max_samples: int = MAX_SAMPLES, hard: bool = True) -> str | None:
    """Refuse a listing of all pairs beyond the ceiling, or return the warning if ``hard`` is off."""
    if n <= max_samples:
        return None
    msg = f"{n} rows make {n * (n - 1) // 2} pairs; the ceiling is {max_samples} rows"
    if hard:
        raise BudgetError(msg)
    return msg


def content_key(df: DataFrame, key: str, vector: str, settings: str = "") -> str:
    """Key of the data and settings, independent of row order: count, and sums of two row hashes."""
    h = F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.array_join(F.transform(vector, lambda x: F.hex(x.cast("double").cast("string").cast("binary"))), ",")), 256)
    part = lambda start: F.sum(F.conv(F.substring(h, start, 12), 16, 10).cast("decimal(38,0)"))
    r = df.agg(F.count("*").alias("n"), part(1).alias("a"), part(13).alias("b"), part(25).alias("c")).first()
    import hashlib

    return hashlib.sha256(f"{r['n']}|{r['a']}|{r['b']}|{r['c']}|{settings}".encode()).hexdigest()


def cached(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write under a content key unless it is there already, and read it back. By default below the shared folder, for all jobs."""
    path = f"{(folder or shared_dir(df.sparkSession) + '/riskbench/cache').rstrip('/')}/{name}"
    if not is_complete(df.sparkSession, path):  # what a failed job left is written anew
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
