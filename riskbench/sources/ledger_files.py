"""Ledger files: append-only Parquet runs behind a manifest, and quoted CSV in both directions."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

TEXT = ["model", "config_json"]
WHOLE = {c: "bigint" for c in ("n", "n_pos", "tn", "fp", "fn", "tp", "n_train", "n_trainable_params")} | {"rep": "int", "fold": "int"}


RUN = ["run_id", "run_no", "run_ts"]
_MANIFEST = "run_id string, run_no bigint, run_ts timestamp, rows bigint"


def runs(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, run_no, run_ts, rows) of the published runs, from the manifest: one small file a run. Empty if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/manifest")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).option("recursiveFileLookup", "true").parquet(f"{path.rstrip('/')}/manifest")


def append(ledger: DataFrame, path: str, extra: dict | None = None) -> str:
    """Append fold rows as one run, a folder per model, with ``extra`` as further columns; returns the run's id.

    The rows are written first and the manifest entry last. A run that fails half-way is never read, and existing rows are
    never rewritten. ``run_no`` is the append order; runs appended at the same time may share it, and ``run_ts`` tells them apart.
    """
    spark, root = ledger.sparkSession, path.rstrip("/")
    taken = [c for c in RUN if c in ledger.columns or c in (extra or {})]
    if taken:
        raise ValueError(f"columns {taken} belong to the ledger")
    run_id = f"run{uuid.uuid4().hex}"
    run_no = 1 + (runs(spark, root).agg(F.max("run_no")).first()[0] or 0)
    now = datetime.now(timezone.utc)
    more = {k: F.lit(v) for k, v in (extra or {}).items()} | {"run_no": F.lit(run_no).cast("long"), "run_ts": F.lit(now)}
    folder = f"{root}/rows/run_id={run_id}"
    out = ledger.withColumns(more)
    out.write.partitionBy("model").parquet(folder)
    n = spark.read.schema(out.schema).parquet(folder).count()
    if n:  # a run without rows has nothing to publish
        spark.createDataFrame([(run_id, run_no, now, n)], _MANIFEST).coalesce(1).write.parquet(f"{root}/manifest/{run_id}")
    return run_id


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the published runs. A column that only some runs have is NULL in the others; its type must agree."""
    root = path.rstrip("/")
    done = [r["run_id"] for r in runs(spark, root).select("run_id").collect()]  # one row a run
    if not done:
        raise FileNotFoundError(f"no published run below {path}")
    scan = spark.read.option("mergeSchema", "true").option("basePath", f"{root}/rows")
    rows = scan.parquet(*[f"{root}/rows/run_id={r}" for r in sorted(done)])
    return rows.withColumns({c: F.col(c).cast("string") for c in ("model", "run_id")})  # folder names may look like numbers


def write_csv(ledger: DataFrame, path: str) -> None:
    """Quoted CSV: embedded quotes are doubled."""
    ledger.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quote-aware scan. Short rows are dropped, non-numeric cells are missing, rows without a model are dropped.

    The configuration stays text; ``from_json`` in the reports turns bad JSON into an empty one.
    """
    names = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path).columns
    schema = T.StructType([T.StructField(c.strip(), T.StringType()) for c in names])
    raw = (
        spark.read.option("header", True).option("quote", '"').option("escape", '"').option("mode", "DROPMALFORMED")
        .schema(schema).csv(path)
    )
    number = {
        c: F.expr(f"try_cast(trim(`{c}`) as {WHOLE.get(c, 'double')})") for c in schema.names if c not in TEXT
    }
    return raw.withColumns(number).where(F.col("model").isNotNull() & (F.trim("model") != ""))
