"""JSON results: the audit report files and nested experiment results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ARM = "struct<auc:double,sd:double,delta:double,t_fold:double,t_seed:double,p_seed:double,ci_low:double,ci_high:double,significant:boolean,equiv_bound:double,equivalent_at_margin:boolean>"
NESTED = f"results map<string, map<string, {ARM}>>"


def read_nested_results(spark: SparkSession, path: str) -> DataFrame:
    """(regime, arm, auc, sd, ...): a map of regimes of arms, flattened to rows."""
    df = spark.read.schema(NESTED).option("multiLine", True).json(path)
    per_regime = df.select(F.explode("results").alias("regime", "arms"))
    return per_regime.select("regime", F.explode("arms").alias("arm", "r")).select("regime", "arm", "r.*")


def write_nested_results(rows: DataFrame, path: str) -> None:
    """Rows (regime, arm, ...) as one nested JSON document. There are few regimes and arms, whatever the data."""
    value = F.struct(*[c for c in rows.columns if c not in ("regime", "arm")])
    arms = rows.groupBy("regime").agg(F.map_from_entries(F.collect_list(F.struct(F.col("arm"), value.alias("v")))).alias("arms"))
    one = arms.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("regime", "arms"))).alias("results"))
    one.coalesce(1).write.mode("overwrite").json(path)


AUDIT_SCHEMA = "section string, key string, level string, metric string, value double"


def write_audit(report: DataFrame, path: str) -> str:
    """The audit rows as JSON lines, and the same numbers as Markdown text (returned). The report has a fixed number of rows."""
    report.coalesce(1).write.mode("overwrite").json(path)
    rows = read_audit(report.sparkSession, path).orderBy("section", "key", "level", "metric").collect()
    lines, section = ["# Data audit", ""], None
    for r in rows:
        if r["section"] != section:
            section = r["section"]
            lines += ["", f"## {section}", "", "| key | level | metric | value |", "|---|---|---|---:|"]
        value = "-" if r["value"] is None else f"{r['value']:.6g}"
        lines.append(f"| {r['key'] or ''} | {r['level'] or ''} | {r['metric']} | {value} |")
    return "\n".join(lines) + "\n"


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).json(path)
