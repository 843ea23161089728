"""Runs registered queries next to their SQL in DuckDB and compares rows.

As a script: ``python tests/oracle.py [name prefix ...]`` (sf0.01 unless SF_DIR says otherwise).
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, float):
        return f"f{v:.9f}" if v != 0 else "f0.000000000"
    if isinstance(v, int):
        return f"i{v}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return f"{type(v).__name__[0]}{v}"


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    """None if equal, else a message."""
    df = fn(spark, sf_dir)
    sc, sr = table(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    dc, dr = table([d[0] for d in cur.description], cur.fetchall())
    if sc != dc:
        return f"columns differ: {sc} vs {dc}"
    if len(sr) != len(dr):
        return f"row counts differ: {len(sr)} vs {len(dr)}"
    if not sr:
        return "no rows"
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if bad:
        return f"{len(bad)} of {len(sr)} rows differ; {sc}\n   spark {bad[0][0]}\n   sql   {bad[0][1]}"
    return None


def main():
    from riskbench import catalog
    from riskbench.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("oracle", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    want = sys.argv[1:]
    failed = []
    for name, fn in catalog.QUERIES.items():
        if want and not any(name.startswith(w) for w in want):
            continue
        t = time.time()
        try:
            if name in catalog.SQL:
                msg = compare(spark, con, fn, catalog.SQL[name], sf_dir)
                kind = "sql "
            else:
                rows = fn(spark, sf_dir).collect()
                msg, kind = (None if rows else "no rows"), f"rows={len(rows)}"
        except Exception as e:  # report and go on
            msg, kind = f"{type(e).__name__}: {str(e)[:600]}", "err "
        print(f"{'ok  ' if msg is None else 'FAIL'} {kind} {name} {time.time() - t:.1f}s" + (f"\n   {msg}" if msg else ""), flush=True)
        if msg:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    spark.stop()


if __name__ == "__main__":
    main()
