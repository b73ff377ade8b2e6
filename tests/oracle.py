"""Compare registered queries with their SQL in DuckDB.

Run as a script: ``python tests/oracle.py [-t] [sf_dir] [query ...]``.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def _norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        col = df[c]
        if str(col.dtype).startswith(("datetime", "date")):
            df[c] = col.map(lambda v: "null" if pd.isna(v) else v.isoformat(" ").removesuffix(" 00:00:00"))
        elif pd.api.types.is_bool_dtype(col):
            df[c] = col.astype(str)
        elif pd.api.types.is_numeric_dtype(col):
            df[c] = col.astype(float).map(lambda v: "null" if v != v else repr(round(v, 6) + 0.0))
        else:
            df[c] = col.map(lambda v: "null" if v is None or v != v else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def compare(spark, con, sf_dir: str, run, sql: str | None) -> tuple[bool, str]:
    start = time.time()
    got = run(spark, sf_dir)
    names = sorted(got.columns)
    got = got.toPandas()
    took = time.time() - start
    if sql is None:
        return True, f"{len(got)} rows, no oracle, {took:.1f}s"
    start = time.time()
    want = con.execute(sql).fetchdf()
    took_sql = time.time() - start
    if names != sorted(want.columns):
        return False, f"columns {names} != {sorted(want.columns)}"
    if len(got) != len(want):
        return False, f"{len(got)} rows, oracle {len(want)}"
    a, b = _norm(got), _norm(want)
    if len(a) and not a.equals(b):
        bad = (a != b).any(axis=1)
        return False, f"{int(bad.sum())} of {len(a)} rows differ\n{a[bad].head(3)}\n{b[bad].head(3)}"
    return True, f"{len(got)} rows equal, {took:.1f}s (oracle {took_sql:.1f}s)"


if __name__ == "__main__":
    from outlay.session import local_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    skip = set(filter(None, os.environ.get("ORACLE_SKIP", "").split()))
    from __spark_entry__ import oracle_sql, queries
    from outlay.plans.registry import Entry

    sqls = oracle_sql()
    entries = {name: Entry(run, sqls.get(name)) for name, run in queries().items()}
    bad = []
    for name in args or [n for n in entries if n not in skip]:
        try:
            ok, text = compare(spark, con, sf, entries[name].run, entries[name].sql)
        except Exception as e:  # noqa: BLE001
            ok, text = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print("ok  " if ok else "FAIL", name, text, flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)
