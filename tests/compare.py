"""Runs queries beside their SQL and compares order-insensitively: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def canon(rows: list, columns: list[str]) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v: object) -> str:
        if v is None or (isinstance(v, float) and v != v):
            return "∅"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
            return f"{float(v):.6f}".replace("-0.000000", "0.000000")
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir: str, name: str, fn, sql: str | None) -> str:
    t = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return f"{name}: {len(got)} rows, {took:.1f} s, no SQL"
    cur = duck(sf_dir).execute(sql)
    columns = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"{name}: FAIL columns {sorted(df.columns)} against {sorted(columns)}"
    a, b = canon(got, df.columns), canon(want, columns)
    if a == b:
        return f"{name}: ok, {len(got)} rows, {took:.1f} s"
    left, right = set(a) - set(b), set(b) - set(a)
    return f"{name}: FAIL {len(a)} rows against {len(b)}; only here {sorted(left)[:4]}; only there {sorted(right)[:4]}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tickloom.session import session

    spark = session()
    qs, sqls = entry.queries(), entry.oracle_sql()
    for n in sys.argv[2:] or list(qs):
        if n in qs:
            try:
                print(compare(spark, sys.argv[1], n, qs[n], sqls.get(n)), flush=True)
            except Exception as e:  # noqa: BLE001
                print(f"{n}: ERROR {str(e)[:600]}", flush=True)
        else:
            for k in [k for k in qs if k.startswith(n)]:
                try:
                    print(compare(spark, sys.argv[1], k, qs[k], sqls.get(k)), flush=True)
                except Exception as e:  # noqa: BLE001
                    print(f"{k}: ERROR {str(e)[:600]}", flush=True)
