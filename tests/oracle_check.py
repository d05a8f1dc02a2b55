"""Compare registered queries with their SQL: python tests/oracle_check.py [--sf 0.01] [names...]"""

from __future__ import annotations

import glob
import os
import sys
import time
import traceback

import duckdb
import numpy as np
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402


def session(cpus: str = "8") -> SparkSession:
    return (SparkSession.builder.master(f"local[{cpus}]").appName("check")
            .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
            .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
            .config("spark.procstats.blockRows", os.environ.get("BLOCK_ROWS", "131072")).getOrCreate())


def duck(folder: str):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and np.isnan(v)):
        return None
    if isinstance(v, (list, np.ndarray)):
        return tuple(norm(x) for x in v)
    if isinstance(v, bool) or isinstance(v, np.bool_):
        return bool(v)
    if isinstance(v, (float, np.floating)):
        return repr(float(v))
    if isinstance(v, (int, np.integer)):
        return int(v)
    return str(v)


def rows_of(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(repr(tuple(norm(r[i]) for i in order)) for r in rows)


def compare(spark, con, name, folder):
    df = entry.queries()[name](spark, folder)
    got = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows={len(got)}", True
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    gc, g = rows_of(got, df.columns)
    wc, w = rows_of(want, cols)
    if gc != wc:
        return f"columns differ {gc} {wc}", False
    if g != w:
        extra, lack = sorted(set(g) - set(w))[:3], sorted(set(w) - set(g))[:3]
        return f"rows {len(g)} vs {len(w)}\n   spark {extra}\n   duck  {lack}", False
    types = {c: str(t[1]) for c, t in zip(cols, cur.description)}
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    odd = [(c, t, types[c]) for c, t in df.dtypes if kinds.get(t, types[c]) != types[c]]
    return f"ok rows={len(g)}" + (f" TYPES {odd}" if odd else ""), not odd


def main():
    args = sys.argv[1:]
    sf = "0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i:i + 2]
    folder = f"/root/testdata/sf{sf}"
    spark, con = session(), duck(f"/root/testdata/sf{sf}")
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in entry.queries() if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    bad = []
    for n in names:
        t = time.time()
        try:
            text, ok = compare(spark, con, n, folder)
        except Exception as e:  # noqa: BLE001
            text, ok = f"{type(e).__name__}: {str(e)[:600]}", False
            if "-v" in args:
                traceback.print_exc()
        if not ok:
            bad.append(n)
        print(f"{'PASS' if ok else 'FAIL'} {n} {time.time() - t:.1f}s {text}", flush=True)
    print(f"{len(names) - len(bad)}/{len(names)} pass; failing: {bad}")


if __name__ == "__main__":
    main()
