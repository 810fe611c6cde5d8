"""Run a registered query next to its SQL on the same tables and compare the results."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(d: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def _key(row):
    return tuple((v is not None, f"{v:.4f}" if isinstance(v, float) else str(v)) for v in row)


def compare(spark, con, name: str, query, sql: str | None, d: str):
    """(ok, message, spark seconds)"""
    t = time.time()
    df = query(spark, d)
    cols = sorted(df.columns)
    got = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return len(got) > 0, f"{len(got)} rows (no SQL)", took
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    if sorted(names) != cols:
        return False, f"columns {sorted(set(names) ^ set(cols))}", took
    at = [names.index(c) for c in cols]
    want = [tuple(_norm(r[i]) for i in at) for r in cur.fetchall()]
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)}", took
    got.sort(key=_key)
    want.sort(key=_key)
    exact = sum(a == b for a, b in zip(got, want))
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    close = all(
        x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6)) for a, b in bad for x, y in zip(a, b)
    )
    types = {c: type(v).__name__ for c, v in zip(cols, next(iter(got), ()))}
    kinds = {c: type(v).__name__ for c, v in zip(cols, next(iter(want), ()))}
    drift = {c: (types[c], kinds[c]) for c in types if types[c] != kinds[c] and "NoneType" not in (types[c], kinds[c])}
    note = f"{len(got)} rows, {exact} exact" + (f", types {drift}" if drift else "")
    if bad and not close:
        a, b = bad[0]
        diff = {c: (x, y) for c, x, y in zip(cols, a, b) if x != y}
        return False, note + f"; first difference {diff} in {dict(zip(cols, a))}", took
    return len(got) > 0 and not drift, note + ("" if not bad else " (rest within tolerance)"), took


def main(names):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    d = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, sqls = duck(d), entry.queries(), entry.oracle_sql()
    failed = []
    for n in names or qs:
        try:
            ok, msg, took = compare(spark, con, n, qs[n], sqls.get(n), d)
        except Exception as e:  # noqa: BLE001
            ok, msg, took = False, f"{type(e).__name__}: {str(e)[:700]}", 0.0
        print(f"{'ok  ' if ok else 'FAIL'} {n:28s} {took:6.1f}s {msg}", flush=True)
        if not ok:
            failed.append(n)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
