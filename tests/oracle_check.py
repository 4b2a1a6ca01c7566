"""Run registered queries against their DuckDB oracles, like the driver does:
row count, column names, and an order-insensitive comparison of values.

    python tests/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, key, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    snames = sdf.columns
    t1 = time.time()
    if sql is None:
        return dict(key=key, ok=True, rows=len(srows), note="rows-only", spark_s=round(t1 - t0, 2))
    res = con.execute(sql)
    dnames = [d[0] for d in res.description]
    drows = res.fetchall()
    out = dict(key=key, rows=len(srows), oracle_rows=len(drows), spark_s=round(t1 - t0, 2))
    if sorted(snames) != sorted(dnames):
        out.update(ok=False, note=f"columns {snames} vs {dnames}")
        return out
    a, b = rows_of(snames, srows), rows_of(dnames, drows)
    if a != b:
        diff_a = [r for r in a if r not in set(b)][:3]
        diff_b = [r for r in b if r not in set(a)][:3]
        out.update(ok=False, note=f"values differ: spark {diff_a} oracle {diff_b}")
        return out
    out["ok"] = True
    return out


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as E

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "8").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for k in keys or list(qs):
        try:
            r = compare(spark, con, k, qs[k], sqls.get(k), sf_dir)
        except Exception as e:  # report and go on
            r = dict(key=k, ok=False, note=f"error {type(e).__name__}: {str(e)[:400]}")
        bad += not r["ok"]
        print(r, flush=True)
    print(f"FAILED {bad} of {len(keys or qs)}")


if __name__ == "__main__":
    main()
