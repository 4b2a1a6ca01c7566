"""Co-moment matrices against pairwise-complete formulas."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tablelens.operators import pairs


def brute(rows, i, j):
    both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
    n = len(both)
    if any(not math.isfinite(v) for p in both for v in p):
        return float("nan"), n
    if not n or len({x for x, _ in both}) == 1 or len({y for _, y in both}) == 1:
        return None, n
    mx, my = math.fsum(x for x, _ in both) / n, math.fsum(y for _, y in both) / n
    sxx, syy = math.fsum((x - mx) ** 2 for x, _ in both), math.fsum((y - my) ** 2 for _, y in both)
    return math.fsum((x - mx) * (y - my) for x, y in both) / math.sqrt(sxx) / math.sqrt(syy), n


def table():
    rng, rows = random.Random(3), []
    for k in range(700):
        a = rng.gauss(1e6, 1)
        rows.append((
            a, a + rng.gauss(0, 1), None if rng.random() < 0.3 else rng.random(), None if rng.random() < 0.5 else 2 * a,
            0.1, 0.3 if k % 2 else None, float("nan") if k == 5 else float(k), None, float("inf") if k == 6 else 1.0 * (k % 7), 0.1 if k % 2 else float(k),
        ))
    return rows


@pytest.mark.parametrize("tasks", [1, 5])
def test_nulls_constants_and_values_that_are_not_finite(spark, tasks):
    rows = table()
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(10))).repartition(tasks)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = {(r["ordinal_a"], r["ordinal_b"]): (r["rho"], r["pairs"]) for r in pairs.correlation(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 45
    for (i, j), (rho, n) in got.items():
        want, m = brute(rows, i, j)
        assert n == m, (i, j)
        assert (rho is None) == (want is None), (i, j, rho, want)
        assert want is None or (math.isnan(rho) and math.isnan(want)) or abs(rho - want) < 1e-9, (i, j)


def test_a_hundred_columns_are_one_scan(spark):
    df = spark.range(500).select(*[(F.col("id") * (i + 1) + F.pmod(F.hash("id", F.lit(i)), F.lit(1000))).alias(f"c{i}") for i in range(100)])
    found = pairs.correlation(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Expand" not in plan and "Generate" not in plan
    rows = found.collect()
    assert len(rows) == 4950 and all(r["pairs"] == 500 for r in rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert pairs.correlation(df).count() == 0
