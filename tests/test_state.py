"""States of parts, merged, are the state of the whole."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablelens.operators import state
from tablelens.plans.checkpoint import scratch_table


def facts(states, **options):
    return {r["column_name"]: r for r in state.finish(states, **options).collect()}


def table(spark):
    rng = random.Random(11)
    rows = [
        (k, rng.gauss(1e5, 3) if k % 5 else None, float("nan") if k % 100 == 3 else float(k % 9), rng.choice("abcdefg") * (200 if k % 2 else 1), None, k % 2 == 0)
        for k in range(6000)
    ]
    return spark.createDataFrame(rows, "id long, g double, n double, t string, z double, b boolean")


def test_merged_parts_are_the_whole(spark):
    df = table(spark)
    whole = facts(state.column_states(df))
    parts = [df.where(f"id % 7 = {k}") for k in range(7)] + [df.limit(0)]
    held = scratch_table(parts[0].transform(state.column_states))
    for p in parts[1:]:
        held = held.unionByName(state.column_states(p))
    merged = facts(state.merge_states(held))
    assert set(merged) == set(whole) == set(df.columns)
    for name, w in whole.items():
        m = merged[name]
        for c in ("record_count", "number_non_empty_cells", "number_empty_cells", "not_finite", "max_length", "average_length", "min_value", "max_value"):
            assert m[c] == w[c], (name, c)
        for c in ("mean", "stddev", "skewness"):
            assert (m[c] is None) == (w[c] is None) and (w[c] is None or abs(m[c] - w[c]) <= 1e-6 * max(1, abs(w[c]))), (name, c)
        assert m["unique_values"] == pytest.approx(w["unique_values"], rel=0.05)
    assert whole["z"]["number_empty_cells"] == 6000 and whole["z"]["mean"] is None and whole["z"]["quantiles"] is None
    assert whole["n"]["not_finite"] == 60
    exact = {r["c"]: r["n"] for r in df.groupBy(F.left("t", F.lit(1)).alias("c"), F.length("t").alias("l")).agg(F.count("*").alias("n")).where("l = 1").collect()}
    top = {r["value"]: r["count"] for r in facts(state.merge_states(held), k=14)["t"]["top_values"]}
    assert {v: n for v, n in top.items() if len(v) == 1} == exact
    assert all(len(v) <= state.ITEM for v in top)


def test_quantiles_are_within_the_error(spark):
    df = spark.range(50_000).select(F.pmod(F.hash("id"), F.lit(1_000_003)).cast("double").alias("x"))
    values = sorted(r["x"] for r in df.collect())
    asked = tuple(k / 20 for k in range(1, 20))
    parts = state.merge_states(state.column_states(df.where("x < 5e5")).unionByName(state.column_states(df.where("x >= 5e5"))))
    for p, v in zip(asked, facts(parts, quantiles=asked)["x"]["quantiles"]):
        rank = sum(x <= v for x in values) / len(values)
        assert abs(rank - p) <= state.RANK_ERROR
    depths = state.equal_depth(parts, 8).collect()
    assert [r["bucket"] for r in sorted(depths, key=lambda r: r["low"])] == list(range(8)) and {r["depth"] for r in depths} == {6250.0}


def test_frequent_values_are_found_within_the_error(spark):
    """More different values than the summary can hold."""
    rng = random.Random(2)
    rows = [(f"v{int(rng.paretovariate(0.7)) % 1000 if k % 2 else rng.randrange(20_000)}",) for k in range(60_000)]
    exact = Counter(r[0] for r in rows)
    assert len(exact) > 2 * state.TRACKED
    df = spark.createDataFrame(rows, "v string").repartition(4)
    merged = state.merge_states(state.column_states(df.where("hash(v) % 2 = 0")).unionByName(state.column_states(df.where("hash(v) % 2 <> 0"))))
    found = facts(merged, k=50)["v"]
    got, error = {r["value"]: r["count"] for r in found["top_values"]}, found["top_error"]
    want = sorted(((n, v) for v, n in exact.items() if n > error), reverse=True)[:50]
    assert len(want) >= 20
    for n, v in want[:20]:
        assert v in got and abs(got[v] - n) <= error


def test_one_scan_and_no_shuffle_of_values(spark):
    df = spark.range(100).select(*[(F.col("id") % (i + 2)).alias(f"c{i}") for i in range(70)])
    states = state.column_states(df)
    assert len(states.collect()) == 70
    assert all(r["unique_values"] == i + 2 for r in state.finish(states).collect() for i in [r["ordinal"]] if i < 60)
    assert not math.isnan(state.finish(states).first()["mean"])


def test_states_of_parts_come_of_one_scan(spark):
    df = spark.range(300).selectExpr("id", "IF(id % 7 = 0, NULL, id / 3.0D) AS x", "CAST(id % 11 AS STRING) AS s")
    part = F.pmod(F.col("id"), F.lit(3))
    states = state.column_states(df, part)
    assert states.count() == 9 and "part" not in states.columns
    each = [state.column_states(df.where(part == k)) for k in range(3)]
    seen = ["ordinal", "n", "non_null", "numbers", "low", "high", "max_length"]
    assert sorted(map(str, states.select(*seen).collect())) == sorted(str(r) for e in each for r in e.select(*seen).collect())
    both = [state.finish(state.merge_states(s)).orderBy("ordinal").collect() for s in (states, state.column_states(df))]
    for a, b in zip(*both):
        assert (a.record_count, a.number_non_empty_cells, a.unique_values) == (b.record_count, b.number_non_empty_cells, b.unique_values)
