"""The plan shapes the design relies on at scale, checked on executed plans."""

import pytest
from pyspark.sql import functions as F

import tablelens as tl
import tablelens.plans.report as report
from tablelens.operators import frequency as fq

from paths import SF_SMALL


def _final_plan(df) -> str:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


@pytest.fixture
def lazy_facts(monkeypatch):
    # inspect the plan that the checkpoint would run
    monkeypatch.setattr(report, "materialize", lambda df: df)


def test_profile_scans_the_source_once(spark, lazy_facts):
    df = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    plan = _final_plan(tl.profile(df, correlations=False).per_column)
    assert plan.count("FileScan parquet") == 1, plan
    assert "ReusedExchange" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_top_k_limits_rows_before_the_exchange(spark):
    df = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    plan = _final_plan(fq.top_values(fq.value_frequencies(df), 5))
    # a partial WindowGroupLimit sits below the window's exchange
    assert plan.count("WindowGroupLimit") >= 2, plan


def test_filters_and_columns_reach_the_scan(spark, lazy_facts):
    df = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").where(F.col("l_quantity") > 10).select(
        "l_orderkey", "l_returnflag")
    plan = _final_plan(tl.profile(df, correlations=False).per_column)
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in plan, plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in plan, plan
