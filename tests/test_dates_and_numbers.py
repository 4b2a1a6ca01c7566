"""Whole dates, zone-free parsing, exact decimals, and plans without sort aggregates."""

import datetime as dt
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

import tablelens as tl
from tablelens.functions import parsing as P
from tablelens.operators.histogram import histogram
from tablelens.operators.warnings import rejected_columns
from tablelens.plans.report import row_counts, schema_report
from tablelens.sources import readers

from paths import SF_SMALL

TEXTS = {
    "2020-01-01": "2020-01-01 00:00:00",
    "2020-01-01T10:00:00Z": "2020-01-01 10:00:00",
    "2020-01-01 10:00:00.5": "2020-01-01 10:00:00.5",
    "2020-01-01 10:00": "2020-01-01 10:00:00",
    "2020-01-01T10:00+02:00": "2020-01-01 08:00:00",
    "2020-01-01 10:00:00.123456 -0530": "2020-01-01 15:30:00.123456",
    "31.12.2020": "2020-12-31 00:00:00",
    "12/31/2020 23:59": "2020-12-31 23:59:00",
    "2020/02/03": "2020-02-03 00:00:00",
    "13/13/2020": None,
    "2021-03-14 02:30:00": "2021-03-14 02:30:00",
    "2020-13-01": None,
    "2020-01-01Z": None,
    "x": None,
    "20-01-01": None,
    "9999-12-31 23:59:59.999999": "9999-12-31 23:59:59.999999",
}


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"])
def test_date_texts_in_any_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame([(t,) for t in TEXTS], "s string")
        got = {r.s: r.v for r in rows.select("s", P.report_ts(P.parsed_timestamp(F.col("s"))).alias("v")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == TEXTS
    con = duckdb.connect()
    con.execute("CREATE TABLE t (s VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [(t,) for t in TEXTS])
    assert dict(con.execute(f"SELECT s, CAST({P.sql_parsed_timestamp('s')} AS VARCHAR) FROM t").fetchall()) == TEXTS


def test_day_first(spark):
    row = spark.createDataFrame([("03/02/2020",)], "s string")
    assert row.select(P.report_ts(P.parsed_timestamp(F.col("s"), day_first=True))).first()[0] == "2020-02-03 00:00:00"


@pytest.fixture
def odd(spark):
    big = "123456789012345678901234567"
    rows = [
        (Decimal(big + ".11"), Decimal("1.5"), 0.1, dt.datetime(9999, 12, 31, 23, 59, 59, 999999)),
        (Decimal(big + ".15"), Decimal("2.5"), 0.2, dt.datetime(2020, 1, 1, 0, 0, 0, 1)),
        (Decimal(big + ".12"), None, None, dt.datetime(2020, 1, 1, 0, 0, 0, 2)),
    ]
    return spark.createDataFrame(rows, "a decimal(30,2), b decimal(5,1), c float, t timestamp_ntz").withColumn("nested", F.array("t"))


@pytest.mark.parametrize("options", [{}, {"distinct": False, "top_k": 0}])
def test_exact_extremes_and_no_sort_aggregate(odd, options):
    p = tl.profile(odd, correlations=False, **options)
    by = {r.column_name: {s.type: (s.min_value, s.max_value) for s in r.data_types} for r in p.column_report.collect()}
    big = "123456789012345678901234567"
    assert by["a"]["REAL"] == (big + ".11", big + ".15")
    assert by["b"]["REAL"] == ("1.5", "2.5")
    assert by["c"]["REAL"] == ("0.1", "0.2")
    assert by["t"]["DATE/TIME"] == ("2020-01-01 00:00:00.000001", "9999-12-31 23:59:59.999999")
    if not options:
        assert {r.column_name: r.unique_values for r in p.column_report.collect()}["nested"] == 3  # a microsecond apart


def test_facts_aggregate_by_hash(spark, odd, monkeypatch):
    import tablelens.plans.report as report

    monkeypatch.setattr(report, "materialize", lambda df: df)
    for df in (odd, spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")):
        for options in ({"top_k": 0, "sections": True}, {"distinct": False, "top_k": 0}):
            p = tl.profile(df, correlations=False, **options)
            facts = report.frequency_facts(p.typed_frequencies, p.df) if p.uses_frequencies else p.per_column
            facts.collect()
            assert "SortAggregate" not in facts._jdf.queryExecution().executedPlan().toString()


def test_scalar_pass_scans_once(spark, monkeypatch):
    import tablelens.plans.report as report

    monkeypatch.setattr(report, "materialize", lambda df: df)
    df = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    wide = df.select(*[F.col(df.columns[i % 11]).alias(f"c{i}") for i in range(100)])
    for table in (df, wide):
        facts = tl.profile(table, distinct=False, top_k=0, correlations=False).per_column
        facts.collect()
        assert facts._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan") == 1


def test_counts_read_no_column_and_schemas_no_data(spark):
    df = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    n = row_counts({"l": df})
    assert "ReadSchema: struct<>" in n._jdf.queryExecution().toString() and n.first().total_records == df.count()
    assert "FileScan" not in schema_report({"l": df})._jdf.queryExecution().toString()


def test_infinite_values_have_their_own_buckets(spark):
    inf = float("inf")
    df = spark.createDataFrame([(x,) for x in (0.0, 5.0, 10.0, inf, inf, -inf, float("nan"), None)], "x double")
    assert {(r.bucket, r.lo, r.hi): r.cnt for r in histogram(df, 2).collect()} == {
        (0, 0.0, 5.0): 1, (1, 5.0, 10.0): 2, (2, inf, inf): 2, (-1, -inf, -inf): 1}


def test_what_was_left_out_is_said(spark):
    df = spark.read.parquet(f"{SF_SMALL}/customer.parquet").withColumn("k", F.lit(1))
    full, light = tl.profile(df), tl.light_profile(df)
    assert {r.warning for r in full.warnings.where("column_name IS NULL").collect()} == set()
    assert {r.warning for r in light.warnings.where("column_name IS NULL").collect()} == {"high_cardinality", "constant", "skewed", "correlated"}
    assert rejected_columns(light.warnings).count() == 0
    row = light.table_report.first()
    assert row.n_unique_text is None and row.n_rejected is None
    assert full.table_report.first().n_rejected >= 1


def test_samples_of_any_fraction(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("id"))
    for f in (0.0004, 0.01, 0.5, 1.0):
        n = readers.hash_sample(df, f, ["id"]).count()
        assert abs(n - 20000 * f) <= 4 * (20000 * f) ** 0.5 + 1
    assert readers.hash_sample(df, 0.0, ["id"]).count() == 0


def test_start_is_before_end(spark):
    row = tl.profile(spark.range(3).toDF("x")).table_report.first()
    assert row.started_at <= row.ended_at


def test_each_layout_is_matched_once(spark):
    """Spark evaluates a pattern as often as it stands in the expression."""
    shown = str(P.parsed_timestamp(F.col("c")))
    assert shown.count(P.ISO_DATE) == 1
    times = ["", " 10:20", "T10:20:30", " 10:20:30.123456", "T10:20Z", " 10:20 Z", "T23:59:30.5+0530", " 00:10:00 -03:30", "+01:00", " 10:20Z\n", " 10:20z", " 25:00", "T10:20+5"]
    want = {" 10:20": "10:20:00", "T10:20:30": "10:20:30", " 10:20:30.123456": "10:20:30.123456", "T10:20Z": "10:20:00", " 10:20 Z": "10:20:00", "T23:59:30.5+0530": "18:29:30.5", " 00:10:00 -03:30": "03:40:00"}
    rows = [(d + t, f"2021-02-28 {'00:00:00' if not t else want.get(t)}" if not t or t in want else None) for d in ("2021-02-28", "2021/02/28", "02/28/2021", "28.02.2021") for t in times if t != " 10:20Z\n"]
    rows += [("2021-02-30", None), ("02/30/2021 10:00Z", None), ("", None), (None, None), ("12", None)]
    got = spark.createDataFrame(rows, "c string, want string").select("c", "want", P.parsed_timestamp(F.col("c")).cast("string").alias("got")).collect()
    assert [(r.c, r.got) for r in got] == [(r.c, r.want) for r in got]
