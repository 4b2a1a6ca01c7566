"""The hand-made edge table: every value kind, NULLs, NaN, -0.0, number and
date grammar, nested and oddly named columns."""

import datetime as dt
import math
from decimal import Decimal

import pytest
from pyspark.sql import types as T

import tablelens as tl

NAN = float("nan")

SCHEMA = T.StructType([
    T.StructField("i", T.IntegerType()),
    T.StructField("big", T.LongType()),
    T.StructField("d", T.DoubleType()),
    T.StructField("dec", T.DecimalType(10, 2)),
    T.StructField("s", T.StringType()),
    T.StructField("num_s", T.StringType()),
    T.StructField("one_num", T.StringType()),
    T.StructField("dt_s", T.StringType()),
    T.StructField("dt", T.DateType()),
    T.StructField("b", T.BooleanType()),
    T.StructField("arr", T.ArrayType(T.IntegerType())),
    T.StructField("const", T.StringType()),
    T.StructField("all_null", T.StringType()),
    T.StructField("a.b", T.IntegerType()),
])

D = dt.date
ROWS = [
    (1, 5000000000, 0.0, Decimal("1.50"), "a", "12", "5", "2020-01-01", D(2020, 1, 1), True, [1], "k", None, 1),
    (2, 1, -0.0, Decimal("2.25"), "bb", " 7 ", "x", "01/02/2020", D(2020, 1, 2), False, [1, 2], "k", None, 2),
    (2, 1, NAN, None, "", "1_000", "y", "x", None, None, None, "k", None, 3),
    (None, None, 0.1, Decimal("1.50"), None, "1e3", "z", None, D(2020, 1, 1), True, [], "k", None, 4),
    (0, 2, None, Decimal("0.00"), "a", "1d", None, "12", D(2020, 1, 3), True, [1], "k", None, 5),
]


@pytest.fixture(scope="module")
def prof(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return tl.profile(df, "edge")


@pytest.fixture(scope="module")
def report(prof):
    return {r["column_name"]: r for r in prof.column_report.collect()}


def sections(row):
    return {(s["type"], s["origin"]): s for s in row["data_types"]}


def test_counts_and_nulls(report):
    assert report["i"]["record_count"] == 5
    assert report["i"]["number_non_empty_cells"] == 4
    assert report["i"]["number_empty_cells"] == 1
    assert report["i"]["null_proportion"] == 20.0
    assert report["all_null"]["unique_values"] == 0
    assert report["all_null"]["null_proportion"] == 100.0
    assert report["all_null"]["top_five_value"] == []
    assert report["a.b"]["unique_values"] == 5


def test_distinct_merges_negative_zero_and_keeps_nan(report):
    d = report["d"]
    assert d["unique_values"] == 3          # 0.0 (= -0.0), NaN, 0.1
    assert d["nan_count"] == 1
    assert d["zero_count"] == 2
    assert d["top_five_value"][0] == "0.0"


def test_integers_are_64_bit(report):
    sec = sections(report["big"])[("INTEGER (LONG)", "native")]
    assert sec["max_value"] == "5000000000"
    assert sec["count"] == 4


def test_native_sections(report):
    sec = sections(report["i"])[("INTEGER (LONG)", "native")]
    assert (sec["count"], sec["min_value"], sec["max_value"]) == (4, "0", "2")
    assert sec["mean"] == pytest.approx(1.25)
    assert sec["stddev"] == pytest.approx(0.9574271, rel=1e-6)
    dec = sections(report["dec"])[("REAL", "native")]
    assert (dec["count"], dec["min_value"], dec["max_value"]) == (4, "0.00", "2.25")
    dates = sections(report["dt"])[("DATE/TIME", "native")]
    assert (dates["count"], dates["min_value"], dates["max_value"]) == (
        4, "2020-01-01 00:00:00", "2020-01-03 00:00:00")


def test_text_section(report):
    sec = sections(report["s"])[("TEXT", "native")]
    assert sec["count"] == 4
    assert sec["shortest_values"] == ["", "a", "bb"]
    assert sec["longest_values"] == ["bb", "a", ""]
    assert sec["average_length"] == pytest.approx(1.0)   # distinct values '', 'a', 'bb'
    assert report["s"]["empty_string_count"] == 1
    assert report["s"]["max_length"] == 2


def test_number_grammar(report):
    secs = sections(report["num_s"])
    ints = secs[("INTEGER (LONG)", "parsed")]
    assert (ints["count"], ints["min_value"], ints["max_value"]) == (2, "7", "12")
    reals = secs[("REAL", "parsed")]
    assert (reals["count"], float(reals["min_value"]), float(reals["max_value"])) == (3, 7.0, 1000.0)
    assert report["num_s"]["percent_numeric"] == 60.0


def test_single_number_gives_no_section(report):
    secs = sections(report["one_num"])
    assert ("INTEGER (LONG)", "parsed") not in secs and ("REAL", "parsed") not in secs
    assert ("TEXT", "native") in secs


def test_date_formats(report):
    secs = sections(report["dt_s"])
    d = secs[("DATE/TIME", "parsed")]
    assert (d["count"], d["min_value"], d["max_value"]) == (2, "2020-01-01 00:00:00", "2020-01-02 00:00:00")


def test_boolean_and_nested_have_no_sections(report):
    assert report["b"]["data_types"] == []
    assert report["b"]["unique_values"] == 2
    assert report["b"]["top_five_value"] == ["true", "false"]
    assert report["arr"]["data_types"] == []
    assert report["arr"]["unique_values"] == 3
    assert report["arr"]["size_bytes"] == 16


def test_flat_report_keeps_columns_without_sections(prof):
    flat = prof.report_flat.collect()
    names = {r["column_name"] for r in flat}
    assert {"b", "arr", "all_null"} <= names


def test_warnings(prof):
    w = {(r["column_name"], r["warning"]): r for r in prof.warnings.collect()}
    assert w[("const", "constant")]["rejected"] is True
    assert ("all_null", "missing") in w
    table = prof.table_report.collect()[0]
    assert table["total_records"] == 5 and table["total_variables"] == 14
    assert table["n_rejected"] >= 1


def test_typed_values(spark):
    from tablelens.operators.typed import typed_values

    df = spark.createDataFrame(ROWS, SCHEMA)
    rows = {r["value"]: r for r in typed_values(df, "num_s").collect()}
    assert rows[" 7 "]["as_integer"] == 7
    assert rows["1e3"]["as_integer"] is None and rows["1e3"]["as_real"] == 1000.0
    assert rows["1d"]["as_real"] is None
    assert math.isclose(rows["12"]["as_real"], 12.0)


def test_timestamp_ntz_is_time_zone_free(spark):
    """Wall-clock values are profiled as written, in any session time zone,
    including a time that falls in that zone's daylight-saving gap."""
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = spark.sql(
            "SELECT * FROM VALUES (timestamp_ntz'2021-03-14 02:30:00'), (timestamp_ntz'2021-03-14 03:30:00'), "
            "(timestamp_ntz'2021-03-14 02:30:00') AS t(ts)")
        r = tl.profile(df).column_report.collect()[0]
        assert r["unique_values"] == 2
        assert r["top_five_value"] == ["2021-03-14 02:30:00", "2021-03-14 03:30:00"]
        sec = sections(r)[("DATE/TIME", "native")]
        assert (sec["min_value"], sec["max_value"]) == ("2021-03-14 02:30:00", "2021-03-14 03:30:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_decimal_extremes_exact_without_frequencies(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).select("dec")
    r = tl.profile(df, distinct=False, top_k=0, correlations=False).column_report.collect()[0]
    sec = sections(r)[("REAL", "native")]
    assert (sec["min_value"], sec["max_value"]) == ("0.00", "2.25")
