"""Invariants on the driver's tables and round trips through the sinks."""

import os
import tempfile

from pyspark.sql import functions as F

import tablelens as tl
from tablelens.operators import frequency as fq
from tablelens.operators.pairs import composite_keys, correlation
from tablelens.sinks import report_io as io
from tablelens.sources import readers

from paths import SF_SMALL


def _li(spark):
    return spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").withColumn(
        "l_returnflag", F.expr("nullif(l_returnflag, 'N')"))


def test_count_invariants(spark):
    df = _li(spark)
    p = tl.profile(df, "lineitem")
    n = df.count()
    freq_total = {r["column_name"]: r["t"] for r in
                  fq.value_frequencies(df).groupBy("column_name").agg(F.sum("cnt").alias("t")).collect()}
    for r in p.column_report.collect():
        assert r["number_empty_cells"] + r["number_non_empty_cells"] == n
        assert r["unique_values"] <= r["number_non_empty_cells"]
        assert freq_total.get(r["column_name"], 0) == r["number_non_empty_cells"]


def test_distinct_matches_count_distinct(spark):
    df = _li(spark)
    p = tl.profile(df, correlations=False)
    ours = {r["column_name"]: r["unique_values"] for r in p.column_report.collect()}
    theirs = df.agg(*[F.countDistinct(c).alias(c) for c in df.columns]).collect()[0].asDict()
    assert ours == theirs


def test_light_and_empty_profiles(spark):
    df = _li(spark)
    light = tl.light_profile(df).column_report.collect()
    assert all(r["unique_values"] is None and r["data_types"] is None for r in light)
    empty = tl.profile(df.where("false")).column_report.collect()
    assert len(empty) == len(df.columns)
    assert all(r["record_count"] == 0 and r["null_proportion"] is None for r in empty)


def test_json_and_csv_round_trip(spark):
    df = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    p = tl.profile(df, "orders", correlations=False)
    paths = io.save_profile(p, tempfile.mkdtemp(prefix="tl-rt-"), "orders.csv")
    back = io.read_column_report(spark, paths["column_report"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, p.column_report.collect()))
    flat = io.read_flat_csv(spark, paths["report_flat"])
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, p.report_flat.select(*flat.columns).collect()))


def test_csv_keeps_empty_strings(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="tl-csv-"), "x")
    spark.createDataFrame([("", 1), (None, 2), ("a", 3)], "s string, k int").write.options(
        header="true", emptyValue='""').csv(path)
    rows = {r["k"]: r["s"] for r in readers.load(spark, path, "csv").collect()}
    assert rows == {1: "", 2: None, 3: "a"}


def test_correlation_detects_linear_column(spark):
    df = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select(
        "l_quantity", (F.col("l_quantity") * 2 + 1).alias("q2"), F.lit(7.0).alias("k"))
    rho = {(r["column_a"], r["column_b"]): r["rho"] for r in correlation(df).collect()}
    assert abs(rho[("l_quantity", "q2")] - 1.0) < 1e-9
    assert rho[("l_quantity", "k")] is None  # constant column: no divide-by-zero error


def test_composite_keys_are_minimal_and_exact(spark):
    df = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    keys = [r["key_columns"] for r in composite_keys(df, max_size=4).collect()]
    n = df.count()
    for k in keys:
        assert df.select(*k).distinct().count() == n
        for drop in k:
            rest = [c for c in k if c != drop]
            if rest:
                assert df.select(*rest).distinct().count() < n


def test_histogram_counts_every_value(spark):
    from tablelens.operators.histogram import histogram

    df = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    h = histogram(df, 10, ["l_quantity", "l_discount"])
    tot = {r["column_name"]: r["t"] for r in h.groupBy("column_name").agg(F.sum("cnt").alias("t")).collect()}
    assert tot == {"l_quantity": df.count(), "l_discount": df.count()}
    assert h.agg(F.max("bucket")).collect()[0][0] <= 9


def test_sources(spark):
    base = tempfile.mkdtemp(prefix="tl-src-")
    sup = spark.read.parquet(f"{SF_SMALL}/supplier.parquet")
    tsv = os.path.join(base, "s.tsv")
    sup.write.options(header="true", sep="\t").csv(tsv)
    out = readers.tsv_to_csv(spark, tsv, os.path.join(base, "s_csv"))
    assert readers.load(spark, out, "csv").count() == sup.count()
    assert readers.positional_columns(sup).columns == ["0", "1", "2", "3"]
    assert readers.preview(sup, 3, ["s_suppkey"]).count() == 3
    s1 = readers.sample(sup, 0.5, seed=3).collect()
    s2 = readers.sample(sup, 0.5, seed=3).collect()
    assert s1 == s2


def test_approx_profile_is_close_and_shuffle_free(spark):
    df = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    p = tl.profile(df, approx=True, correlations=False)
    approx = {r["column_name"]: r["unique_values"] for r in p.column_report.collect()}
    exact = df.agg(*[F.countDistinct(c).alias(c) for c in df.columns]).collect()[0].asDict()
    for c, n in exact.items():
        assert abs(approx[c] - n) <= max(2, 0.1 * n), (c, approx[c], n)
    assert p.top_values is not None and all(r["top_five_value"] is None for r in p.column_report.collect())


def test_composite_keys_query_has_keys_of_three_and_four_columns(spark):
    from tablelens.plans import catalog

    sizes = {r["size"] for r in catalog.QUERIES["composite_keys"](spark, SF_SMALL).collect()}
    print("sizes", sizes)
    assert sizes >= {2, 3, 4}
