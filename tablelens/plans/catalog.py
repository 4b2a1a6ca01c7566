"""Registered profile queries and their SQL oracles.

Every entry runs a library operator over whole driver tables (or tables Spark
derives from them) and flattens the result to plain columns; the matching SQL
computes the same facts independently, so the two can be compared value by
value. Doubles are rounded to 4 places on both sides, list fields are joined
with '|', and dates are whole: 'yyyy-MM-dd HH:mm:ss' and the fraction, if any.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parsing as P
from ..functions.shapes import shaped_timestamp
from ..functions.types import literal_rows
from ..operators import frequency as fq
from ..operators import pairs as pr
from ..operators import state as st
from ..operators import warnings as wn
from ..operators.histogram import category_counts, histogram, month_counts
from ..operators.typed import typed_values
from ..sinks import report_io as io
from ..sources import readers
from .. import __version__ as tablelens_version
from . import fixtures as fx
from .checkpoint import scratch_path
from .report import (
    batch_reports,
    dtype_classes,
    light_profile,
    profile,
    profile_many,
    row_counts,
    schema_report,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return deco


# ----------------------------------------------------------------- SQL helpers

def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def sql_canon(name: str, typ: str) -> str:
    c = q(name)
    if typ == "string":
        return c
    if typ in ("double", "float"):
        return f"CASE WHEN isnan({c}) THEN 'NaN' ELSE CAST({c} + 0.0 AS VARCHAR) END"
    return f"CAST({c} AS VARCHAR)"


def r4(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 4)"


NUMERIC_TYPES = ("bigint", "int", "double", "float", "smallint", "tinyint")
INT_TYPES = ("bigint", "int", "smallint", "tinyint")

# Default profile options used by the registered queries.
MINIMAL = dict(sections=False, distinct=False, top_k=0, correlations=False)


def _r4(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 4)


def _facts(spark, sf, spec, **opts) -> DataFrame:
    return profile(fx.spark_table(spark, sf, spec), **opts).column_facts


# ============================================================ step 1: counts

def _src(spec) -> str:
    return fx.sql_table(spec)


@register("row_count", "SELECT 'lineitem' AS table_name, CAST(count(*) AS BIGINT) AS total_records FROM lineitem")
def row_count(spark, sf):
    return row_counts({"lineitem": fx.read(spark, sf, "lineitem")})


COUNT_TABLES = ["lineitem", "orders", "customer", "part", "documents", "embeddings"]


@register("column_count", union([
    f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS total_variables "
    f"FROM information_schema.columns WHERE table_name = '{t}'" for t in COUNT_TABLES]))
def column_count(spark, sf):
    return schema_report({t: fx.read(spark, sf, t) for t in COUNT_TABLES}).groupBy("table_name").agg(
        F.count(F.lit(1)).alias("total_variables"))


DUCK_TO_SPARK_TYPE = (
    "CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
    "WHEN 'FLOAT' THEN 'float' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' "
    "WHEN 'DATE' THEN 'date' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(data_type) END"
)


@register("schema_columns", f"""
SELECT CAST(ordinal_position - 1 AS INTEGER) AS ordinal, column_name, {DUCK_TO_SPARK_TYPE} AS dtype
FROM information_schema.columns WHERE table_name = 'orders'""")
def schema_columns(spark, sf):
    return schema_report({"orders": fx.read(spark, sf, "orders")}).select("ordinal", "column_name", "dtype")


def _per_col(spec, tmpl: str, types=None) -> str:
    src = _src(spec)
    return union([
        tmpl.format(name=n, c=q(n), src=src)
        for n, t in fx.columns(spec) if types is None or t in types
    ])


@register("not_null_count", _per_col(fx.LI_NULLS,
          "SELECT '{name}' AS column_name, CAST(count({c}) AS BIGINT) AS number_non_empty_cells FROM {src}"))
def not_null_count(spark, sf):
    return _facts(spark, sf, fx.LI_NULLS, **MINIMAL).select("column_name", "number_non_empty_cells")


@register("null_count", _per_col(fx.LI_NULLS,
          "SELECT '{name}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS number_empty_cells FROM {src}"))
def null_count(spark, sf):
    return _facts(spark, sf, fx.LI_NULLS, **MINIMAL).select("column_name", "number_empty_cells")


@register("null_proportion", _per_col(fx.LI_NULLS,
          "SELECT '{name}' AS column_name, round(CAST(count(*) - count({c}) AS DOUBLE) * 100.0 / count(*), 3) "
          "AS null_proportion FROM {src}"))
def null_proportion(spark, sf):
    return _facts(spark, sf, fx.LI_NULLS, **MINIMAL).select("column_name", "null_proportion")


_nulls_sum = " + ".join(f"(count(*) - count({q(n)}))" for n, _ in fx.columns(fx.LI_NULLS))


@register("missing_fraction", f"""
SELECT 'lineitem' AS table_name,
       round(CAST({_nulls_sum} AS DOUBLE) / CAST(count(*) * {len(fx.columns(fx.LI_NULLS))} AS DOUBLE), 8)
         AS total_missing_fraction
FROM {_src(fx.LI_NULLS)}""")
def missing_fraction(spark, sf):
    p = profile(fx.spark_table(spark, sf, fx.LI_NULLS), "lineitem", **MINIMAL)
    return p.table_report.select("table_name", F.round("total_missing_fraction", 8).alias("total_missing_fraction"))


# ========================================================= step 2: frequency

@register("distinct_count", _per_col(fx.LI_NULLS,
          "SELECT '{name}' AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS unique_values FROM {src}"))
def distinct_count(spark, sf):
    return _facts(spark, sf, fx.LI_NULLS, sections=False, top_k=0, correlations=False).select(
        "column_name", "unique_values")


def _freq_sql(spec) -> str:
    src = _src(spec)
    return union([
        f"SELECT '{n}' AS column_name, {sql_canon(n, t)} AS value, CAST(count(*) AS BIGINT) AS cnt "
        f"FROM {src} WHERE {q(n)} IS NOT NULL GROUP BY 1, 2"
        for n, t in fx.columns(spec)
    ])


@register("distinct_values", _freq_sql(fx.plain("orders")))
def distinct_values(spark, sf):
    return fq.value_frequencies(fx.read(spark, sf, "orders")).select("column_name", "value", "cnt")


@register("top_values", f"""
SELECT column_name, rank, value, cnt FROM (
  SELECT column_name, value, cnt,
         row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value ASC) AS rank
  FROM ({_freq_sql(fx.LI_NULLS)})) WHERE rank <= 5""")
def top_values(spark, sf):
    freq = fq.value_frequencies(fx.spark_table(spark, sf, fx.LI_NULLS))
    return fq.top_values(freq, 5).select("column_name", "rank", "value", "cnt")


def _extreme_sql(spec, direction: str) -> str:
    strings = ("SELECT * FROM (" + _freq_sql(spec) + ") WHERE column_name IN ("
               + ", ".join(f"'{n}'" for n, t in fx.columns(spec) if t == "string") + ")")
    return f"""
SELECT column_name, rank, value, length FROM (
  SELECT column_name, value, CAST(length(value) AS BIGINT) AS length,
         row_number() OVER (PARTITION BY column_name ORDER BY length(value) {direction}, value ASC) AS rank
  FROM ({strings})) WHERE rank <= 5"""


def _extreme_spark(spark, sf, fn):
    df = fx.read(spark, sf, "documents")
    freq = fq.value_frequencies(df, fq.string_ordinals(df))
    return fn(freq, 5).select("column_name", "rank", "value", "length")


@register("shortest_values", _extreme_sql(fx.plain("documents"), "ASC"))
def shortest_values(spark, sf):
    return _extreme_spark(spark, sf, fq.shortest_values)


@register("longest_values", _extreme_sql(fx.plain("documents"), "DESC"))
def longest_values(spark, sf):
    return _extreme_spark(spark, sf, fq.longest_values)


@register("avg_distinct_length", _per_col(fx.plain("part"),
          "SELECT '{name}' AS column_name, round(avg(length(v)), 4) AS avg_distinct_length "
          "FROM (SELECT DISTINCT {c} AS v FROM {src} WHERE {c} IS NOT NULL)", types=("string",)))
def avg_distinct_length(spark, sf):
    p = profile(fx.read(spark, sf, "part"), "part", correlations=False)
    return (p.typed_sections.where(F.col("type") == "TEXT")
            .select("column_name", _r4("average_length").alias("avg_distinct_length")))


UNIQUE_TABLES = ["customer", "part", "orders", "documents"]


def _unique_text_sql() -> str:
    parts = []
    for t in UNIQUE_TABLES:
        flags = " + ".join(
            f"CASE WHEN count(DISTINCT {q(n)}) = count({q(n)}) AND count({q(n)}) > 0 THEN 1 ELSE 0 END"
            for n, ty in fx.TABLES[t] if ty == "string")
        parts.append(f"SELECT '{t}' AS table_name, CAST({flags} AS BIGINT) AS n_unique_text FROM {t}")
    return union(parts)


@register("unique_text_columns", _unique_text_sql())
def unique_text_columns(spark, sf):
    return profile_many({t: fx.read(spark, sf, t) for t in UNIQUE_TABLES},
                        sections=False, top_k=0, correlations=False).select("table_name", "n_unique_text")


@register("warn_constant", _per_col(fx.LI_TEXT,
          "SELECT '{name}' AS column_name, 'constant' AS warning, CAST(count(DISTINCT {c}) AS DOUBLE) AS value "
          "FROM {src} HAVING count(DISTINCT {c}) = 1"))
def warn_constant(spark, sf):
    f = _facts(spark, sf, fx.LI_TEXT, sections=False, correlations=False)
    return wn.warn_constant(f).select("column_name", "warning", "value")


@register("warn_cardinality", _per_col(fx.plain("customer"),
          "SELECT '{name}' AS column_name, 'high_cardinality' AS warning, CAST(count(DISTINCT {c}) AS DOUBLE) AS value "
          "FROM {src} HAVING count(DISTINCT {c}) > 50", types=("string",)))
def warn_cardinality(spark, sf):
    f = _facts(spark, sf, fx.plain("customer"), sections=False, top_k=0, correlations=False)
    return wn.warn_cardinality(f).select("column_name", "warning", "value")


# ====================================================== step 3: typed sections

def _stats_sql(name: str, x: str, src: str, typ: str, origin: str) -> str:
    return (f"SELECT '{name}' AS column_name, '{typ}' AS type, '{origin}' AS origin, "
            f"CAST(count({x}) AS BIGINT) AS count, CAST(min({x}) AS VARCHAR) AS min_value, "
            f"CAST(max({x}) AS VARCHAR) AS max_value, {r4(f'avg({x})')} AS mean, "
            f"{r4(f'stddev_samp({x})')} AS stddev FROM {src} HAVING count({x}) > 1")


def _sections_spark(spark, sf, spec, typ, origin):
    p = profile(fx.spark_table(spark, sf, spec), correlations=False)
    return p.typed_sections.where((F.col("type") == typ) & (F.col("origin") == origin)).select(
        "column_name", "type", "origin", "count", "min_value", "max_value",
        _r4("mean").alias("mean"), _r4("stddev").alias("stddev"))


@register("native_int_stats", union([
    _stats_sql(n, q(n), "lineitem", "INTEGER (LONG)", "native") for n, t in fx.TABLES["lineitem"] if t in INT_TYPES]))
def native_int_stats(spark, sf):
    return _sections_spark(spark, sf, fx.plain("lineitem"), "INTEGER (LONG)", "native")


@register("native_real_stats", union([
    _stats_sql(n, q(n), "lineitem", "REAL", "native") for n, t in fx.TABLES["lineitem"] if t == "double"]))
def native_real_stats(spark, sf):
    return _sections_spark(spark, sf, fx.plain("lineitem"), "REAL", "native")


@register("parsed_int_stats", union([
    _stats_sql(n, P.sql_parsed_int(q(n)), _src(fx.LI_TEXT), "INTEGER (LONG)", "parsed")
    for n, _ in fx.columns(fx.LI_TEXT)]))
def parsed_int_stats(spark, sf):
    return _sections_spark(spark, sf, fx.LI_TEXT, "INTEGER (LONG)", "parsed")


@register("parsed_real_stats", union([
    _stats_sql(n, P.sql_parsed_real(q(n)), _src(fx.LI_TEXT), "REAL", "parsed")
    for n, _ in fx.columns(fx.LI_TEXT)]))
def parsed_real_stats(spark, sf):
    return _sections_spark(spark, sf, fx.LI_TEXT, "REAL", "parsed")


@register("typed_values", f"""
SELECT kitchen AS value, {P.sql_parsed_int('kitchen')} AS as_integer, {P.sql_parsed_real('kitchen')} AS as_real,
       kitchen AS as_text, CAST({P.sql_parsed_timestamp('kitchen')} AS VARCHAR) AS as_timestamp
FROM {_src(fx.LI_KITCHEN)}""")
def typed_values_q(spark, sf):
    tv = typed_values(fx.spark_table(spark, sf, fx.LI_KITCHEN), "kitchen")
    return tv.withColumn("as_timestamp", P.report_ts(F.col("as_timestamp")))


@register("text_count", _per_col(fx.LI_TEXT,
          "SELECT '{name}' AS column_name, CAST(count({c}) AS BIGINT) AS count FROM {src} HAVING count({c}) > 1"))
def text_count(spark, sf):
    p = profile(fx.spark_table(spark, sf, fx.LI_TEXT), correlations=False)
    return p.typed_sections.where(F.col("type") == "TEXT").select("column_name", "count")


def _date_sql(name: str, x: str, src: str, origin: str) -> str:
    return (f"SELECT '{name}' AS column_name, '{origin}' AS origin, CAST(count({x}) AS BIGINT) AS count, "
            f"CAST(min({x}) AS VARCHAR) AS min_value, CAST(max({x}) AS VARCHAR) AS max_value "
            f"FROM {src} HAVING count({x}) > 1")


def _date_spark(spark, sf, spec):
    p = profile(fx.spark_table(spark, sf, spec), correlations=False)
    return p.typed_sections.where(F.col("type") == "DATE/TIME").select(
        "column_name", "origin", "count", "min_value", "max_value")


@register("date_range_native", union([
    _date_sql(n, q(n), table, "native") for table in ("orders", "events") for n, t in fx.TABLES[table]
    if t == "timestamp_ntz"]))
def date_range_native(spark, sf):
    both = [_date_spark(spark, sf, fx.plain(t)).where("origin = 'native'") for t in ("orders", "events")]
    return reduce(DataFrame.unionByName, both)


@register("date_layouts_parsed", union([
    _date_sql(n, P.sql_parsed_timestamp(q(n)), _src(fx.EVENT_DATES), "parsed") for n, _ in fx.columns(fx.EVENT_DATES)]))
def date_layouts_parsed(spark, sf):
    """events.ts as text in every accepted layout."""
    return _date_spark(spark, sf, fx.EVENT_DATES)


@register("date_range_parsed", union([
    _date_sql(n, P.sql_parsed_timestamp(q(n)), _src(fx.LI_TEXT), "parsed") for n, _ in fx.columns(fx.LI_TEXT)]))
def date_range_parsed(spark, sf):
    return _date_spark(spark, sf, fx.LI_TEXT)


def _sections_sql(spec) -> str:
    """All typed sections of a table, long form, like Profile.typed_sections."""
    src = _src(spec)
    parts = []
    for n, t in fx.columns(spec):
        c = q(n)

        def num(order, typ, origin, x):
            return (f"SELECT '{n}' AS column_name, {order} AS section_order, '{typ}' AS type, '{origin}' AS origin, "
                    f"CAST(count({x}) AS BIGINT) AS count, CAST(max({x}) AS VARCHAR) AS max_value, "
                    f"CAST(min({x}) AS VARCHAR) AS min_value, {r4(f'avg({x})')} AS mean, "
                    f"{r4(f'stddev_samp({x})')} AS stddev, NULL AS shortest, NULL AS longest, "
                    f"CAST(NULL AS DOUBLE) AS average_length FROM {src}")

        def dt(origin, x):
            return (f"SELECT '{n}' AS column_name, 4 AS section_order, 'DATE/TIME' AS type, '{origin}' AS origin, "
                    f"CAST(count({x}) AS BIGINT) AS count, CAST(max({x}) AS VARCHAR) AS max_value, "
                    f"CAST(min({x}) AS VARCHAR) AS min_value, CAST(NULL AS DOUBLE) AS mean, "
                    f"CAST(NULL AS DOUBLE) AS stddev, NULL AS shortest, NULL AS longest, "
                    f"CAST(NULL AS DOUBLE) AS average_length FROM {src}")

        if t in INT_TYPES:
            parts.append(num(2, "INTEGER (LONG)", "native", c))
        elif t in ("double", "float"):
            parts.append(num(1, "REAL", "native", c))
        elif t == "timestamp_ntz":
            parts.append(dt("native", c))
        elif t == "string":
            dist = f"(SELECT DISTINCT {c} AS v FROM {src} WHERE {c} IS NOT NULL)"

            def ext(direction):
                return (f"(SELECT string_agg(v, '|' ORDER BY length(v) {direction}, v) FROM "
                        f"(SELECT v FROM {dist} ORDER BY length(v) {direction}, v LIMIT 5))")

            parts.append(
                f"SELECT '{n}' AS column_name, 3 AS section_order, 'TEXT' AS type, 'native' AS origin, "
                f"CAST(count({c}) AS BIGINT) AS count, NULL AS max_value, NULL AS min_value, "
                f"CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS stddev, {ext('ASC')} AS shortest, "
                f"{ext('DESC')} AS longest, (SELECT {r4('avg(length(v))')} FROM {dist}) AS average_length FROM {src}")
            parts.append(dt("parsed", P.sql_parsed_timestamp(c)))
            parts.append(num(5, "REAL", "parsed", P.sql_parsed_real(c)))
            parts.append(num(6, "INTEGER (LONG)", "parsed", P.sql_parsed_int(c)))
    return "SELECT * FROM (" + union(parts) + ") WHERE count > 1"


@register("typed_sections", _sections_sql(fx.LI_TEXT))
def typed_sections(spark, sf):
    p = profile(fx.spark_table(spark, sf, fx.LI_TEXT), correlations=False)
    return p.typed_sections.select(
        "column_name", "section_order", "type", "origin", "count", "max_value", "min_value",
        _r4("mean").alias("mean"), _r4("stddev").alias("stddev"),
        F.array_join("shortest_values", "|").alias("shortest"),
        F.array_join("longest_values", "|").alias("longest"),
        _r4("average_length").alias("average_length"))


@register("nan_as_null_count", union([
    f"SELECT '{n}' AS column_name, CAST(count(nullif(CAST({q(n)} AS DOUBLE), 'NaN')) AS BIGINT) AS number_non_empty_cells, "
    f"CAST(count(*) - count(nullif(CAST({q(n)} AS DOUBLE), 'NaN')) AS BIGINT) AS number_empty_cells, "
    f"round(CAST(count(*) - count(nullif(CAST({q(n)} AS DOUBLE), 'NaN')) AS DOUBLE) * 100.0 / count(*), 3) AS null_proportion "
    f"FROM {_src(fx.LI_NUM)}" for n, _ in fx.columns(fx.LI_NUM)]))
def nan_as_null_count(spark, sf):
    return _facts(spark, sf, fx.LI_NUM, nan_as_null=True, **MINIMAL).select(
        "column_name", "number_non_empty_cells", "number_empty_cells", "null_proportion")


# ======================================================= step 4: whole report

def _top5_sql(spec, n, t) -> str:
    src = _src(spec)
    v = sql_canon(n, t)
    return (f"(SELECT coalesce(string_agg(value, '|' ORDER BY cnt DESC, value), '') FROM "
            f"(SELECT {v} AS value, count(*) AS cnt FROM {src} WHERE {q(n)} IS NOT NULL GROUP BY 1 "
            f"ORDER BY cnt DESC, value LIMIT 5))")


def _column_report_sql(spec, distinct=True) -> str:
    src = _src(spec)
    parts = []
    for n, t in fx.columns(spec):
        c = q(n)
        uv = f"CAST(count(DISTINCT {c}) AS BIGINT)" if distinct else "CAST(NULL AS BIGINT)"
        parts.append(
            f"SELECT '{n}' AS column_name, '{t}' AS dtype, CAST(count(*) AS BIGINT) AS record_count, "
            f"{uv} AS unique_values, CAST(count({c}) AS BIGINT) AS number_non_empty_cells, "
            f"CAST(count(*) - count({c}) AS BIGINT) AS number_empty_cells, "
            f"round(CAST(count(*) - count({c}) AS DOUBLE) * 100.0 / count(*), 3) AS null_proportion, "
            f"{_top5_sql(spec, n, t)} AS top_five_value FROM {src}")
    return union(parts)


def _column_report_cols(df: DataFrame, distinct=True) -> DataFrame:
    return df.select("column_name", "dtype", "record_count", "unique_values", "number_non_empty_cells",
                     "number_empty_cells", "null_proportion",
                     F.array_join("top_five_value", "|").alias("top_five_value"))


@register("column_report", _column_report_sql(fx.LI_NULLS))
def column_report(spark, sf):
    return _column_report_cols(profile(fx.spark_table(spark, sf, fx.LI_NULLS), "lineitem").column_report)


@register("events_column_report", _column_report_sql(fx.plain("events")))
def events_column_report(spark, sf):
    return _column_report_cols(profile(fx.read(spark, sf, "events"), "events", correlations=False).column_report)


def _numeric_pairs_sql(spec, threshold=wn.CORRELATION) -> tuple[str, str]:
    """(rho long-form SQL, rejected-by-correlation SQL)."""
    src = _src(spec)
    nums = [n for n, t in fx.columns(spec) if t in NUMERIC_TYPES]
    rows = []
    for a, b in itertools.combinations(nums, 2):
        x, y = f"CAST({q(a)} AS DOUBLE)", f"CAST({q(b)} AS DOUBLE)"
        xx, yy = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
        rows.append(f"SELECT '{a}' AS column_a, '{b}' AS column_b, covar_pop({x}, {y}) / "
                    f"nullif(stddev_pop({xx}) * stddev_pop({yy}), 0) AS rho FROM {src}")
    rho = union(rows) if rows else "SELECT NULL AS column_a, NULL AS column_b, NULL AS rho WHERE false"
    rejected = f"SELECT column_b AS column_name FROM ({rho}) WHERE abs(rho) > {threshold}"
    return rho, rejected


def _table_report_sql(spec, name) -> str:
    src = _src(spec)
    cols = fx.columns(spec)
    nulls = " + ".join(f"(count(*) - count({q(n)}))" for n, _ in cols)

    def width(n, t):
        w = {"bigint": 8, "double": 8, "timestamp_ntz": 8, "int": 4, "float": 4, "date": 4, "boolean": 1}.get(t)
        return f"count({q(n)}) * {w}" if w else f"coalesce(sum(strlen({q(n)})), 0)"

    size = " + ".join(width(n, t) for n, t in cols)
    cls = {"numeric": [n for n, t in cols if t in NUMERIC_TYPES],
           "categorical": [n for n, t in cols if t == "string"],
           "date": [n for n, t in cols if t in ("timestamp_ntz", "date")]}
    uniq = " + ".join(
        f"CASE WHEN count(DISTINCT {q(n)}) = count({q(n)}) AND count({q(n)}) > 0 THEN 1 ELSE 0 END"
        for n in cls["categorical"]) or "0"
    _, rej_corr = _numeric_pairs_sql(spec)
    const = union([f"SELECT '{n}' AS column_name FROM {src} HAVING count(DISTINCT {q(n)}) = 1" for n, _ in cols])
    return f"""
SELECT '{name}' AS table_name, CAST(count(*) AS BIGINT) AS total_records, CAST({len(cols)} AS BIGINT) AS total_variables,
       round(CAST({nulls} AS DOUBLE) / CAST(count(*) * {len(cols)} AS DOUBLE), 8) AS total_missing_fraction,
       CAST({size} AS BIGINT) AS estimated_size_bytes,
       round(CAST({size} AS DOUBLE) / count(*), 4) AS avg_record_bytes,
       CAST(greatest(1, ceil(CAST({size} AS DOUBLE) / {128 * 1024 * 1024})) AS BIGINT) AS recommended_partitions,
       CAST({len(cls['numeric'])} AS BIGINT) AS n_numeric, CAST({len(cls['categorical'])} AS BIGINT) AS n_categorical,
       CAST({len(cls['date'])} AS BIGINT) AS n_date, CAST({uniq} AS BIGINT) AS n_unique_text,
       (SELECT CAST(count(DISTINCT column_name) AS BIGINT) FROM ({rej_corr} UNION ALL {const})) AS n_rejected
FROM {src}"""


TABLE_REPORT_COLS = ["table_name", "total_records", "total_variables", "total_missing_fraction",
                     "estimated_size_bytes", "avg_record_bytes", "recommended_partitions", "n_numeric",
                     "n_categorical", "n_date", "n_unique_text", "n_rejected"]


def _table_report_spark(p) -> DataFrame:
    return p.table_report.select(
        *[F.round(c, 8).alias(c) if c == "total_missing_fraction" else
          F.round(c, 4).alias(c) if c == "avg_record_bytes" else F.col(c) for c in TABLE_REPORT_COLS])


@register("table_report", _table_report_sql(fx.LI_NUM, "lineitem"))
def table_report(spark, sf):
    return _table_report_spark(profile(fx.spark_table(spark, sf, fx.LI_NUM), "lineitem"))


def _flat_sql(spec) -> str:
    base = _column_report_sql(spec)
    secs = _sections_sql(spec)
    return f"""
SELECT b.column_name, b.dtype, b.record_count, b.unique_values, b.number_non_empty_cells, b.number_empty_cells,
       b.null_proportion, b.top_five_value, s.type, s.origin, s.count, s.max_value, s.min_value, s.mean, s.stddev,
       s.average_length
FROM ({base}) b LEFT JOIN ({secs}) s ON b.column_name = s.column_name"""


def _flat_spark(flat: DataFrame) -> DataFrame:
    return flat.select(
        "column_name", "dtype", "record_count", "unique_values", "number_non_empty_cells", "number_empty_cells",
        "null_proportion", F.array_join("top_five_value", "|").alias("top_five_value"), "type", "origin", "count",
        "max_value", "min_value", _r4("mean").alias("mean"), _r4("stddev").alias("stddev"),
        _r4("average_length").alias("average_length"))


@register("report_flat", _flat_sql(fx.plain("orders")))
def report_flat(spark, sf):
    return _flat_spark(profile(fx.read(spark, sf, "orders"), "orders", correlations=False).report_flat)


@register("light_profile", union([
    f"SELECT '{n}' AS column_name, CAST(count(*) AS BIGINT) AS record_count, "
    f"CAST(count({q(n)}) AS BIGINT) AS number_non_empty_cells, "
    f"CAST(count(*) - count({q(n)}) AS BIGINT) AS number_empty_cells, "
    f"round(CAST(count(*) - count({q(n)}) AS DOUBLE) * 100.0 / count(*), 3) AS null_proportion, "
    f"{_top5_sql(fx.plain('orders'), n, t)} AS top_five_value FROM orders"
    for n, t in fx.TABLES["orders"]]))
def light_profile_q(spark, sf):
    p = light_profile(fx.read(spark, sf, "orders"), "orders")
    return p.column_report.select(
        "column_name", "record_count", "number_non_empty_cells", "number_empty_cells", "null_proportion",
        F.array_join("top_five_value", "|").alias("top_five_value"))


CLASS_TABLES = ["lineitem", "orders", "customer", "events", "documents", "embeddings"]


def _classes_sql() -> str:
    sem = ("CASE WHEN data_type IN ('BIGINT','INTEGER','DOUBLE','FLOAT','SMALLINT','TINYINT') "
           "OR data_type LIKE 'DECIMAL%' THEN 'numeric' WHEN data_type = 'VARCHAR' THEN 'categorical' "
           "WHEN data_type IN ('DATE','TIMESTAMP','TIMESTAMP WITH TIME ZONE') THEN 'date' ELSE 'other' END")
    pre = (f"CASE WHEN starts_with({DUCK_TO_SPARK_TYPE}, 'int') OR starts_with({DUCK_TO_SPARK_TYPE}, 'float') "
           f"THEN 'numeric' WHEN starts_with({DUCK_TO_SPARK_TYPE}, 'string') THEN 'categorical' "
           f"WHEN starts_with({DUCK_TO_SPARK_TYPE}, 'date') THEN 'date' ELSE 'other' END")
    parts = []
    for mode, rule in (("semantic", sem), ("prefix", pre)):
        parts.append(
            f"SELECT table_name, '{mode}' AS mode, "
            f"CAST(count_if(({rule}) = 'numeric') AS BIGINT) AS n_numeric, "
            f"CAST(count_if(({rule}) = 'categorical') AS BIGINT) AS n_categorical, "
            f"CAST(count_if(({rule}) = 'date') AS BIGINT) AS n_date "
            f"FROM information_schema.columns WHERE table_name IN ({', '.join(repr(t) for t in CLASS_TABLES)}) "
            f"GROUP BY table_name")
    return union(parts)


@register("dtype_classes", _classes_sql())
def dtype_classes_q(spark, sf):
    rows = []
    for mode in ("semantic", "prefix"):
        for t in CLASS_TABLES:
            n = dtype_classes(fx.read(spark, sf, t), mode)
            rows.append((t, mode, n["numeric"], n["categorical"], n["date"]))
    return literal_rows(spark, rows, "table_name string, mode string, n_numeric bigint, n_categorical bigint, n_date bigint")


@register("empty_table", union([
    f"SELECT '{n}' AS column_name, CAST(count(*) AS BIGINT) AS record_count, "
    f"CAST(count(DISTINCT {q(n)}) AS BIGINT) AS unique_values, CAST(count({q(n)}) AS BIGINT) AS number_non_empty_cells, "
    f"CAST(count(*) - count({q(n)}) AS BIGINT) AS number_empty_cells, CAST(NULL AS DOUBLE) AS null_proportion, "
    f"CAST(0 AS BIGINT) AS n_sections FROM lineitem WHERE l_orderkey < 0"
    for n, _ in fx.TABLES["lineitem"]]))
def empty_table(spark, sf):
    df = fx.read(spark, sf, "lineitem").where(F.col("l_orderkey") < 0)
    return profile(df, "lineitem").column_report.select(
        "column_name", "record_count", "unique_values", "number_non_empty_cells", "number_empty_cells",
        "null_proportion", F.size("data_types").cast("bigint").alias("n_sections"))


# ===================================================== step 5: sources, sinks

ORDERS_OUT_SQL = ("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, "
                  f"CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority FROM orders")


def _orders_out(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("o_orderkey").cast("bigint"), F.col("o_custkey").cast("bigint"), F.col("o_orderstatus").cast("string"),
        F.col("o_totalprice").cast("double"),
        P.report_ts(F.col("o_orderdate").cast("string").try_cast("timestamp_ntz")).alias("o_orderdate"),
        F.col("o_orderpriority").cast("string"))


@register("csv_scan", ORDERS_OUT_SQL)
def csv_scan(spark, sf):
    path = scratch_path(spark, "orders_csv")
    fx.read(spark, sf, "orders").write.options(header="true").csv(path)
    return _orders_out(readers.csv_scan(spark, path))


@register("bad_records", """
SELECT count(*) AS records, count_if(o_orderkey % 97 IN (0, 1, 2)) AS bad_records, count_if(o_orderkey % 97 NOT IN (0, 1, 2)) AS good_rows,
       CAST(sum(o_custkey) FILTER (o_orderkey % 97 NOT IN (0, 1, 2)) AS BIGINT) AS custkeys,
       count_if(o_orderkey % 97 = 0) AS kept_lines FROM orders""")
def bad_records(spark, sf):
    """orders as CSV lines, some with a word for a number, a field more or one
    less: all are counted in the scan that reads the others."""
    key, cust, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    kind = key % 97
    line = F.when(kind == 0, F.concat_ws(",", key, cust, F.lit("not a number"))).when(kind == 1, F.concat_ws(",", key, cust, price, F.lit("more"))).when(
        kind == 2, F.concat_ws(",", key, cust)).otherwise(F.concat_ws(",", key, cust, price))
    path = scratch_path(spark, "orders_with_bad_lines")
    fx.read(spark, sf, "orders").select(line.alias("value")).write.text(path)
    schema = "o_orderkey bigint, o_custkey bigint, o_totalprice double"
    rows, seen = readers.load_checked(spark, path, T.StructType.fromDDL(schema), "csv", header="false")
    good = F.col("_bad_record").isNull()
    facts = rows.agg(F.count_if(good).alias("good_rows"), F.sum(F.when(good, F.col("o_custkey"))).alias("custkeys"),
                     F.count_if(F.col("_bad_record").endswith("not a number")).alias("kept_lines")).first()  # one row
    counts = seen.get
    return literal_rows(spark, [(counts["records"], counts["bad_records"], *facts)],
                        "records bigint, bad_records bigint, good_rows bigint, custkeys bigint, kept_lines bigint")


@register("tsv_to_csv", ORDERS_OUT_SQL)
def tsv_to_csv(spark, sf):
    tsv = scratch_path(spark, "orders_tsv")
    fx.read(spark, sf, "orders").write.options(header="true", sep="\t").csv(tsv)
    dst = readers.tsv_to_csv(spark, tsv, scratch_path(spark, "orders_from_tsv"))
    return _orders_out(readers.load(spark, dst, "csv"))


FORMATS = ["parquet", "json", "csv", "csv.gz", "tsv", "text"]


@register("multi_format_scan", union([
    f"SELECT '{f}' AS format, CAST(count(*) AS BIGINT) AS rows, "
    + ("CAST(sum(length(s_name)) AS BIGINT) AS checksum" if f == "text" else
       "CAST(sum(s_suppkey) + sum(length(s_name)) AS BIGINT) AS checksum")
    + " FROM supplier" for f in FORMATS]))
def multi_format_scan(spark, sf):
    sup = fx.read(spark, sf, "supplier")
    parts = []
    for f in FORMATS:
        path = scratch_path(spark, f"supplier.{f}")
        if f == "parquet":
            sup.write.parquet(path)
        elif f == "json":
            sup.write.json(path)
        elif f == "csv":
            sup.write.options(header="true").csv(path)
        elif f == "csv.gz":
            sup.write.options(header="true", compression="gzip").csv(path)
        elif f == "tsv":
            sup.write.options(header="true", sep="\t").csv(path)
        else:
            sup.select("s_name").write.text(path)
        df = readers.load(spark, path)
        if f == "text":
            chk = F.sum(F.length("value"))
        else:
            chk = F.sum(F.col("s_suppkey").cast("bigint")) + F.sum(F.length("s_name"))
        parts.append(df.agg(F.lit(f).alias("format"), F.count(F.lit(1)).alias("rows"),
                            chk.cast("bigint").alias("checksum")))
    return reduce(DataFrame.unionByName, parts)


@register("report_json_roundtrip", _column_report_sql(fx.plain("orders")))
def report_json_roundtrip(spark, sf):
    p = profile(fx.read(spark, sf, "orders"), "orders", correlations=False)
    path = io.write_json(p.column_report, scratch_path(spark, "column_report"))
    return _column_report_cols(io.read_column_report(spark, path))


@register("report_csv_roundtrip", _flat_sql(fx.plain("orders")))
def report_csv_roundtrip(spark, sf):
    p = profile(fx.read(spark, sf, "orders"), "orders", correlations=False)
    path = io.write_flat_csv(p.report_flat, scratch_path(spark, "report_flat"))
    return _flat_spark(io.read_flat_csv(spark, path))


@register("report_readback", f"""
SELECT column_name, type, origin, count, max_value, min_value, mean, stddev FROM ({_sections_sql(fx.plain('part'))})""")
def report_readback(spark, sf):
    p = profile(fx.read(spark, sf, "part"), "part", correlations=False)
    paths = io.save_profile(p, scratch_path(spark, "profiles"), "part.csv")
    walked = io.walk_sections(io.read_column_report(spark, paths["column_report"]))
    return walked.select("column_name", "type", "origin", "count", "max_value", "min_value",
                         _r4("mean").alias("mean"), _r4("stddev").alias("stddev"))


BATCH_TABLES = ["region", "nation", "supplier", "customer", "part"]


@register("batch_profile", union([
    f"SELECT table_name, total_records, total_variables, n_numeric, n_categorical, n_date, n_unique_text "
    f"FROM ({_table_report_sql(fx.plain(t), t)})" for t in BATCH_TABLES]))
def batch_profile(spark, sf):
    rep = profile_many({t: fx.read(spark, sf, t) for t in BATCH_TABLES}, correlations=False)
    return rep.select("table_name", "total_records", "total_variables", "n_numeric", "n_categorical", "n_date",
                      "n_unique_text")


@register("preview_rows", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def preview_rows(spark, sf):
    return readers.preview(fx.read(spark, sf, "orders"), 5, ["o_orderkey"])


@register("positional_columns", "SELECT " + ", ".join(
    f'{q(n)} AS "{i}"' for i, (n, _) in enumerate(fx.TABLES["orders"])) + " FROM orders")
def positional_columns(spark, sf):
    return readers.positional_columns(fx.read(spark, sf, "orders"))


SAMPLE = 0.1


@register("table_sample", f"SELECT * FROM orders WHERE substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) < "
                          f"'{round(SAMPLE * 2**32):08x}'")
def table_sample(spark, sf):
    return readers.hash_sample(fx.read(spark, sf, "orders"), SAMPLE, ["o_orderkey"])


@register("run_metadata", "SELECT 'region' AS table_name, true AS times_in_order, true AS recent, "
                          f"'{tablelens_version}' AS profiler_version, true AS named_by_start")
def run_metadata(spark, sf):
    p = profile(fx.read(spark, sf, "region"), "region", **MINIMAL)
    m = io.run_metadata(p, "region.csv")
    stamp = p.started_at.strftime(io.STAMP_FORMAT)
    return m.select(
        "table_name", (F.col("started_at") <= F.col("ended_at")).alias("times_in_order"),
        (F.abs(F.unix_seconds("ended_at") - F.unix_seconds(F.current_timestamp())) < 3600).alias("recent"),
        "profiler_version", (F.col("output_name") == f"region_profiled_table_{stamp}").alias("named_by_start"))


# ================================================================ step 6: size

def _size_sql(n, t):
    w = {"bigint": 8, "double": 8, "timestamp_ntz": 8, "int": 4, "float": 4}.get(t)
    return f"count({q(n)}) * {w}" if w else f"coalesce(sum(strlen({q(n)})), 0)"


@register("size_bytes", union([
    f"SELECT '{n}' AS column_name, CAST({_size_sql(n, t)} AS BIGINT) AS size_bytes FROM {_src(fx.LI_NULLS)}"
    for n, t in fx.columns(fx.LI_NULLS)]))
def size_bytes(spark, sf):
    return _facts(spark, sf, fx.LI_NULLS, **MINIMAL).select("column_name", "size_bytes")


def _size_total(t):
    return " + ".join(_size_sql(n, ty) for n, ty in fx.TABLES[t])


@register("avg_record_bytes", f"""
SELECT 'orders' AS table_name, CAST({_size_total('orders')} AS BIGINT) AS estimated_size_bytes,
       round(CAST({_size_total('orders')} AS DOUBLE) / count(*), 4) AS avg_record_bytes FROM orders""")
def avg_record_bytes(spark, sf):
    p = profile(fx.read(spark, sf, "orders"), "orders", **MINIMAL)
    return p.table_report.select("table_name", "estimated_size_bytes", _r4("avg_record_bytes").alias("avg_record_bytes"))


SIZE_TABLES = ["lineitem", "documents", "pages", "conversations"]


@register("partition_advice", union([
    f"SELECT '{t}' AS table_name, CAST({_size_total(t)} AS BIGINT) AS estimated_size_bytes, "
    f"CAST(greatest(1, ceil(CAST({_size_total(t)} AS DOUBLE) / {128 * 1024 * 1024})) AS BIGINT) "
    f"AS recommended_partitions FROM {t}" for t in SIZE_TABLES]))
def partition_advice(spark, sf):
    rep = profile_many({t: fx.read(spark, sf, t) for t in SIZE_TABLES}, **MINIMAL)
    return rep.select("table_name", "estimated_size_bytes", "recommended_partitions")


# ============================================================ step 7: extras

@register("zeros", _per_col(fx.LI_NUM,
          "SELECT '{name}' AS column_name, CAST(count_if({c} = 0) AS BIGINT) AS zero_count, "
          "round(CAST(count_if({c} = 0) AS DOUBLE) * 100.0 / count(*), 4) AS zero_percent FROM {src}"))
def zeros(spark, sf):
    f = _facts(spark, sf, fx.LI_NUM, **MINIMAL)
    return f.select("column_name", "zero_count",
                    _r4(F.try_divide(F.col("zero_count") * F.lit(100.0), F.col("record_count"))).alias("zero_percent"))


@register("empty_strings", _per_col(fx.LI_TEXT,
          "SELECT '{name}' AS column_name, CAST(count_if({c} = '') AS BIGINT) AS empty_string_count FROM {src}"))
def empty_strings(spark, sf):
    return _facts(spark, sf, fx.LI_TEXT, **MINIMAL).select("column_name", "empty_string_count")


@register("percent_fill", _per_col(fx.LI_NULLS,
          "SELECT '{name}' AS column_name, round(100.0 - round(CAST(count(*) - count({c}) AS DOUBLE) * 100.0 "
          "/ count(*), 3), 3) AS percent_fill FROM {src}"))
def percent_fill(spark, sf):
    return _facts(spark, sf, fx.LI_NULLS, **MINIMAL).select("column_name", "percent_fill")


@register("percent_numeric", _per_col(fx.LI_TEXT,
          "SELECT '{name}' AS column_name, round(CAST(count_if(regexp_full_match({c}, '"
          + P.REAL_PATTERN + "')) AS DOUBLE) * 100.0 / count({c}), 3) AS percent_numeric FROM {src}"))
def percent_numeric(spark, sf):
    return _facts(spark, sf, fx.LI_TEXT, **MINIMAL).select("column_name", "percent_numeric")


@register("max_length", _per_col(fx.plain("documents"),
          "SELECT '{name}' AS column_name, CAST(max(length({c})) AS BIGINT) AS max_length FROM {src}",
          types=("string",)))
def max_length(spark, sf):
    f = _facts(spark, sf, fx.plain("documents"), **MINIMAL)
    return f.where(F.col("dclass") == "categorical").select("column_name", "max_length")


@register("avg_length", _per_col(fx.plain("documents"),
          "SELECT '{name}' AS column_name, round(avg(length({c})), 4) AS avg_length FROM {src}",
          types=("string",)))
def avg_length(spark, sf):
    f = _facts(spark, sf, fx.plain("documents"), **MINIMAL)
    return f.where(F.col("dclass") == "categorical").select("column_name", _r4("avg_length").alias("avg_length"))


def _skew_sql(n):
    x = f"CAST({q(n)} AS DOUBLE)"
    return (f"SELECT '{n}' AS column_name, round(avg(pow({x} - m, 3)) / pow(stddev_pop({x}), 3), 4) AS skewness "
            f"FROM {_src(fx.plain('lineitem'))}, (SELECT avg(CAST({q(n)} AS DOUBLE)) AS m FROM lineitem)")


@register("skewness", union([_skew_sql(n) for n, t in fx.TABLES["lineitem"] if t in NUMERIC_TYPES]))
def skewness(spark, sf):
    p = profile(fx.read(spark, sf, "lineitem"), distinct=False, top_k=0, correlations=False)
    return p.column_facts.where(F.col("dclass") == "numeric").select("column_name", _r4("skewness").alias("skewness"))


def _hist_sql(n, bins=10):
    x = f"CAST({q(n)} AS DOUBLE)"
    b = (f"CASE WHEN hi = lo THEN 0 ELSE least(greatest(floor(({x} - lo) * {float(bins)} / (hi - lo)), 0), "
         f"{bins - 1}) END")
    return (f"SELECT column_name, bucket, round(lo + (hi - lo) * bucket / {float(bins)}, 6) AS lo, "
            f"round(lo + (hi - lo) * (bucket + 1) / {float(bins)}, 6) AS hi, cnt FROM ("
            f"SELECT '{n}' AS column_name, CAST({b} AS BIGINT) AS bucket, lo, hi, CAST(count(*) AS BIGINT) AS cnt "
            f"FROM lineitem, (SELECT min({x}) AS lo, max({x}) AS hi FROM lineitem) "
            f"WHERE {q(n)} IS NOT NULL GROUP BY 1, 2, 3, 4)")


@register("histogram", union([_hist_sql(n) for n, t in fx.TABLES["lineitem"] if t in NUMERIC_TYPES]))
def histogram_q(spark, sf):
    h = histogram(fx.read(spark, sf, "lineitem"), 10)
    return h.select("column_name", "bucket", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "cnt")


_RHO_SQL, _REJ_SQL = _numeric_pairs_sql(fx.LI_NUM)


@register("correlation", f"SELECT column_a, column_b, round(rho, 4) AS rho FROM ({_RHO_SQL})")
def correlation(spark, sf):
    c = pr.correlation(fx.spark_table(spark, sf, fx.LI_NUM))
    return c.select("column_a", "column_b", _r4("rho").alias("rho"))


@register("warn_correlated", f"SELECT column_b AS column_name, 'correlated' AS warning, round(rho, 4) AS value "
                             f"FROM ({_RHO_SQL}) WHERE abs(rho) > {wn.CORRELATION}")
def warn_correlated(spark, sf):
    c = pr.correlation(fx.spark_table(spark, sf, fx.LI_NUM))
    return wn.warn_correlated(c).select("column_name", "warning", _r4("value").alias("value"))


_CONST_NUM_SQL = union([f"SELECT '{n}' AS column_name FROM {_src(fx.LI_NUM)} HAVING count(DISTINCT {q(n)}) = 1"
                        for n, _ in fx.columns(fx.LI_NUM)])


@register("rejected_columns", f"SELECT DISTINCT column_name FROM ({_REJ_SQL} UNION ALL {_CONST_NUM_SQL})")
def rejected_columns(spark, sf):
    p = profile(fx.spark_table(spark, sf, fx.LI_NUM), "lineitem", sections=False, top_k=1)
    return wn.rejected_columns(p.warnings).select("column_name")


@register("warn_missing", union([
    f"SELECT '{n}' AS column_name, 'missing' AS warning, CAST(count(*) - count({q(n)}) AS DOUBLE) AS value "
    f"FROM ({fx.DOCS_LABELS_SQL}) HAVING CAST(count(*) - count({q(n)}) AS DOUBLE) * 100.0 / count(*) > "
    f"{wn.MISSING_PERCENT}" for n, _ in fx.DOCS_LABELS_COLS]))
def warn_missing(spark, sf):
    p = profile(fx.docs_labels(spark, sf), "documents", **MINIMAL)
    return wn.warn_missing(p.column_facts).select("column_name", "warning", "value")


KEY_COLUMNS = [n for n, _ in fx.TABLES["lineitem"]]
KEY_MAX = 4


def _keys_sql() -> str:
    combos = [c for k in range(1, KEY_MAX + 1) for c in itertools.combinations(KEY_COLUMNS, k)]
    flag = {c: "k_" + "_".join(str(KEY_COLUMNS.index(x)) for x in c) for c in combos}
    checks = ", ".join(
        f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(q(x) for x in c)} FROM lineitem)) = count(*) "
        f"AND count_if({' OR '.join(f'{q(x)} IS NULL' for x in c)}) = 0 AS {flag[c]}" for c in combos)
    rows = []
    for c in combos:
        subs = [s for k in range(1, len(c)) for s in itertools.combinations(c, k)]
        cond = " AND ".join([flag[c]] + [f"NOT {flag[s]}" for s in subs])
        rows.append(f"SELECT '{','.join(c)}' AS key_columns, {len(c)} AS size FROM u WHERE {cond}")
    return f"WITH u AS (SELECT {checks} FROM lineitem)\n" + union(rows)


@register("composite_keys", _keys_sql())
def composite_keys(spark, sf):
    keys = pr.composite_keys(fx.read(spark, sf, "lineitem"), max_size=KEY_MAX)
    return keys.select(F.array_join("key_columns", ",").alias("key_columns"), "size")


def _warnings_sql(spec) -> str:
    src = _src(spec)
    cols = fx.columns(spec)
    parts = []
    for n, t in cols:
        c = q(n)
        parts.append(f"SELECT '{n}' AS column_name, 'missing' AS warning, CAST(count(*) - count({c}) AS DOUBLE) AS value, "
                     f"false AS rejected FROM {src} HAVING CAST(count(*) - count({c}) AS DOUBLE) * 100.0 / count(*) > "
                     f"{wn.MISSING_PERCENT}")
        parts.append(f"SELECT '{n}', 'constant', CAST(count(DISTINCT {c}) AS DOUBLE), true FROM {src} "
                     f"HAVING count(DISTINCT {c}) = 1")
        if t == "string":
            parts.append(f"SELECT '{n}', 'high_cardinality', CAST(count(DISTINCT {c}) AS DOUBLE), false FROM {src} "
                         f"HAVING count(DISTINCT {c}) > {wn.CARDINALITY}")
        if t in NUMERIC_TYPES:
            x = f"CAST({c} AS DOUBLE)"
            sk = f"avg(pow({x} - m, 3)) / pow(stddev_pop({x}), 3)"
            parts.append(f"SELECT '{n}', 'skewed', round({sk}, 4), false FROM {src}, "
                         f"(SELECT avg({x}) AS m FROM {src}) HAVING abs({sk}) > {wn.SKEWNESS}")
            parts.append(f"SELECT '{n}', 'zeros', CAST(count_if({c} = 0) AS DOUBLE), false FROM {src} "
                         f"HAVING count_if({c} = 0) * 100.0 / count(*) > {wn.ZEROS_PERCENT}")
    rho, _ = _numeric_pairs_sql(spec)
    parts.append(f"SELECT column_b, 'correlated', round(rho, 4), true FROM ({rho}) WHERE abs(rho) > {wn.CORRELATION}")
    return union(parts)


@register("warnings", _warnings_sql(fx.LI_NULLS))
def warnings_q(spark, sf):
    p = profile(fx.spark_table(spark, sf, fx.LI_NULLS), "lineitem", sections=True)
    return p.warnings.select("column_name", "warning", _r4("value").alias("value"), "rejected")


# ============================================================ dates by shape

SHAPED = ["yyyyMMdd", "dd MMM yyyy", "MMMM d, yyyy HH:mm:ss", "MM/dd/yyyy hh:mm:ss a", "dd-MMM-yy", "yyyyMMdd'T'HHmmss"]


@register("date_shapes", """
WITH e AS (SELECT event_id % 6 AS layout, date_trunc(CASE WHEN event_id % 6 IN (0, 1, 4) THEN 'day' ELSE 'second' END, ts) AS t FROM events WHERE ts IS NOT NULL)
SELECT CAST(layout AS INTEGER) AS layout, count(*) AS n, count(t) AS right_, strftime(min(t), '%Y-%m-%d %H:%M:%S') AS first_, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS last_
FROM e GROUP BY layout""")
def date_shapes(spark, sf):
    """events.ts written in six layouts (names of months, no separators, 12
    hours, years of two digits) and read by the shape of each different text."""
    events = fx.read(spark, sf, "events").where("ts IS NOT NULL").select((F.col("event_id") % 6).cast("int").alias("layout"), "ts")
    whole = F.when(F.col("layout").isin(0, 1, 4), F.date_trunc("day", "ts")).otherwise(F.date_trunc("second", "ts")).cast("timestamp_ntz")
    text = F.coalesce(*[F.when(F.col("layout") == k, F.date_format("ts", f)) for k, f in enumerate(SHAPED)])
    values = events.select("layout", text.alias("value"), whole.alias("t")).groupBy("layout", "value", "t").agg(F.count(F.lit(1)).alias("cnt"))
    read = values.withColumn("read", shaped_timestamp(F.col("value")))
    shown = lambda f: F.date_format(f("read"), "yyyy-MM-dd HH:mm:ss")
    return read.groupBy("layout").agg(F.sum("cnt").alias("n"), F.sum(F.when(F.col("read") == F.col("t"), F.col("cnt"))).alias("right_"),
                                      shown(F.min).alias("first_"), shown(F.max).alias("last_"))


# ============================================================ streaming

#: Rows of a streamed file: a batch has the same jobs whatever its rows, 64 files are 13 million.
STREAM_FILE = 200_000


@register("stream_profile", union([
    f"SELECT '{n}' AS column_name, CAST(count(*) AS BIGINT) AS record_count, "
    f"CAST(count({q(n)}) AS BIGINT) AS number_non_empty_cells, CAST({_size_sql(n, t)} AS BIGINT) AS size_bytes "
    f"FROM {_src(fx.LI_NULLS)}" for n, t in fx.columns(fx.LI_NULLS)]))
def stream_profile(spark, sf):
    """lineitem written as several files, streamed a few files per batch,
    each batch profiled; totals summed over the batch reports."""
    from ..streaming.arrivals import profile_arrivals, running_counts

    df = fx.spark_table(spark, sf, fx.LI_NULLS)
    src = scratch_path(spark, "arrivals")
    df.write.option("maxRecordsPerFile", STREAM_FILE).parquet(src)
    out = scratch_path(spark, "arrival_reports")
    q = profile_arrivals(spark, src, df.schema, out, files_per_batch=64, sections=False, top_k=0,
                         correlations=False)
    q.awaitTermination()
    return running_counts(spark, out).select("column_name", "record_count", "number_non_empty_cells", "size_bytes")


@register("approx_distinct_count", _per_col(fx.LI_NULLS,
          "SELECT '{name}' AS column_name, true AS close, CAST(count({c}) AS BIGINT) AS number_non_empty_cells FROM {src}"))
def approx_distinct_count(spark, sf):
    """HyperLogLog counts, held against exact ones: within four times the stated error (or 2)."""
    opts = dict(sections=False, top_k=0, correlations=False)
    approx = profile(fx.spark_table(spark, sf, fx.LI_NULLS), approx=True, **opts).column_report
    exact = profile(fx.spark_table(spark, sf, fx.LI_NULLS), **opts).column_report.select(
        "ordinal", F.col("unique_values").alias("exact"))
    off = F.abs(F.col("unique_values") - F.col("exact"))
    return approx.join(exact, "ordinal").select(
        "column_name", (off <= F.greatest(F.lit(2), F.col("exact") * 0.08)).alias("close"), "number_non_empty_cells")


# ====================================================== states that merge

STATE_COLUMNS = ("column_name", "record_count", "number_non_empty_cells", "distinct_close", "mean", "stddev", "max_length")


def _state_sql() -> str:
    parts = []
    for n, t in fx.columns(fx.LI_NULLS):
        number = t in NUMERIC_TYPES
        finite = f"FILTER (WHERE isfinite(CAST({q(n)} AS DOUBLE)))"
        mean, std = ((r4(f"avg(CAST({q(n)} AS DOUBLE)) {finite}"), r4(f"stddev_samp(CAST({q(n)} AS DOUBLE)) {finite}")) if number
                     else ("CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)"))
        length = f"CAST(max(length({q(n)})) AS BIGINT)" if t == "string" else "CAST(NULL AS BIGINT)"
        parts.append(f"SELECT '{n}' AS column_name, CAST(count(*) AS BIGINT) AS record_count, CAST(count({q(n)}) AS BIGINT) AS number_non_empty_cells, "
                     f"true AS distinct_close, {mean} AS mean, {std} AS stddev, {length} AS max_length FROM {_src(fx.LI_NULLS)}")
    return union(parts)


def _held_against_exact(spark, sf, found: DataFrame) -> DataFrame:
    """Distinct counts within six standard errors (or 2) of the exact ones."""
    exact = profile(fx.spark_table(spark, sf, fx.LI_NULLS), sections=False, top_k=0, correlations=False).column_report.select(
        "ordinal", F.col("unique_values").alias("exact"))
    close = F.abs(F.col("unique_values") - F.col("exact")) <= F.greatest(F.lit(2.0), F.col("exact") * 6 * st.DISTINCT_ERROR)
    found = found.withColumn("mean", _r4("mean")).withColumn("stddev", _r4("stddev"))
    return found.join(F.broadcast(exact), "ordinal").withColumn("distinct_close", close).select(*STATE_COLUMNS)  # one row per column


@register("merged_state", _state_sql())
def merged_state(spark, sf):
    """The profile of a table from the states of four parts of it, one of them empty."""
    df = fx.spark_table(spark, sf, fx.LI_NULLS)
    states = st.column_states(df, F.pmod(F.xxhash64(*df.columns), F.lit(3))).unionByName(st.column_states(df.where(F.lit(False))))
    return _held_against_exact(spark, sf, st.finish(st.merge_states(states)))


@register("stream_state", _state_sql())
def stream_state(spark, sf):
    """The same from the batches of a stream of files."""
    from ..streaming.arrivals import profile_arrivals, running_profile

    df = fx.spark_table(spark, sf, fx.LI_NULLS)
    src, out = scratch_path(spark, "growing"), scratch_path(spark, "growing_reports")
    df.write.option("maxRecordsPerFile", STREAM_FILE).parquet(src)
    profile_arrivals(spark, src, df.schema, out, files_per_batch=64, states=True, sections=False, top_k=0, correlations=False).awaitTermination()
    return _held_against_exact(spark, sf, running_profile(spark, out))


NUMBERS = [n for n, t in fx.TABLES["lineitem"] if t in NUMERIC_TYPES]


def _numbers(df: DataFrame) -> DataFrame:
    """(column_name, x): the numbers of lineitem in long form."""
    return df.select(*[F.col(n).cast("double").alias(n) for n in NUMBERS]).unpivot([], NUMBERS, "column_name", "x").where("x IS NOT NULL")


@register("quantile_ranks", union([f"SELECT '{n}' AS column_name, {p}::DOUBLE AS quantile, true AS within, count({q(n)}) AS n FROM lineitem"
                                   for n in NUMBERS for p in (0.05, 0.25, 0.5, 0.75, 0.95)]))
def quantile_ranks(spark, sf):
    """Quantiles from the KLL sketches: the true ranks of each are within the stated error."""
    df = fx.read(spark, sf, "lineitem")
    found = st.finish(st.column_states(df.select(*NUMBERS)), quantiles=(0.05, 0.25, 0.5, 0.75, 0.95))
    found = found.select("column_name", F.inline(F.arrays_zip(F.col("quantiles").alias("value"), F.col("quantiles_of").alias("quantile"))))
    both = _numbers(df).join(F.broadcast(found), "column_name")  # five rows per column
    held = both.groupBy("column_name", "quantile").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") < F.col("value")).alias("below"), F.count_if(F.col("x") <= F.col("value")).alias("upto"))
    slack = F.col("n") * st.RANK_ERROR
    want = F.col("n") * F.col("quantile")
    return held.select("column_name", "quantile", ((F.col("below") <= want + slack) & (F.col("upto") >= want - slack)).alias("within"), "n")


@register("equal_depth_histogram", union([f"SELECT '{n}' AS column_name, {b} AS bucket, true AS within, round(count({q(n)}) / 10.0, 1)::DOUBLE AS depth FROM lineitem"
                                          for n in NUMBERS for b in range(10)]))
def equal_depth_histogram(spark, sf):
    """Equal-depth graph data: the share of numbers up to each bucket's upper bound is right within the stated error."""
    df = fx.read(spark, sf, "lineitem")
    found = st.equal_depth(st.column_states(df.select(*NUMBERS))).drop("ordinal")
    both = _numbers(df).join(F.broadcast(found), "column_name")  # ten rows per column
    held = both.groupBy("column_name", "bucket", "depth").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") < F.col("high")).alias("below"), F.count_if(F.col("x") <= F.col("high")).alias("upto"))
    want, slack = (F.col("bucket") + 1) * F.col("depth"), F.col("n") * st.RANK_ERROR
    return held.select("column_name", "bucket", ((F.col("below") <= want + slack) & (F.col("upto") >= want - slack)).alias("within"), F.round("depth", 1).alias("depth"))


#: Columns of so few values that the heavy-hitter summary holds them all.
FEW_VALUES = ["l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@register("heavy_hitters", union([
    f"SELECT * FROM (SELECT '{n}' AS column_name, {sql_canon(n, dict(fx.TABLES['lineitem'])[n])} AS value, count(*) AS cnt FROM lineitem WHERE {q(n)} IS NOT NULL GROUP BY ALL ORDER BY cnt DESC, value LIMIT 5)"
    for n in FEW_VALUES]))
def heavy_hitters(spark, sf):
    """Most frequent values without a shuffle of values."""
    found = st.finish(st.column_states(fx.read(spark, sf, "lineitem").select(*FEW_VALUES)))
    return found.select("column_name", F.inline("top_values")).withColumnRenamed("count", "cnt")


# ============================================== options that leave passes out

_OFF = {"distinct": dict(distinct=False), "correlations": dict(correlations=False), "approx": dict(approx=True)}


@register("options_left_out", union([
    f"SELECT '{name}' AS option, {'NULL' if name == 'distinct' else '(SELECT count(*) FROM (SELECT 1 FROM customer HAVING count(DISTINCT c_name) = count(c_name)))'}::BIGINT AS n_unique_text, "
    f"{'0' if name == 'approx' else 'NULL'}::BIGINT AS n_rejected, {'0' if name == 'approx' else '5'}::BIGINT AS with_top_values, "
    f"'{kinds}' AS not_computed"
    for name, kinds in (("distinct", "constant|high_cardinality"), ("correlations", "correlated"))]))
def options_left_out(spark, sf):
    """What a profile did not compute is NULL and named, not 'nothing found'."""
    parts = []
    for name in ("distinct", "correlations"):
        p = profile(fx.read(spark, sf, "customer"), "customer", **_OFF[name])
        gone = p.warnings.where("column_name IS NULL").agg(F.array_join(F.array_sort(F.collect_list("warning")), "|").alias("not_computed"))
        held = p.column_report.agg(F.count("top_five_value").alias("with_top_values"))
        parts.append(p.table_report.select(F.lit(name).alias("option"), "n_unique_text", "n_rejected").join(held).join(gone))
    return reduce(DataFrame.unionByName, parts)


# ===================================== batch reports, document, graph data

@register("batch_columns", union([
    f"SELECT '{t}' AS table_name, * FROM ({_column_report_sql(fx.plain(t))})" for t in BATCH_TABLES]))
def batch_columns(spark, sf):
    rep = batch_reports({t: fx.read(spark, sf, t) for t in BATCH_TABLES}, correlations=False)["column_report"]
    return rep.select("table_name", *_column_report_cols(rep).columns[:-1],
                      F.array_join("top_five_value", "|").alias("top_five_value"))


@register("nested_document", f"""
SELECT t.total_records, t.n_numeric, t.n_categorical, c.column_name, c.unique_values, c.top_five_value
FROM ({_table_report_sql(fx.plain('supplier'), 'supplier')}) t, ({_column_report_sql(fx.plain('supplier'))}) c""")
def nested_document(spark, sf):
    """One nested profile document, written, read and walked."""
    p = profile(fx.read(spark, sf, "supplier"), "supplier")
    path = io.write_json(p.document, scratch_path(spark, "document"))
    d = io.read_document(spark, path, p.document.schema)
    return d.select("general_db_info.total_records", F.col("attribute_analysis.numeric").alias("n_numeric"),
                    F.col("attribute_analysis.categorical").alias("n_categorical"),
                    F.explode("column_analysis").alias("c")).select(
        "total_records", "n_numeric", "n_categorical", "c.column_name", "c.unique_values",
        F.array_join("c.top_five_value", "|").alias("top_five_value"))


def _categories_sql(spec, top: int) -> str:
    ranked = (f"SELECT column_name, value, cnt, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS rank "
              f"FROM ({_freq_sql(spec)}) WHERE column_name IN ("
              + ", ".join(f"'{n}'" for n, t in fx.columns(spec) if t == "string") + ")")
    return (f"SELECT column_name, CAST(rank AS BIGINT) AS rank, value, cnt FROM ({ranked}) WHERE rank <= {top} UNION ALL "
            f"SELECT column_name, {top + 1}, NULL, CAST(sum(cnt) AS BIGINT) FROM ({ranked}) WHERE rank > {top} GROUP BY column_name")


@register("category_counts", _categories_sql(fx.plain("orders"), 2))
def category_counts_q(spark, sf):
    return category_counts(fx.read(spark, sf, "orders"), 2).select("column_name", "rank", "value", "cnt")


@register("month_counts", union([
    f"SELECT '{n}' AS column_name, strftime({q(n)}, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS cnt FROM {t} "
    f"WHERE {q(n)} IS NOT NULL GROUP BY 1, 2" for t, n in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"))]))
def month_counts_q(spark, sf):
    return reduce(DataFrame.unionByName, [
        month_counts(fx.read(spark, sf, t)).select("column_name", "month", "cnt") for t in ("orders", "lineitem")])


@register("warn_many", f"""
SELECT column_name, 'many_warnings' AS warning, CAST(count(*) AS DOUBLE) AS value
FROM ({_warnings_sql(fx.LI_NUM)}) WHERE NOT (warning = 'skewed' AND column_name = 'const_n') GROUP BY column_name HAVING count(*) > 1""")
def warn_many(spark, sf):
    w = profile(fx.spark_table(spark, sf, fx.LI_NUM), "lineitem").warnings
    return wn.warn_many(w.where("warning <> 'many_warnings'"), 1).select("column_name", "warning", "value")
