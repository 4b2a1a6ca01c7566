"""Typed sections per column (REAL / INTEGER / TEXT / DATE/TIME, native or
parsed from text) and the per-row typed views of a column.

Sections come from the scalar pass (numbers and dates) and the frequency pass
(TEXT's shortest/longest/average length of distinct values). A section is
kept only when more than one value has that type. Order: REAL native, INTEGER
native, TEXT, DATE/TIME, REAL parsed, INTEGER parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsing import parsed_int, parsed_real, parsed_timestamp
from ..functions.types import is_datetime, is_integral, is_real, is_string
from .scalars import INTEGER, REAL, col_ref

TYPED_SECTION = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("origin", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("max_value", T.StringType()),
        T.StructField("min_value", T.StringType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("stddev", T.DoubleType()),
        T.StructField("shortest_values", T.ArrayType(T.StringType())),
        T.StructField("longest_values", T.ArrayType(T.StringType())),
        T.StructField("average_length", T.DoubleType()),
    ]
)


def _section(order: int, typ: str, origin, count: Column, mx, mn, mean, std,
             shortest=None, longest=None, avg_len=None) -> Column:
    def lit_or(x, dt):
        return (x if isinstance(x, Column) else F.lit(x)).cast(dt)

    return F.struct(
        F.lit(order).alias("section_order"),
        F.lit(typ).alias("type"),
        lit_or(origin, "string").alias("origin"),
        count.cast("bigint").alias("count"),
        lit_or(mx, "string").alias("max_value"),
        lit_or(mn, "string").alias("min_value"),
        lit_or(mean, "double").alias("mean"),
        lit_or(std, "double").alias("stddev"),
        lit_or(shortest, "array<string>").alias("shortest_values"),
        lit_or(longest, "array<string>").alias("longest_values"),
        lit_or(avg_len, "double").alias("average_length"),
    )


def section_array(df: DataFrame) -> Column:
    """All six candidate sections of a per-column fact row, in report order.

    TEXT takes its lists and average distinct length from the row when the
    row carries them (shortest_values, longest_values, avg_distinct_length).
    """
    s = F.col
    cols = set(df.columns)

    def opt(name):
        return s(name) if name in cols else None

    return F.array(
        _section(1, REAL, "native", F.when(s("num_type") == REAL, s("num_count")),
                 s("num_max"), s("num_min"), s("num_mean"), s("num_std")),
        _section(2, INTEGER, "native", F.when(s("num_type") == INTEGER, s("num_count")),
                 s("num_max"), s("num_min"), s("num_mean"), s("num_std")),
        _section(3, "TEXT", "native", s("text_count"), None, None, None, None,
                 opt("shortest_values"), opt("longest_values"), opt("avg_distinct_length")),
        _section(4, "DATE/TIME", s("dt_origin"), s("dt_count"), s("dt_max"), s("dt_min"), None, None),
        _section(5, REAL, "parsed", s("pr_count"), s("pr_max"), s("pr_min"), s("pr_mean"), s("pr_std")),
        _section(6, INTEGER, "parsed", s("pi_count"), s("pi_max"), s("pi_min"), s("pi_mean"), s("pi_std")),
    )


def section_rows(facts: DataFrame, min_count: int = 1) -> DataFrame:
    """Long form (ordinal, column_name, section_order, TYPED_SECTION fields):
    the sections whose count is greater than ``min_count``."""
    return facts.select("ordinal", "column_name", F.inline(section_array(facts))).where(F.col("count") > min_count)


def data_types(facts: DataFrame, min_count: int = 1) -> Column:
    """The report's ``data_types`` array, built per row (no aggregation)."""
    kept = F.filter(section_array(facts), lambda x: F.coalesce(x["count"] > min_count, F.lit(False)))
    return F.transform(kept, lambda x: F.struct(*[x[f.name].alias(f.name) for f in TYPED_SECTION.fields]))


def typed_values(df: DataFrame, name: str) -> DataFrame:
    """Row-level typed views of one column (what each value is as each type).

    Columns: value (the column as text), as_integer, as_real, as_text,
    as_timestamp — NULL where the value is not of that type.
    """
    fld = df.schema[name]
    c, dt = col_ref(name), fld.dataType
    if is_string(dt):
        as_int, as_real, as_text, as_ts = parsed_int(c), parsed_real(c), c, parsed_timestamp(c)
    else:
        as_int = c.cast("bigint") if is_integral(dt) else F.lit(None).cast("bigint")
        as_real = c.cast("double") if is_real(dt) else F.lit(None).cast("double")
        as_text = F.lit(None).cast("string")
        as_ts = c.cast("timestamp_ntz") if is_datetime(dt) else F.lit(None).cast("timestamp_ntz")
    return df.select(
        c.cast("string").alias("value"),
        as_int.alias("as_integer"),
        as_real.alias("as_real"),
        as_text.alias("as_text"),
        as_ts.alias("as_timestamp"),
    )
