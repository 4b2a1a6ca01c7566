"""Graph data: equal-width histograms of numeric columns, the largest
categories of text columns, counts per month of date columns.

Histogram bounds come from one global min/max aggregate over the finite values
(one row per table reaches the driver). Every value is unpivoted to (column,
value), bucketed with a plain arithmetic expression and counted by (column,
bucket): partial aggregation collapses each task's rows to a few rows per
column before the shuffle, so a column that holds most rows in one bucket
costs nothing extra.

bucket = floor((v - lo) * bins / (hi - lo)), clamped to [0, bins - 1], so the
maximum lands in the last bucket; a constant column has one bucket 0.
Infinities have buckets of their own: -1 and ``bins``. NULL and NaN values are
not counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import is_datetime, is_float_like, is_numeric, literal_rows
from .frequency import string_ordinals, top_values, value_frequencies
from .scalars import col_ref

HISTOGRAM_SCHEMA = "ordinal int, column_name string, bucket bigint, lo double, hi double, cnt bigint"


def histogram(df: DataFrame, bins: int = 10, columns: list[str] | None = None) -> DataFrame:
    fields = [
        (i, f) for i, f in enumerate(df.schema.fields)
        if is_numeric(f.dataType) and (columns is None or f.name in columns)
    ]
    if not fields:
        return df.sparkSession.createDataFrame([], HISTOGRAM_SCHEMA)

    def val(f: T.StructField):
        c = col_ref(f.name).cast("double")
        return F.when(~F.isnan(c), c) if is_float_like(f.dataType) else c

    inf = float("inf")
    ends = df.agg(*[
        e(F.when(F.abs(val(f)) < inf, val(f))).alias(f"{n}{i}") for i, f in fields for n, e in (("lo", F.min), ("hi", F.max))
    ]).first()  # one row
    bounds = literal_rows(df.sparkSession, [(i, f.name, ends[f"lo{i}"], ends[f"hi{i}"]) for i, f in fields],
                          "ordinal int, column_name string, lo double, hi double")
    values = (
        df.select(*[val(f).alias(str(i)) for i, f in fields])
        .unpivot([], [str(i) for i, _ in fields], "slot", "v")
        .where(F.col("v").isNotNull())
        .select(F.col("slot").cast("int").alias("ordinal"), "v")
    )
    lo, hi, v = F.col("lo"), F.col("hi"), F.col("v")
    raw = F.floor((v - lo) * F.lit(float(bins)) / (hi - lo))
    bucket = (F.when(v == -inf, F.lit(-1)).when(v == inf, F.lit(bins)).when(hi == lo, F.lit(0))
              .otherwise(F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1))))
    # bounds: one row per numeric column
    counted = (
        values.join(F.broadcast(bounds), "ordinal")
        .groupBy("ordinal", "column_name", bucket.cast("bigint").alias("bucket"), "lo", "hi")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    width, b = hi - lo, F.col("bucket")

    def edge(k):
        return F.when(b < 0, F.lit(-inf)).when(b >= bins, F.lit(inf)).otherwise(lo + width * k / F.lit(float(bins)))

    return counted.select("ordinal", "column_name", "bucket", edge(b).alias("lo"), edge(b + 1).alias("hi"), "cnt")


def category_counts(df: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` most frequent values of every text column and what the other
    values have together: (ordinal, column_name, rank, value, cnt); the rest has
    no value and rank ``top`` + 1."""
    freq = value_frequencies(df, string_ordinals(df))
    best = top_values(freq, top)
    whole = freq.groupBy("ordinal", "column_name").agg(F.sum("cnt").alias("all"))
    seen = best.groupBy("ordinal").agg(F.sum("cnt").alias("seen"))
    rest = whole.join(F.broadcast(seen), "ordinal").where("all > seen")  # one row per column
    rest = rest.select("ordinal", "column_name", F.lit(top + 1).cast("bigint").alias("rank"),
                       F.lit(None).cast("string").alias("value"), (F.col("all") - F.col("seen")).alias("cnt"))
    return best.select("ordinal", "column_name", "rank", "value", "cnt").unionByName(rest)


def month_counts(df: DataFrame) -> DataFrame:
    """Values of every date column by month: (ordinal, column_name, month as yyyy-MM, cnt)."""
    fields = [(i, f) for i, f in enumerate(df.schema.fields) if is_datetime(f.dataType)]
    if not fields:
        return df.sparkSession.createDataFrame([], "ordinal int, column_name string, month string, cnt bigint")
    months = [F.struct(F.lit(i).alias("ordinal"), F.lit(f.name).alias("column_name"),
                       F.date_format(F.to_date(col_ref(f.name)), "yyyy-MM").alias("month")) for i, f in fields]
    return (df.select(F.inline(F.array(*months))).where("month IS NOT NULL")
            .groupBy("ordinal", "column_name", "month").agg(F.count(F.lit(1)).alias("cnt")))
