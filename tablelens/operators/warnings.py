"""Data-quality warnings: thresholds applied to per-column facts.

Inputs are the small per-column fact table (one row per column) and the
correlation long form, so every warning is a filter over schema-sized data.
Schema of every warning table: column_name, ordinal, warning, value,
rejected, message.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import literal_rows

# Default thresholds.
MISSING_PERCENT = 5.0        # warn when more than this % of cells are NULL
CARDINALITY = 50             # categorical column with more distinct values
SKEWNESS = 20.0              # |γ1| above this
ZEROS_PERCENT = 10.0         # numeric column with more than this % zeros
CORRELATION = 0.9            # |ρ| above this rejects the later column
MANY = 3                     # a column with more warnings than this

WARNING_COLUMNS = ("column_name", "ordinal", "warning", "value", "rejected", "message")


def _shape(df: DataFrame, warning: str, value: Column, rejected: bool, message: Column) -> DataFrame:
    return df.select(
        F.col("column_name"),
        F.col("ordinal").cast("int").alias("ordinal"),
        F.lit(warning).alias("warning"),
        value.cast("double").alias("value"),
        F.lit(rejected).alias("rejected"),
        message.alias("message"),
    )


def warn_missing(facts: DataFrame, threshold: float = MISSING_PERCENT) -> DataFrame:
    f = facts.where(F.col("null_proportion") > threshold)
    msg = F.format_string("column %s: %d cells without a value (%.1f%%)", "column_name", "number_empty_cells", "null_proportion")
    return _shape(f, "missing", F.col("number_empty_cells"), False, msg)


def warn_cardinality(facts: DataFrame, threshold: int = CARDINALITY) -> DataFrame:
    f = facts.where((F.col("dclass") == "categorical") & (F.col("unique_values") > threshold))
    msg = F.format_string("column %s: %d different texts", "column_name", "unique_values")
    return _shape(f, "high_cardinality", F.col("unique_values"), False, msg)


def warn_skewed(facts: DataFrame, threshold: float = SKEWNESS) -> DataFrame:
    f = facts.where(F.abs(F.col("skewness")) > threshold)
    msg = F.format_string("column %s: skewness %.3f", "column_name", "skewness")
    return _shape(f, "skewed", F.col("skewness"), False, msg)


def warn_zeros(facts: DataFrame, threshold: float = ZEROS_PERCENT) -> DataFrame:
    pct = F.try_divide(F.col("zero_count") * F.lit(100.0), F.col("record_count"))
    f = facts.withColumn("_pct", pct).where(F.col("_pct") > threshold)
    msg = F.format_string("column %s: %d zeros (%.1f%%)", "column_name", "zero_count", "_pct")
    return _shape(f, "zeros", F.col("zero_count"), False, msg)


def warn_constant(facts: DataFrame) -> DataFrame:
    f = facts.where(F.col("unique_values") == 1)
    msg = F.format_string("column %s: always %s", F.col("column_name"), F.coalesce(F.get("top_five_value", F.lit(0)), F.lit("the same")))
    return _shape(f, "constant", F.col("unique_values"), True, msg)


def warn_correlated(corr: DataFrame, threshold: float = CORRELATION) -> DataFrame:
    f = corr.where(F.abs(F.col("rho")) > threshold).select(
        F.col("column_b").alias("column_name"), F.col("ordinal_b").alias("ordinal"), "rho", "column_a"
    )
    msg = F.format_string("column %s: follows column %s, correlation %.5f", "column_name", "column_a", "rho")
    return _shape(f, "correlated", F.col("rho"), True, msg)


def warn_many(warnings: DataFrame, threshold: int = MANY) -> DataFrame:
    """Columns that more than ``threshold`` warnings name."""
    f = warnings.groupBy("column_name", "ordinal").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > threshold)
    return _shape(f, "many_warnings", F.col("_n"), False, F.format_string("column %s: %d warnings", "column_name", "_n"))


def _not_computed(spark, kinds: list[str]) -> DataFrame:
    rows = [(None, None, k, None, False, "not computed: the profile's options leave it out") for k in kinds]
    return literal_rows(spark, rows, "column_name string, ordinal int, warning string, value double, rejected boolean, message string")


def all_warnings(facts: DataFrame, corr: DataFrame | None = None, distinct: bool = True, sections: bool = True,
                 **thresholds) -> DataFrame:
    """Every warning. A kind whose facts the profile did not compute has one
    row with no column and no value that says so."""
    parts = [
        warn_missing(facts, thresholds.get("missing", MISSING_PERCENT)),
        warn_zeros(facts, thresholds.get("zeros", ZEROS_PERCENT)),
    ]
    missing = []
    if distinct:
        parts += [warn_cardinality(facts, thresholds.get("cardinality", CARDINALITY)), warn_constant(facts)]
    else:
        missing += ["high_cardinality", "constant"]
    if sections:
        parts.append(warn_skewed(facts, thresholds.get("skewness", SKEWNESS)))
    else:
        missing.append("skewed")
    if corr is not None:
        parts.append(warn_correlated(corr, thresholds.get("correlation", CORRELATION)))
    else:
        missing.append("correlated")
    found = reduce(DataFrame.unionByName, parts)
    found = found.unionByName(warn_many(found, thresholds.get("many", MANY)))
    return found.unionByName(_not_computed(facts.sparkSession, missing)) if missing else found


def rejected_columns(warnings: DataFrame) -> DataFrame:
    """Distinct columns rejected by any warning (constant or correlated)."""
    return warnings.where("rejected").select("ordinal", "column_name").distinct()
