"""The profile plan: wires the passes into the report DataFrames.

    scan ──► expand ─► partial agg ─► shuffle(column, value) ─► frequency table
              facts, top-k windows (≤ #columns rows each) ─► one row per column
    scan ──► correlation pass (global agg, no value shuffle)

A report's first use runs the passes it needs and cuts their lineage with a
reliable checkpoint (see ``persist``): the per-column facts and the correlation
are computed once, and every report after that reads those small tables.
All joins in the assembly are between tables of at most a few rows per column
of the schema, so broadcasting them is bounded by the schema, not the data.

What a profile's options leave out is NULL in the reports, and the warnings
name each kind that was not computed.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import __version__
from ..operators import frequency as fq
from ..operators import pairs, size, typed
from ..operators import warnings as wn
from ..operators.facts import frequency_facts
from ..functions.types import CATEGORICAL, DATE, NUMERIC, OTHER, dtype_class, is_float_like, literal_rows
from ..operators.scalars import col_ref, scalar_pass
from .checkpoint import materialize

COLUMN_REPORT_SCHEMA = T.StructType(
    [
        T.StructField("column_name", T.StringType()),
        T.StructField("dtype", T.StringType()),
        T.StructField("record_count", T.LongType()),
        T.StructField("unique_values", T.LongType()),
        T.StructField("number_non_empty_cells", T.LongType()),
        T.StructField("number_empty_cells", T.LongType()),
        T.StructField("null_proportion", T.DoubleType()),
        T.StructField("top_five_value", T.ArrayType(T.StringType())),
        T.StructField("data_types", T.ArrayType(typed.TYPED_SECTION)),
        # additions beyond the historical layout
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("dclass", T.StringType()),
        T.StructField("nan_count", T.LongType()),
        T.StructField("zero_count", T.LongType()),
        T.StructField("empty_string_count", T.LongType()),
        T.StructField("max_length", T.LongType()),
        T.StructField("avg_length", T.DoubleType()),
        T.StructField("percent_fill", T.DoubleType()),
        T.StructField("percent_numeric", T.DoubleType()),
        T.StructField("skewness", T.DoubleType()),
        T.StructField("size_bytes", T.LongType()),
    ]
)

TABLE_REPORT_SCHEMA = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("total_records", T.LongType()),
        T.StructField("total_variables", T.LongType()),
        T.StructField("total_missing_fraction", T.DoubleType()),
        T.StructField("estimated_size_bytes", T.LongType()),
        T.StructField("avg_record_bytes", T.DoubleType()),
        T.StructField("recommended_partitions", T.LongType()),
        T.StructField("n_numeric", T.LongType()),
        T.StructField("n_categorical", T.LongType()),
        T.StructField("n_date", T.LongType()),
        T.StructField("n_unique_text", T.LongType()),
        T.StructField("n_rejected", T.LongType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("ended_at", T.TimestampType()),
        T.StructField("profiler_version", T.StringType()),
    ]
)

FLAT_COLUMNS = (
    "column_name", "dtype", "record_count", "number_non_empty_cells", "number_empty_cells",
    "null_proportion", "unique_values", "top_five_value",
    "type", "origin", "count", "max_value", "min_value", "mean", "stddev",
    "shortest_values", "longest_values", "average_length",
)


def null_proportion(nulls: Column, n: Column) -> Column:
    """Percentage of NULL cells, 3 decimals; NULL for an empty table."""
    return F.round(F.try_divide(nulls.cast("double") * F.lit(100.0), n), 3)


@dataclass
class Profile:
    df: DataFrame
    table_name: str = "table"
    top_k: int = 5
    extremes_k: int = 5
    sections: bool = True
    distinct: bool = True
    correlations: bool = True
    class_mode: str = "semantic"
    approx: bool = False
    approx_rsd: float = 0.02
    nan_as_null: bool = False
    thresholds: dict = field(default_factory=dict)
    started_at: _dt.datetime = field(default_factory=lambda: _dt.datetime.now(_dt.timezone.utc))

    def __post_init__(self) -> None:
        if self.nan_as_null:
            self.df = nan_to_null(self.df)

    # ------------------------------------------------------------- passes
    @property
    def uses_frequencies(self) -> bool:
        return (self.distinct or self.top_k > 0) and not self.approx and bool(self.df.schema.fields)

    @cached_property
    def typed_frequencies(self) -> DataFrame:
        """The one shuffle of the profile: counts per (column, typed value), NULL included.

        Every consumer below references ``cnt``, so Catalyst plans the same
        aggregate everywhere and the shuffle is computed once and reused.
        """
        return fq.typed_frequencies(self.df)

    @cached_property
    def frequencies(self) -> DataFrame:
        if not self.uses_frequencies:
            return fq.value_frequencies(self.df)
        # Unfiltered: the NULL group (value NULL) stays in and the top-k
        # rankings drop it above their windows, so no filter is pushed into
        # the shared aggregate and every consumer reuses its one shuffle.
        return fq.render(self.typed_frequencies, self.df, keep_null=True)

    @cached_property
    def correlation(self) -> DataFrame | None:
        return materialize(pairs.correlation(self.df)) if self.correlations else None

    @cached_property
    def top_values(self) -> DataFrame:
        return fq.top_values(self.frequencies, self.top_k)

    @cached_property
    def shortest_values(self) -> DataFrame:
        return fq.shortest_values(self.frequencies, self.extremes_k)

    @cached_property
    def longest_values(self) -> DataFrame:
        return fq.longest_values(self.frequencies, self.extremes_k)

    @cached_property
    def per_column(self) -> DataFrame:
        """Every per-column fact in one small table (one row per column):
        scalar facts, distinct counts, top values and text extremes.

        Computed by one job and cut from its lineage (reliable checkpoint in
        the cluster's checkpoint folder) when a folder is available, so each
        report after it reads a table of #columns rows and the data is
        scanned and shuffled exactly once per profile.
        """
        if self.uses_frequencies:
            facts = frequency_facts(self.typed_frequencies, self.df, self.sections, self.class_mode)
        else:
            if self.approx and self.distinct:
                # HyperLogLog distinct counts, no frequency table: one scan, no value shuffle
                facts = scalar_pass(self.df, sections=self.sections, class_mode=self.class_mode,
                                    approx_distinct=self.approx_rsd)
            else:
                facts = scalar_pass(self.df, sections=self.sections, class_mode=self.class_mode).select(
                    "*", F.lit(None).cast("bigint").alias("unique_values"))
            facts = facts.withColumn("avg_distinct_length", F.lit(None).cast("double"))
        if self.top_k > 0 and self.uses_frequencies:
            facts = facts.join(F.broadcast(fq.ranked_array(self.top_values, "top_five_value")), "ordinal", "left")
        else:
            facts = facts.withColumn("top_five_value", F.lit(None).cast("array<string>"))
        if self.sections and self.uses_frequencies:
            facts = facts.join(F.broadcast(fq.text_extremes(self.frequencies, self.extremes_k)), "ordinal", "left")
        else:
            facts = facts.withColumn("shortest_values", F.lit(None).cast("array<string>")).withColumn(
                "longest_values", F.lit(None).cast("array<string>"))
        # the joined sides hold at most one row per column of the schema
        return materialize(facts)

    @cached_property
    def typed_sections(self) -> DataFrame:
        """Long form: one row per (column, section) with TEXT extras filled."""
        return typed.section_rows(self.per_column).select(
            "ordinal", "column_name", "section_order", *[f.name for f in typed.TYPED_SECTION.fields])

    @cached_property
    def column_facts(self) -> DataFrame:
        """Every per-column fact, one row per column (COLUMN_REPORT_SCHEMA)."""
        pc = self.per_column
        n, nn = F.col("n"), F.col("non_null")
        nulls = n - nn
        sections = (F.coalesce(typed.data_types(pc), F.array().cast(T.ArrayType(typed.TYPED_SECTION)))
                    if self.sections else F.lit(None).cast(T.ArrayType(typed.TYPED_SECTION)))
        unique = (F.coalesce(F.col("unique_values"), F.lit(0)).cast("bigint") if self.distinct
                  else F.lit(None).cast("bigint"))
        return pc.select(
            F.col("column_name"),
            F.col("dtype"),
            n.alias("record_count"),
            unique.alias("unique_values"),
            nn.alias("number_non_empty_cells"),
            nulls.alias("number_empty_cells"),
            null_proportion(nulls, n).alias("null_proportion"),
            (F.coalesce(F.col("top_five_value"), F.array().cast("array<string>"))
             if self.top_k > 0 and self.uses_frequencies else F.col("top_five_value")).alias("top_five_value"),
            sections.alias("data_types"),
            F.col("ordinal"),
            F.col("dclass"),
            F.col("nan_count"),
            F.col("zero_count"),
            F.col("empty_count").alias("empty_string_count"),
            F.col("max_length"),
            F.col("avg_length"),
            F.round(F.lit(100.0) - null_proportion(nulls, n), 3).alias("percent_fill"),
            F.round(F.try_divide(F.col("numeric_text_count") * F.lit(100.0), nn), 3).alias("percent_numeric"),
            F.col("skewness"),
            F.col("value_bytes").alias("size_bytes"),
        )

    # --------------------------------------------------------------- reports
    @cached_property
    def column_report(self) -> DataFrame:
        return self.column_facts.select(*[f.name for f in COLUMN_REPORT_SCHEMA.fields])

    @cached_property
    def report_flat(self) -> DataFrame:
        """One row per (column, typed section); columns without a section keep
        one row with NULL section fields (explode_outer)."""
        x = self.column_facts.select(
            "ordinal", *[c for c in FLAT_COLUMNS[:8]], F.explode_outer("data_types").alias("s")
        )
        return x.select("ordinal", *FLAT_COLUMNS[:8], *[F.col("s")[c].alias(c) for c in FLAT_COLUMNS[8:]])

    @cached_property
    def warnings(self) -> DataFrame:
        return wn.all_warnings(self.column_facts, self.correlation, distinct=self.distinct, sections=self.sections,
                               **self.thresholds)

    @cached_property
    def table_report(self) -> DataFrame:
        rejected = wn.rejected_columns(self.warnings).select("ordinal", F.lit(True).alias("_rejected"))
        ended_at = _dt.datetime.now(_dt.timezone.utc)  # the passes have run
        unknown = F.lit(None).cast("bigint")
        # both sides hold at most one row per column of the schema
        f = self.column_facts.join(F.broadcast(rejected), "ordinal", "left")
        agg = f.agg(
            F.coalesce(F.max("record_count"), F.lit(0)).cast("bigint").alias("total_records"),
            F.count(F.lit(1)).cast("bigint").alias("total_variables"),
            F.sum("number_empty_cells").alias("_nulls"),
            F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint").alias("estimated_size_bytes"),
            F.count_if(F.col("dclass") == "numeric").alias("n_numeric"),
            F.count_if(F.col("dclass") == "categorical").alias("n_categorical"),
            F.count_if(F.col("dclass") == "date").alias("n_date"),
            F.count_if(
                (F.col("dclass") == "categorical")
                & (F.col("unique_values") == F.col("number_non_empty_cells"))
                & (F.col("number_non_empty_cells") > 0)
            ).alias("n_unique_text"),
            F.count_if(F.col("_rejected")).alias("n_rejected"),
        )
        cells = F.col("total_records") * F.col("total_variables")
        return agg.select(
            F.lit(self.table_name).alias("table_name"),
            "total_records",
            "total_variables",
            F.try_divide(F.col("_nulls").cast("double"), cells).alias("total_missing_fraction"),
            "estimated_size_bytes",
            F.try_divide(F.col("estimated_size_bytes").cast("double"), F.col("total_records")).alias("avg_record_bytes"),
            size.partition_advice(F.col("estimated_size_bytes")).alias("recommended_partitions"),
            F.col("n_numeric").cast("bigint"),
            F.col("n_categorical").cast("bigint"),
            F.col("n_date").cast("bigint"),
            (F.col("n_unique_text").cast("bigint") if self.distinct else unknown).alias("n_unique_text"),
            (F.col("n_rejected").cast("bigint") if self.distinct and self.correlations else unknown).alias("n_rejected"),
            F.lit(self.started_at).cast("timestamp").alias("started_at"),
            F.lit(ended_at).cast("timestamp").alias("ended_at"),
            F.lit(__version__).alias("profiler_version"),
        )

    @cached_property
    def document(self) -> DataFrame:
        """The whole profile as one nested row: table facts, column classes,
        column reports in order, warnings."""
        general = self.table_report.select(F.struct("*").alias("general_db_info"), F.struct(
            F.col("n_numeric").alias("numeric"), F.col("n_categorical").alias("categorical"), F.col("n_date").alias("date"),
        ).alias("attribute_analysis"))

        def rows(df: DataFrame, name: str) -> DataFrame:
            # one struct per column of the schema (or warning), in order
            return df.agg(F.array_sort(F.collect_list(F.struct("ordinal", *[c for c in df.columns if c != "ordinal"]))).alias(name))

        return (general.crossJoin(rows(self.column_report, "column_analysis"))  # one row each
                .crossJoin(rows(self.warnings.withColumnRenamed("rejected", "is_rejected"), "warnings")))

    # ------------------------------------------------------------ execution
    def persist(self) -> "Profile":
        """Run the passes now. The per-column facts and the correlation are
        kept in the cluster's checkpoint folder; all reports read them."""
        self.per_column, self.correlation  # noqa: B018 — computed and checkpointed on first use
        return self


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN cells of float and double columns as NULL."""
    return df.select(*[
        F.nanvl(col_ref(f.name), F.lit(None).cast(f.dataType)).alias(f.name) if is_float_like(f.dataType) else col_ref(f.name)
        for f in df.schema.fields])


def profile(df: DataFrame, table_name: str = "table", **options) -> Profile:
    """Profile a DataFrame. Options: top_k, extremes_k, sections, distinct,
    correlations, class_mode ('semantic'|'prefix'), thresholds (dict), nan_as_null,
    approx (HyperLogLog distinct counts with relative error approx_rsd and no
    frequency table: no top values or shortest/longest lists)."""
    return Profile(df, table_name, **options)


def light_profile(df: DataFrame, table_name: str = "table", top_k: int = 5) -> Profile:
    """Counts, nulls and top values only: no distinct counts, typed sections
    or correlations."""
    return Profile(df, table_name, top_k=top_k, sections=False, distinct=False, correlations=False)


def profile_many(tables: dict[str, DataFrame], **options) -> DataFrame:
    """Table reports of several inputs, one row per table."""
    reps = [profile(df, name, **options).table_report for name, df in tables.items()]
    return reduce(DataFrame.unionByName, reps)


def batch_reports(tables: dict[str, DataFrame], **options) -> dict[str, DataFrame]:
    """Every report of several inputs: table_report, column_report, report_flat
    and warnings, each over all tables with their names."""
    done = {name: profile(df, name, **options) for name, df in tables.items()}
    named = lambda p, report: getattr(p, report).withColumn("table_name", F.lit(p.table_name))
    return {report: reduce(DataFrame.unionByName, [named(p, report) for p in done.values()])
            for report in ("table_report", "column_report", "report_flat", "warnings")}


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, total_records); no column is read."""
    return reduce(DataFrame.unionByName, [
        df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("total_records")) for name, df in tables.items()])


def schema_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, ordinal, column_name, dtype), from the schemas only: no data is read."""
    first = next(iter(tables.values()))
    rows = [(name, i, f.name, f.dataType.simpleString()) for name, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return literal_rows(first.sparkSession, rows, "table_name string, ordinal int, column_name string, dtype string")


def dtype_classes(df: DataFrame, mode: str = "semantic") -> dict[str, int]:
    """Counts of columns per class, from the schema only."""
    out = {NUMERIC: 0, CATEGORICAL: 0, DATE: 0, OTHER: 0}
    for f in df.schema.fields:
        out[dtype_class(f.dataType, mode)] += 1
    return out
