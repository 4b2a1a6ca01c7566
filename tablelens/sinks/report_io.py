"""Saving and reading back profiles.

Reports are small (rows per column of the profiled table), so single-file
output (``coalesce(1)``) is safe here; data itself never goes through it.
JSON keeps the nested layout; the flat CSV has one row per (column, typed
section) with list fields written as JSON text so they can be parsed back.
"""

from __future__ import annotations

import datetime as _dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.typed import TYPED_SECTION
from ..plans.report import COLUMN_REPORT_SCHEMA, TABLE_REPORT_SCHEMA, Profile

# Output layout.
NAME_PATTERN = "{stem}_profiled_table_{stamp}"
STAMP_FORMAT = "%Y%m%d_%H%M%S"  # sortable, 24-hour
CSV_NULL = "\\N"                # NULL marker in CSV, so '' stays ''

FLAT_CSV_SCHEMA = T.StructType(
    [
        T.StructField("column_name", T.StringType()),
        T.StructField("dtype", T.StringType()),
        T.StructField("record_count", T.LongType()),
        T.StructField("number_non_empty_cells", T.LongType()),
        T.StructField("number_empty_cells", T.LongType()),
        T.StructField("null_proportion", T.DoubleType()),
        T.StructField("unique_values", T.LongType()),
        T.StructField("top_five_value", T.StringType()),
        *[
            T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.ArrayType) else f.dataType)
            for f in TYPED_SECTION.fields
        ],
    ]
)
ARRAY_FIELDS = ("top_five_value", "shortest_values", "longest_values")


def output_name(input_name: str, when: _dt.datetime | None = None) -> str:
    stem = os.path.basename(input_name.rstrip("/")).split(".")[0]
    when = when or _dt.datetime.now(_dt.timezone.utc)
    return NAME_PATTERN.format(stem=stem, stamp=when.strftime(STAMP_FORMAT))


def write_json(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = True) -> str:
    (df.coalesce(1) if single_file else df).write.mode(mode).json(path)
    return path


def flat_for_csv(flat: DataFrame) -> DataFrame:
    """Flat report with list fields as JSON text (parseable, unlike a cast)."""
    return flat.select(
        *[F.to_json(F.col(f.name)).alias(f.name) if f.name in ARRAY_FIELDS else F.col(f.name)
          for f in FLAT_CSV_SCHEMA.fields]
    )


def write_flat_csv(flat: DataFrame, path: str, mode: str = "overwrite") -> str:
    (
        flat_for_csv(flat).coalesce(1).write.mode(mode)
        .options(header="true", nullValue=CSV_NULL, escape='"')
        .csv(path)
    )
    return path


def read_column_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COLUMN_REPORT_SCHEMA).json(path)


def read_table_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TABLE_REPORT_SCHEMA).json(path)


def read_flat_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = (
        spark.read.schema(FLAT_CSV_SCHEMA)
        .options(header="true", multiLine="true", escape='"', nullValue=CSV_NULL)
        .csv(path)
    )
    return raw.select(
        *[F.from_json(F.col(f.name), "array<string>").alias(f.name) if f.name in ARRAY_FIELDS else F.col(f.name)
          for f in FLAT_CSV_SCHEMA.fields]
    )


def read_document(spark: SparkSession, path: str, schema) -> DataFrame:
    """A saved document; the schema is that of ``Profile.document``."""
    return spark.read.schema(schema).json(path)


def walk_sections(column_report: DataFrame) -> DataFrame:
    """One row per (column, typed section) of a read-back report."""
    return column_report.select("column_name", "dtype", F.explode("data_types").alias("s")).select(
        "column_name", "dtype", "s.*"
    )


def save_profile(p: Profile, base: str, input_name: str | None = None, mode: str = "overwrite") -> dict[str, str]:
    """Write table report, column report and the whole profile as one nested
    document (JSON) and the flat report (CSV) under
    ``base/<name>_profiled_table_<stamp>/``. Facts are computed once."""
    p.persist()
    root = os.path.join(base, output_name(input_name or p.table_name, p.started_at))
    out = {
        "table_report": write_json(p.table_report, os.path.join(root, "table_report"), mode),
        "column_report": write_json(p.column_report, os.path.join(root, "column_report"), mode),
        "report_flat": write_flat_csv(p.report_flat, os.path.join(root, "report_flat"), mode),
        "document": write_json(p.document, os.path.join(root, "document"), mode),
    }
    return out


def run_metadata(p: Profile, input_name: str | None = None) -> DataFrame:
    """Reproduction facts: table, start/end, profiler version, output name."""
    name = output_name(input_name or p.table_name, p.started_at)
    return p.table_report.select(
        "table_name", "started_at", "ended_at", "profiler_version", F.lit(name).alias("output_name")
    )
