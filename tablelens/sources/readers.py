"""Reading inputs: files of several formats, samples, previews.

Everything returns a lazy DataFrame; schema inference is opt-out (pass
``schema=``) because inferring a CSV schema is one extra full pass.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scalars import col_ref

# File extension -> (format, extra options).
EXTENSIONS = {
    ".csv": ("csv", {}),
    ".tsv": ("csv", {"sep": "\t"}),
    ".tab": ("csv", {"sep": "\t"}),
    ".json": ("json", {}),
    ".jsonl": ("json", {}),
    ".ndjson": ("json", {}),
    ".parquet": ("parquet", {}),
    ".orc": ("orc", {}),
    ".txt": ("text", {}),
    ".text": ("text", {}),
}
# A marker no text field holds, so that CSV NULL detection is left to bare
# empty fields only.
UNUSED_NULL_MARKER = "\u0000"
COMPRESSED = (".gz", ".bz2", ".deflate", ".zst", ".lz4", ".snappy")


def detect_format(path: str) -> tuple[str, dict]:
    p = path.rstrip("/").lower()
    for ext in COMPRESSED:
        if p.endswith(ext):
            p = p[: -len(ext)]
    _, ext = os.path.splitext(p)
    if ext in EXTENSIONS:
        return EXTENSIONS[ext]
    raise ValueError(f"cannot tell the format of {path!r}; pass fmt=")


def load(spark: SparkSession, path: str, fmt: str | None = None, schema=None, **options) -> DataFrame:
    """Read a csv / tsv / json / parquet / orc / text source (compressed files
    by extension), or any other installed format such as ``delta``.

    CSV/TSV: header row, inferred types unless a schema is given, and empty
    quoted fields kept as '' (only a bare empty field is NULL).
    """
    extra: dict = {}
    if fmt is None:
        fmt, extra = detect_format(path)
    elif fmt == "tsv":
        fmt, extra = "csv", {"sep": "\t"}
    opts = {**extra, **options}
    if fmt == "csv":
        opts.setdefault("header", "true")
        # a quoted "" stays '' (an empty string), a bare empty field is NULL
        opts.setdefault("nullValue", UNUSED_NULL_MARKER)
        if schema is None:
            opts.setdefault("inferSchema", "true")
    reader = spark.read.format(fmt).options(**opts)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def load_checked(spark: SparkSession, path: str, schema: T.StructType, fmt: str | None = None, bad: str = "_bad_record",
                 **options) -> tuple[DataFrame, Observation]:
    """A CSV, TSV or JSON source read under a schema, with what doesn't fit it
    accounted for. Rows that can't be parsed (a value of another type, too few or too many
    fields) keep what could be read and hold their whole line in the column ``bad``,
    which is NULL otherwise. The second value has ``records``, ``bad_records``
    and a ``checksum`` of all fields (it doesn't depend on the order of rows) after the
    first action, from that same scan: no second pass, whatever the action reads.
    """
    whole = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad, "columnPruning": "false"} | options
    seen = Observation()
    rows = load(spark, path, fmt, whole, **options)
    # the checksum needs all fields: they are parsed whatever columns are used, or the count would depend on them
    checksum = F.bit_xor(F.xxhash64(*[col_ref(f.name) for f in schema.fields]))
    return rows.observe(seen, F.count(F.lit(1)).alias("records"), F.count(col_ref(bad)).alias("bad_records"), checksum.alias("checksum")), seen


def csv_scan(spark: SparkSession, path: str, sep: str = ",", schema=None, **options) -> DataFrame:
    return load(spark, path, "csv", schema=schema, sep=sep, **options)


def tsv_to_csv(spark: SparkSession, src: str, dst: str, mode: str = "overwrite", schema=None) -> str:
    """Convert a TSV source to CSV with a header, in parallel (no single-file
    step). Without a schema, every field is read as text so nothing changes
    on the way through."""
    df = spark.read.options(header="true", sep="\t", emptyValue="")
    df = (df.schema(schema) if schema is not None else df).csv(src)
    df.write.mode(mode).options(header="true", emptyValue="").csv(dst)
    return dst


def sample(df: DataFrame, fraction: float = 0.1, seed: int | None = 42) -> DataFrame:
    """Bernoulli row sample (no replacement); seeded by default."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def hash_sample(df: DataFrame, fraction: float, key: list[str]) -> DataFrame:
    """Deterministic sample: the rows whose key's digest is in the first
    ``fraction`` of all digests (to one part in 2^32); the same rows in any
    partitioning and in any engine with md5."""
    if fraction >= 1:
        return df
    digest = F.md5(F.concat_ws("\x1f", *[col_ref(k).cast("string") for k in key]))
    return df.where(F.substring(digest, 1, 8) < F.lit(f"{max(0, round(fraction * 2**32)):08x}"))


def preview(df: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """First n rows; ordered (a top-n, not a full sort) when order_by is given."""
    if order_by:
        return df.orderBy(*[col_ref(c) for c in order_by]).limit(n)
    return df.limit(n)


def positional_columns(df: DataFrame) -> DataFrame:
    """Rename columns to their positions '0', '1', … (safe for odd names)."""
    return df.toDF(*[str(i) for i in range(len(df.columns))])
