"""Column classification rules, read from the schema (never from data).

Two rules are offered for the table-level class counts:

* ``semantic`` (default): by Spark type, so ``bigint``/``double``/``decimal``
  count as numeric and ``timestamp`` as a date.
* ``prefix``: the literal rule on ``DataType.simpleString()`` prefixes
  (``int``/``float`` -> numeric, ``string`` -> categorical, ``date`` -> date),
  kept for users who need the historical counts.
"""

from __future__ import annotations

from pyspark.sql import types as T

NUMERIC = "numeric"
CATEGORICAL = "categorical"
DATE = "date"
OTHER = "other"

INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
REAL_TYPES = (T.FloatType, T.DoubleType, T.DecimalType)
DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
STRING_TYPES = (T.StringType, T.VarcharType, T.CharType)


def is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, INTEGRAL_TYPES)


def is_real(dt: T.DataType) -> bool:
    return isinstance(dt, REAL_TYPES)


def is_numeric(dt: T.DataType) -> bool:
    return is_integral(dt) or is_real(dt)


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, STRING_TYPES)


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, DATETIME_TYPES)


def is_float_like(dt: T.DataType) -> bool:
    """Types that can hold NaN."""
    return isinstance(dt, (T.FloatType, T.DoubleType))


def dtype_class(dt: T.DataType, mode: str = "semantic") -> str:
    if mode == "prefix":
        s = dt.simpleString()
        if s.startswith("int") or s.startswith("float"):
            return NUMERIC
        if s.startswith("string"):
            return CATEGORICAL
        if s.startswith("date"):
            return DATE
        return OTHER
    if mode != "semantic":
        raise ValueError(f"unknown class mode {mode!r}")
    if is_numeric(dt):
        return NUMERIC
    if is_string(dt):
        return CATEGORICAL
    if is_datetime(dt):
        return DATE
    return OTHER


def fixed_width(dt: T.DataType) -> int | None:
    """Bytes per non-null value for fixed-width types, else None."""
    if isinstance(dt, (T.BooleanType, T.ByteType)):
        return 1
    if isinstance(dt, T.ShortType):
        return 2
    if isinstance(dt, (T.IntegerType, T.FloatType, T.DateType)):
        return 4
    if isinstance(dt, (T.LongType, T.DoubleType, T.TimestampType, T.TimestampNTZType)):
        return 8
    if isinstance(dt, T.DecimalType):
        return 8 if dt.precision <= 18 else 16
    return None


def literal_rows(spark, rows: list[tuple], schema: str):
    """A small DataFrame built from literals inside the plan (no Python
    worker, no driver-side RDD). For schema-sized tables only."""
    from pyspark.sql import functions as F

    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    if not rows:
        return spark.createDataFrame([], schema)
    structs = [
        F.struct(*[F.lit(v).cast(t).alias(n) for (n, t), v in zip(fields, row)])
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))
