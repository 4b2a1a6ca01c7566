"""One canonical string per value, so that values of any type can share the
frequency table. Equal values must give equal strings (``-0.0`` and ``0.0``
merge, map entries are ordered) and different values different strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .types import fixed_width, is_float_like, is_string

# Timestamps inside nested values keep their microseconds.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def canonical(c: Column, dt: T.DataType) -> Column:
    if is_string(dt):
        return c
    if is_float_like(dt):
        # adding zero folds -0.0 into 0.0; NaN keeps its own spelling
        return F.when(F.isnan(c), F.lit("NaN")).otherwise((c + F.lit(0.0).cast(dt)).cast("string"))
    if isinstance(dt, T.BinaryType):
        return F.hex(c)
    if isinstance(dt, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(c)), _JSON)
    if isinstance(dt, (T.ArrayType, T.StructType)):
        return F.to_json(c, _JSON)
    return c.cast("string")


def value_bytes(c: Column, dt: T.DataType) -> Column:
    """Bytes held by one non-null value (NULL for a null value)."""
    w = fixed_width(dt)
    if w is not None:
        return F.when(c.isNotNull(), F.lit(w).cast("bigint"))
    if is_string(dt) or isinstance(dt, T.BinaryType):
        return F.octet_length(c).cast("bigint")
    if isinstance(dt, T.ArrayType):
        ew = fixed_width(dt.elementType)
        if ew is not None:
            return (F.size(c) * F.lit(ew)).cast("bigint")
    return F.octet_length(F.to_json(c)).cast("bigint")

