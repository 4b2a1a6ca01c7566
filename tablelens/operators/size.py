"""Table size and partition advice, from the scalar pass's byte sums.

Size = bytes of all non-null values: fixed width × count for fixed-width types,
``octet_length`` for text/binary, element width × size for arrays of fixed
width, and the JSON length for other nested values. Exact for what it
measures; no sample, no cache, no private planner statistics.
"""

from __future__ import annotations

from pyspark.sql import functions as F

TARGET_PARTITION_BYTES = 128 * 1024 * 1024


def partition_advice(size_col, target_bytes: int = TARGET_PARTITION_BYTES):
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(size_col / F.lit(float(target_bytes))).cast("bigint"))
