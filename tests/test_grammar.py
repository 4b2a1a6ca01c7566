"""Property test: the number grammar gives exactly the values a plain
reading of the regex gives (Python int/float on the captured text), so the
gate, not the engine's cast, decides what counts as a number."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablelens.functions.parsing import INT_PATTERN, REAL_PATTERN, parsed_int, parsed_real

TEXT = st.text(alphabet=" \t+-0123456789.eE_xd", max_size=10)


def expected_int(s):
    m = re.fullmatch(INT_PATTERN.strip("^$"), s)
    if not m:
        return None
    v = int(m.group(1))
    return v if -(2 ** 63) <= v < 2 ** 63 else None


def expected_real(s):
    m = re.fullmatch(REAL_PATTERN.strip("^$"), s)
    return float(m.group(1)) if m else None


@settings(max_examples=5, deadline=None)
@given(st.lists(TEXT, min_size=50, max_size=200))
def test_gated_casts_follow_the_grammar(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = df.select("s", parsed_int(F.col("s")).alias("i"), parsed_real(F.col("s")).alias("r")).collect()
    for row in got:
        assert row["i"] == expected_int(row["s"]), row
        r = expected_real(row["s"])
        assert row["r"] == r or (r is not None and row["r"] is not None and abs(row["r"] - r) <= 1e-12 * abs(r)), row
