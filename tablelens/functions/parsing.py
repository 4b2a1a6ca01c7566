"""Typed views of text: numbers and dates hidden inside strings.

All parsing is built-in Spark expressions (regex gate + ``try_cast``), so it stays inside whole-stage codegen and gives the
same answer as any SQL engine that applies the same gate. The gate, not the
engine's cast, decides what counts as a number: engines disagree on inputs
such as ``1_000``, ``1d`` or ``12.5`` cast to an integer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The number grammar and the accepted date layouts.
# Plain ASCII digits with an optional sign and surrounding whitespace; no digit
# separators, no "nan"/"inf" words. An integer string is also a real.
INT_PATTERN = r"^\s*([+-]?[0-9]+)\s*$"
REAL_PATTERN = r"^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)\s*$"

# Date layouts: a date, optionally a time of day (minutes, seconds, up to six
# digits of a second), optionally a zone (Z or an offset). Dotted dates are
# day first; slashed ones month first, or day first by option.
TIME_PATTERN = r"([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?)"
ZONE_PATTERN = r" ?(Z|[+-][0-9]{2}:?[0-9]{2})$"
_REST = TIME_PATTERN + r"?$|" + TIME_PATTERN + ZONE_PATTERN
ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
# (date, its year, month and day as groups)
OTHER_DATES = (
    (r"^([0-9]{4})/([0-9]{2})/([0-9]{2})", (1, 2, 3)),
    (r"^([0-9]{2})/([0-9]{2})/([0-9]{4})", (3, 1, 2)),
    (r"^([0-9]{2})[.]([0-9]{2})[.]([0-9]{4})", (3, 2, 1)),
)
# ---------------------------------------------------------------------------


def _gated_cast(c: Column, pattern: str, to: str) -> Column:
    # Cast only what the gate matched: a failed cast is an exception inside
    # Spark, ~50x slower than the regex, so non-numbers never reach it.
    digits = F.regexp_extract(c, pattern, 1)
    return F.when(digits != "", digits.try_cast(to))


def parsed_int(c: Column) -> Column:
    """bigint if the whole string is an integer literal, else NULL."""
    return _gated_cast(c, INT_PATTERN, "bigint")


def parsed_real(c: Column) -> Column:
    """double if the whole string is a decimal/scientific literal, else NULL."""
    return _gated_cast(c, REAL_PATTERN, "double")


def is_real_text(c: Column) -> Column:
    return c.rlike(REAL_PATTERN)


def _layouts(day_first: bool):
    for date, order in OTHER_DATES:
        yield date, (3, 2, 1) if day_first and order == (3, 1, 2) else order


def parsed_timestamp(c: Column, day_first: bool = False) -> Column:
    """timestamp_ntz if the string has one of the accepted date layouts. No
    session zone takes part; a text with a zone gives the time in UTC."""
    # The date takes ten characters in each layout: what follows is read from c, and each
    # pattern runs once, those of zones only where there is one.
    zone = F.regexp_extract(c, TIME_PATTERN + ZONE_PATTERN, 4)
    digits = F.regexp_replace(zone, ":", "").cast("int")  # +0530 is 530
    shift = F.make_dt_interval(F.lit(0), F.lit(0), (digits / 100).cast("int") * 60 + digits % 100, F.lit(0))

    def time(iso: Column) -> Column:
        local = F.regexp_replace(iso, TIME_PATTERN + ZONE_PATTERN, "$1").try_cast("timestamp_ntz")
        after = F.substring(c, 11, 40)
        return F.when(~after.rlike("[Z+-]"), iso.try_cast("timestamp_ntz")).when(after.contains("Z"), local).otherwise(local - shift)

    out = F.when(c.rlike(f"{ISO_DATE}({_REST})"), time(c))
    for date, order in _layouts(day_first):
        out = out.when(c.rlike(f"{date}({_REST})"), time(F.regexp_replace(c, date, "-".join(f"${g}" for g in order))))
    # cheap prefilter: every layout starts with two digits
    return F.when(c.rlike(r"^[0-9]{2}"), out)


def report_ts(c: Column) -> Column:
    """A date or timestamp in the report's layout: yyyy-MM-dd HH:mm:ss and the
    fraction of the second if there is one, as timestamp_ntz prints it (so no
    session time zone takes part)."""
    return c.cast("timestamp_ntz").cast("string")


# SQL spellings of the same rules, for oracle queries and docs.
def sql_parsed_int(expr: str) -> str:
    return f"try_cast(regexp_extract({expr}, '{INT_PATTERN}', 1) AS BIGINT)"


def sql_parsed_real(expr: str) -> str:
    return f"try_cast(regexp_extract({expr}, '{REAL_PATTERN}', 1) AS DOUBLE)"


def sql_parsed_timestamp(expr: str, day_first: bool = False) -> str:
    cases = [f"WHEN regexp_matches({expr}, '{ISO_DATE}({_REST})') THEN {expr}"]
    for date, order in _layouts(day_first):
        cases.append(f"WHEN regexp_matches({expr}, '{date}({_REST})') THEN regexp_replace({expr}, '{date}', '" + "-".join(f"\\{g}" for g in order) + "')")
    iso = f"CASE {' '.join(cases)} END"
    zone = f"regexp_extract({iso}, '{TIME_PATTERN}{ZONE_PATTERN}', 4)"
    local = f"try_cast(regexp_replace({iso}, '{TIME_PATTERN}{ZONE_PATTERN}', '\\1') AS TIMESTAMP)"
    digits = f"regexp_replace({zone}, '[^0-9]', '', 'g')"
    minutes = f"(CAST(substr({digits}, 1, 2) AS INTEGER) * 60 + CAST(substr({digits}, 3, 2) AS INTEGER))"
    return (f"CASE WHEN {digits} <> '' THEN {local} - to_minutes(CASE WHEN starts_with({zone}, '-') "
            f"THEN -{minutes} ELSE {minutes} END) ELSE {local} END")
