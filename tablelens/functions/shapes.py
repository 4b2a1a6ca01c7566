"""Dates in text by shape.

A value's shape is its text with every digit as 9 and every run of letters as
``a``: ``03 Feb 1999`` has the shape ``99 a 9999``. The shape alone chooses the layout (one
map look-up, not a chain of patterns), which says where the fields stand; the fields
are cut out and checked by making a timestamp of them. Applied to distinct
values (the frequency pass) it runs once for each, whatever the rows.

Months are English names, whole or of three letters, in any case; years of two
digits are 1969 to 2068; hours before a.m. and p.m. are 1 to 12. What has no
known shape, or fields that aren't a date, gives NULL, as do NULLs. Shapes that the explicit
layouts of ``parsing`` cover are not repeated here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layouts. Fields: Y year, y year of two digits, N name of a month, M month, D day,
# h hour, m minute, s second, P am or pm, T itself. A field's digits are as many as its letters.
LAYOUTS = (
    "YYYYMMDD",
    "YYYYMMDDhhmmss",
    "YYYYMMDDThhmmss",
    "YYYYMMDD hh:mm:ss",
    "D N YYYY", "DD N YYYY", "D N YYYY hh:mm:ss", "DD N YYYY hh:mm:ss",
    "D N yy", "DD N yy", "D-N-YYYY", "DD-N-YYYY", "D-N-yy", "DD-N-yy",
    "N D, YYYY", "N DD, YYYY", "N D YYYY", "N DD YYYY", "N D, YYYY hh:mm:ss", "N DD, YYYY hh:mm:ss",
    "YYYY-N-DD", "YYYY N DD",
    "MM/DD/yy", "M/D/yy", "M/DD/yy", "MM/D/yy", "M/D/YYYY", "M/DD/YYYY", "MM/D/YYYY",
    "MM/DD/YYYY hh:mm P", "MM/DD/YYYY hh:mm:ss P", "M/D/YYYY h:mm P", "M/D/YYYY hh:mm P", "MM/DD/YYYY h:mm P",
    "YYYY-MM-DD hh:mm P", "YYYY-MM-DD hh:mm:ss P", "YYYY-MM-DD h:mm:ss P",
)
FIELDS = "YyNMDhmsPT"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def _cut(layout: str) -> tuple[str, dict[str, tuple[int, int, int]]]:
    """A layout's shape, and for each field (token, first character, characters): tokens
    are the runs of digits and of letters."""
    shape, places, token, kind, at = "", {}, -1, "", 0
    for i, c in enumerate(layout):
        now = "9" if c in "YyMDhms" else "a" if c in "NP" or c.isalpha() else ""
        if now and (now != kind or now == "a" and c != layout[i - 1]):
            token, at = token + 1, 0
        if c in FIELDS and now:
            first = places.setdefault(c, (token, at, 0))
            places[c] = (first[0], first[1], first[2] + 1)
        shape += now if now == "9" or (now == "a" and kind != "a") else "" if now else c
        kind, at = now, at + 1
    return shape, places


def shape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[A-Za-z]+", "a"), "[0-9]", "9")


def shaped_timestamp(c: Column) -> Column:
    """The timestamp_ntz that a text shows, by its shape."""
    text = F.trim(c)
    known = [_cut(layout) for layout in LAYOUTS]
    empty = F.array(*[F.lit(None).cast("int")] * 3)
    places = F.create_map(*[x for s, p in known for x in (
        F.lit(s), F.array(*[F.array(*[F.lit(v) for v in p[f]]) if f in p else empty for f in FIELDS]))])
    tokens = F.regexp_extract_all(text, F.lit("[0-9]+|[A-Za-z]+"), F.lit(0))
    # values longer than any layout with the longest names have no known shape
    at = F.when(F.length(text) <= 40, F.element_at(places, shape(text)))

    def field(f: str) -> Column:
        p = F.get(at, F.lit(FIELDS.index(f)))
        word = F.get(tokens, F.get(p, F.lit(0)))
        return word if f in "NPT" else F.substr(word, F.get(p, F.lit(1)) + 1, F.get(p, F.lit(2))).cast("int")

    name, half, hour, short = F.lower(field("N")), F.lower(field("P")), field("h"), field("y")
    by_name = F.coalesce(*[F.when(name.isin(m, m[:3]), k) for k, m in enumerate(MONTHS, 1)])
    year = F.coalesce(field("Y"), short + F.when(short < 69, 2000).otherwise(1900))
    hour = F.when(half.isNull(), F.coalesce(hour, F.lit(0))).when(
        half.isin("am", "pm") & hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0))
    year = F.when(F.coalesce(field("T"), F.lit("T")) == "T", year)
    return F.try_make_timestamp_ntz(year, F.coalesce(by_name, F.when(name.isNull(), field("M"))), field("D"), hour,
                                    F.coalesce(field("m"), F.lit(0)), F.coalesce(field("s"), F.lit(0)).cast("decimal(16,6)"))
