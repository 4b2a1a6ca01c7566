"""Dates by shape against Python's own parser."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tablelens.functions import shapes

#: strptime's letters for the layouts' fields.
PYTHON = {"YYYY": "%Y", "yy": "%y", "N": "%b", "MM": "%m", "M": "%m", "DD": "%d", "D": "%d", "hh": "%H", "h": "%I", "mm": "%M", "ss": "%S", "P": "%p"}


def written(layout, t, name):
    """The layout with t's fields; one-letter fields need values of one digit."""
    twelve = "P" in layout
    hour = t.hour if not twelve else t.hour % 12 or 12
    out, i = "", 0
    while i < len(layout):
        j = i
        while j < len(layout) and layout[j] == layout[i] and layout[i] in shapes.FIELDS:
            j += 1
        field = layout[i:j] or layout[i]
        value = {"Y": t.year, "y": t.year % 100, "M": t.month, "D": t.day, "h": hour, "m": t.minute, "s": t.second}.get(field[0])
        if field[0] == "M" and "hh" not in field and i + 1 < len(layout) and layout[i - 1 : i] == ":":
            value = t.minute
        out += f"{value:0{len(field)}d}" if value is not None else name if field == "N" else ("PM" if t.hour >= 12 else "am") if field == "P" else field
        i = max(j, i + 1)
    return out


def test_every_layout(spark):
    rng, rows = random.Random(4), []
    for layout in shapes.LAYOUTS:
        for _ in range(20):
            t = dt.datetime(rng.randrange(1969, 2069), rng.randrange(1, 13), rng.randrange(1, 29), rng.randrange(24), rng.randrange(60), rng.randrange(60))
            fields = shapes._cut(layout)[1]
            if fields.get("M", (0, 0, 2))[2] == 1:
                t = t.replace(month=rng.randrange(1, 10))
            if fields["D"][2] == 1:
                t = t.replace(day=rng.randrange(1, 10))
            if fields.get("h", (0, 0, 2))[2] == 1:
                t = t.replace(hour=rng.choice([1, 5, 9, 13, 21]))
            full = shapes.MONTHS[t.month - 1]
            name = rng.choice([full, full.title(), full[:3].upper(), full[:3].title()])
            want = t.replace(hour=t.hour if "h" in fields else 0, minute=t.minute if "m" in fields else 0, second=t.second if "s" in fields else 0)
            rows.append((written(layout, t, name), want))
    df = spark.createDataFrame(rows, "v string, want timestamp_ntz")
    bad = df.withColumn("got", shapes.shaped_timestamp(F.col("v"))).where("NOT got <=> want").limit(5).collect()
    assert not bad


def test_what_is_no_date(spark):
    texts = [None, "", "20231301", "20230230", "31 Foo 2020", "99 Jan 2020", "12345678901234567", "01/02/2020 13:05 PM", "01/02/2020 00:05 AM", "20200101Q101010",
             "Janu 5, 2020", "x" * 100_000, "9" * 50, "１２ Jan 2020", "5 May", "2020-Feb-30"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    assert df.select(shapes.shaped_timestamp(F.col("v")).alias("t")).where("t IS NOT NULL").count() == 0


def test_shapes_are_different():
    found = [shapes._cut(layout)[0] for layout in shapes.LAYOUTS]
    assert len(set(found)) == len(found)
