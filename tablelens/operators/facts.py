"""Per-column facts derived from the typed frequency table.

When a profile builds the frequency table anyway (distinct counts, top
values), every scalar fact is a weighted aggregate over it: counts are sums
of ``cnt``, min/max are plain, means are Σcnt·x / Σcnt, and the central
moments (stddev, skewness) come from a second, exact two-pass aggregate over
the same small table with each column's mean broadcast back (one row per
column). So a full profile is ONE scan and ONE shuffle of the data, and
numbers and dates hidden in text are parsed once per distinct value instead
of once per row.

Output schema: scalars.SCALAR_SCHEMA plus unique_values, avg_distinct_length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsing import is_real_text, parsed_int, parsed_real, parsed_timestamp, report_ts
from ..functions.types import dtype_class, fixed_width, literal_rows
from .frequency import _render_kind, present
from .scalars import INTEGER, REAL, SCALAR_SCHEMA, _kind

FACTS_SCHEMA = T.StructType(
    list(SCALAR_SCHEMA.fields)
    + [T.StructField("unique_values", T.LongType()), T.StructField("avg_distinct_length", T.DoubleType())]
)


def _lookup(values: list, dt: str) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(dt) for v in values]), F.col("ordinal") + 1)


def _weighted(cond: Column) -> Column:
    return F.sum(F.when(cond, F.col("cnt")))


def frequency_facts(typed: DataFrame, df: DataFrame, sections: bool = True,
                    class_mode: str = "semantic") -> DataFrame:
    spark = df.sparkSession
    fields = list(df.schema.fields)
    kinds = [_kind(f.dataType) for f in fields]
    rkinds = [_render_kind(f.dataType) for f in fields]
    kind, rk = _lookup(kinds, "string"), _lookup(rkinds, "string")
    # bytes of a non-fixed-width, non-text value, from its canonical text
    elem = [fixed_width(f.dataType.elementType) if isinstance(f.dataType, T.ArrayType) else None for f in fields]
    ew = _lookup(elem, "int")
    other_bytes = (F.when(ew.isNotNull(), F.json_array_length(F.col("s")) * ew)
                   .when(rk == "text", F.octet_length(F.col("s"))))
    binary = [isinstance(f.dataType, T.BinaryType) for f in fields]
    other_bytes = F.when(_lookup(binary, "boolean"), F.length(F.col("s")) / 2).otherwise(other_bytes)
    # the scale of decimal columns: their extremes are taken over decimals of that scale
    scales = [f.dataType.scale if isinstance(f.dataType, T.DecimalType) else None for f in fields]
    l, d, s, cnt = F.col("l"), F.col("d"), F.col("s"), F.col("cnt")
    w = cnt.cast("double")

    # the value as a number / timestamp / text, by column kind
    x = (F.when(kind == "int", l.cast("double"))
         .when(kind == "float", d)
         .when(kind == "real", s.cast("double")))
    native_t = (F.when(rk == "date", F.date_from_unix_date(l.cast("int")).cast("timestamp_ntz"))
                .when(rk == "ts", F.timestamp_micros(l).cast("timestamp_ntz"))
                .when(rk == "ntz", F.col("t")))
    text = F.when(kind == "string", s)
    pr, pi = parsed_real(text), parsed_int(text)
    t = F.coalesce(native_t, parsed_timestamp(text)) if sections else native_t

    base = typed.select(
        "ordinal", "cnt", present().alias("nn"), x.alias("x"), F.when(kind == "int", l).alias("xl"),
        text.alias("text"), pr.alias("pr"), pi.alias("pi"), t.alias("t"),
        F.when(kind.isin("float", "real") & F.isnan(x), True).alias("nan"),
        F.when(kind == "other", other_bytes).alias("ob"),
        *[F.when(_lookup(scales, "int") == k, s.cast(T.DecimalType(38, k))).alias(f"dec{k}")
          for k in sorted({k for k in scales if k is not None})],
    )
    X, XL, TX, PR, PI, TT = (F.col(c) for c in ("x", "xl", "text", "pr", "pi", "t"))
    nn = F.col("nn")

    def stats1(v: Column, p: str, exact: list[Column] = ()) -> list[Column]:
        # min/max as text: of the exact forms (bigint, decimals: fixed-size
        # buffers, so the aggregate hashes), else the double's text
        forms = [*exact, v]
        mn, mx = (F.coalesce(*[f(e).cast("string") for e in forms]) for f in (F.min, F.max))
        return [_weighted(v.isNotNull()).alias(f"{p}_count"), mn.alias(f"{p}_min"), mx.alias(f"{p}_max"),
                F.sum(v * w).alias(f"{p}_s1")]

    aggs = [
        F.sum(cnt).alias("n"),
        _weighted(nn).alias("non_null"),
        F.count(F.when(nn, 1)).alias("unique_values"),
        F.avg(F.when(nn, F.length(TX))).alias("avg_distinct_length"),
        _weighted(F.col("nan")).alias("nan_count"),
        _weighted(X == 0).alias("zero_count"),
        _weighted(TX == "").alias("empty_count"),
        F.max(F.length(TX)).alias("max_length"),
        F.sum(F.length(TX) * cnt).alias("len_sum"),
        _weighted(is_real_text(TX)).alias("numeric_text_count"),
        F.sum(F.octet_length(TX) * cnt).alias("text_bytes"),
        F.sum(F.col("ob") * cnt).alias("other_bytes"),
        *stats1(X, "num", [XL, *[F.col(c) for c in base.columns if c.startswith("dec")]]),
    ]
    if sections:
        aggs += [
            _weighted(TT.isNotNull()).alias("dt_count"),
            report_ts(F.min(TT)).alias("dt_min"),
            report_ts(F.max(TT)).alias("dt_max"),
            *stats1(PR, "pr"),
            *stats1(PI.cast("double"), "pi", [PI]),
        ]
    first = base.groupBy("ordinal").agg(*aggs)

    means = [(p, F.try_divide(F.col(f"{p}_s1"), F.col(f"{p}_count").cast("double")).alias(f"{p}_mean"))
             for p in (("num", "pr", "pi") if sections else ("num",))]
    first = first.select("*", *[m for _, m in means])
    if sections:
        # second pass over the (small) frequency table: exact central moments
        centre = F.broadcast(first.select("ordinal", *[f"{p}_mean" for p, _ in means]))  # one row per column
        dev = {p: (v - F.col(f"{p}_mean")) for p, v in (("num", X), ("pr", PR), ("pi", PI.cast("double")))}
        second = base.join(centre, "ordinal").groupBy("ordinal").agg(
            F.sum(dev["num"] * dev["num"] * w).alias("num_m2"),
            F.sum(dev["num"] * dev["num"] * dev["num"] * w).alias("num_m3"),
            F.sum(dev["pr"] * dev["pr"] * w).alias("pr_m2"),
            F.sum(dev["pi"] * dev["pi"] * w).alias("pi_m2"),
        )
        first = first.join(F.broadcast(second), "ordinal", "left")  # one row per column

    meta = literal_rows(
        spark,
        [(i, f.name, f.dataType.simpleString(), dtype_class(f.dataType, class_mode), kinds[i],
          fixed_width(f.dataType), rkinds[i]) for i, f in enumerate(fields)],
        "ordinal int, column_name string, dtype string, dclass string, kind string, width int, rkind string",
    )
    j = meta.join(F.broadcast(first), "ordinal", "left")  # both sides: one row per column
    k = F.col("kind")
    numeric = k.isin("int", "real", "float")
    is_text = k == "string"

    def std(p: str) -> Column:
        n = F.col(f"{p}_count").cast("double")
        return F.when(n > 1, F.sqrt(F.greatest(F.col(f"{p}_m2"), F.lit(0.0)) / (n - 1)))

    def z(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0)).cast("bigint")

    def as_typed(c: str) -> Column:
        # a float's extremes read as the float prints, not as its double
        return F.when(F.col("rkind") == "float", F.col(c).cast("double").cast("float").cast("string")).otherwise(F.col(c))

    value_bytes = (F.when(F.col("width").isNotNull(), F.col("width").cast("bigint") * z("non_null"))
                   .when(is_text, z("text_bytes"))
                   .otherwise(z("other_bytes")))
    out: dict[str, Column] = {
        "ordinal": F.col("ordinal"), "column_name": F.col("column_name"), "dtype": F.col("dtype"),
        "dclass": F.col("dclass"),
        "n": z("n"), "non_null": z("non_null"),
        "nan_count": F.when(k == "float", z("nan_count")),
        "zero_count": F.when(numeric, z("zero_count")),
        "empty_count": F.when(is_text, z("empty_count")),
        "max_length": F.when(is_text, F.col("max_length")),
        "avg_length": F.when(is_text, F.try_divide(F.col("len_sum").cast("double"), F.col("non_null"))),
        "numeric_text_count": F.when(is_text, z("numeric_text_count")),
        "value_bytes": value_bytes,
        "unique_values": z("unique_values"),
        "avg_distinct_length": F.when(is_text, F.col("avg_distinct_length")),
    }
    if sections:
        n_num = F.col("num_count").cast("double")
        out.update({
            "skewness": F.when(numeric & (n_num > 0) & (F.col("num_m2") != 0),
                               F.sqrt(n_num) * F.col("num_m3") / F.pow(F.col("num_m2"), 1.5)),
            "num_type": F.when(numeric, F.when(k == "int", F.lit(INTEGER)).otherwise(F.lit(REAL))),
            "num_count": F.when(numeric, z("num_count")),
            "num_min": F.when(numeric, as_typed("num_min")), "num_max": F.when(numeric, as_typed("num_max")),
            "num_mean": F.when(numeric, F.col("num_mean")), "num_std": F.when(numeric, std("num")),
            "text_count": F.when(is_text, z("non_null")),
            "dt_origin": F.when(k == "datetime", F.lit("native")).when(is_text, F.lit("parsed")),
            "dt_count": F.when(k.isin("datetime", "string"), z("dt_count")),
            "dt_min": F.col("dt_min"), "dt_max": F.col("dt_max"),
        })
        for p in ("pr", "pi"):
            out.update({
                f"{p}_count": F.when(is_text, z(f"{p}_count")),
                f"{p}_min": F.col(f"{p}_min"), f"{p}_max": F.col(f"{p}_max"),
                f"{p}_mean": F.col(f"{p}_mean"), f"{p}_std": std(p),
            })
    return j.select(*[
        (out[f.name] if f.name in out else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in FACTS_SCHEMA.fields
    ])
