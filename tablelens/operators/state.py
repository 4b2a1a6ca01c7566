"""Profile states that merge: what a column's profile needs to be brought up to
date by new rows without reading the old ones.

A state is one row per column, of bounded size whatever the number of rows:

* counts, lengths, extremes; mean and second and third central moments, merged
  by the parallel formulas;
* a HyperLogLog sketch of the values (distinct count, relative error
  ``DISTINCT_ERROR`` at one standard error);
* a KLL sketch of the numbers (quantiles and ranks, rank error ``RANK_ERROR``);
* a heavy-hitter summary of the values' text (``approx_top_k``): of N values no
  count is off by more than ``N * TOP_ERROR``, so every value more frequent than that is found.

``column_states`` makes the states of a table in one scan, without a shuffle of
values: each task sends a row per column. ``merge_states`` makes one of many, of the
parts of a table, the files of a folder or the batches of a stream. ``finish``
reads the facts off. NULL counts as missing; numbers that aren't finite are
left out of the number statistics and counted in ``not_finite``. Values of more
than ``ITEM`` characters are known to the heavy-hitter summary by their
first ones and a digest, so its size is bounded, too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import canonical
from ..functions.types import is_numeric, is_string
from .frequency import COLUMN_BLOCK, to_slot
from .scalars import col_ref

#: Sizes of the sketches, and their errors.
HLL_LOG, KLL_K, TRACKED = 14, 400, 4000
DISTINCT_ERROR, RANK_ERROR = 0.0082, 0.01
#: The summary's map has a power of two of places, of which 3/4 are tracked.
TOP_ERROR = 3.5 / 8192
#: Characters of a value in the heavy-hitter summary.
ITEM = 128


def column_states(df: DataFrame, part: Column | None = None) -> DataFrame:
    """The state of each column of a table: one scan; by ``part``, that of each column
    of each part of the rows, in the same scan."""
    recs, of = [], [] if part is None else ["part"]
    for i, f in enumerate(df.schema.fields):
        c = col_ref(f.name)
        text = canonical(c, f.dataType)
        number = c.cast("double") if is_numeric(f.dataType) else F.lit(None).cast("double")
        finite = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
        slot = to_slot(c, f.dataType)
        # -0.0 and 0.0 are one value
        slot = slot + F.lit(0.0) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else slot
        item = F.when(F.length(text) <= ITEM, text).otherwise(F.concat(F.left(text, F.lit(ITEM - 65)), F.lit("#"), F.sha2(text.cast("binary"), 256)))
        recs.append(F.struct(
            F.lit(i).alias("ordinal"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("dtype"),
            F.when(c.isNotNull(), F.xxhash64(slot)).alias("h"), finite.alias("x"), F.when(number.isNotNull() & finite.isNull(), True).alias("odd"),
            item.alias("item"), (F.length(c) if is_string(f.dataType) else F.lit(None)).cast("bigint").alias("len"),
        ))
    if not recs:
        raise ValueError("a table without columns has no state")
    blocks = []
    for start in range(0, len(recs), COLUMN_BLOCK):
        block = recs[start : start + COLUMN_BLOCK]
        slots = [f"c{k}" for k in range(len(block))]
        long = df.select(*[r.alias(c) for r, c in zip(block, slots)], *[part.alias(p) for p in of]).unpivot(of, slots, "slot", "v").select(*of, "v.*")
        n = F.count("x")
        blocks.append(long.groupBy(*of, "ordinal", "column_name", "dtype").agg(
            F.count(F.lit(1)).alias("n"), F.count("h").alias("non_null"), F.count("odd").alias("not_finite"),
            F.max("len").alias("max_length"), F.sum("len").alias("len_sum"),
            n.alias("numbers"), F.avg("x").alias("mean"), F.min("x").alias("low"), F.max("x").alias("high"),
            (F.var_pop("x") * n).alias("m2"),
            F.coalesce(F.nanvl(F.skewness("x"), F.lit(0.0)), F.lit(0.0)).alias("skew"),
            F.hll_sketch_agg("h", HLL_LOG).alias("distinct"),
            F.expr(f"kll_sketch_agg_double(x, {KLL_K})").alias("ranks"),
            F.expr(f"approx_top_k_accumulate(item, {TRACKED}) FILTER (WHERE item IS NOT NULL)").alias("top"),
        ))
    states = reduce(DataFrame.unionByName, blocks)
    m3 = F.col("skew") * F.pow("m2", F.lit(1.5)) / F.sqrt("numbers")
    return states.withColumn("m3", F.when(F.col("numbers") > 0, m3)).drop("skew", *of)


def merge_states(states: DataFrame) -> DataFrame:
    """One state per column of any number of states."""
    of_column = Window.partitionBy("ordinal", "column_name", "dtype")
    w = F.col("numbers")
    centre = F.try_divide(F.sum(w * F.col("mean")).over(of_column), F.sum(w).over(of_column).cast("double"))
    held = states.withColumn("centre", centre).withColumn("d", F.col("mean") - F.col("centre"))
    d = F.col("d")
    return held.groupBy("ordinal", "column_name", "dtype").agg(
        *[F.sum(c).alias(c) for c in ("n", "non_null", "not_finite")],
        F.max("max_length").alias("max_length"), F.sum("len_sum").alias("len_sum"),
        F.sum("numbers").alias("numbers"), F.first("centre", ignorenulls=True).alias("mean"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.sum(F.col("m2") + w * d * d).alias("m2"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.expr("kll_merge_agg_double(ranks)").alias("ranks"),
        F.expr(f"approx_top_k_combine(top, {TRACKED})").alias("top"),
        F.sum(F.col("m3") + 3 * d * F.col("m2") + w * d * d * d).alias("m3"),
    )


def finish(states: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75), k: int = 5) -> DataFrame:
    """The facts of each column's state: counts, distinct count, number
    statistics, quantiles and the k most frequent values with their counts
    (ties by value)."""
    some = F.col("numbers") > 0
    asked = "array(" + ", ".join(f"{float(x)}D" for x in quantiles) + ")"
    top = F.transform(F.expr(f"approx_top_k_estimate(top, {max(4 * k, 20)})"), lambda t: F.struct((-t["count"]).alias("c"), t["item"].alias("item")))
    return states.select(
        "ordinal", "column_name", "dtype", F.col("n").alias("record_count"), F.col("non_null").alias("number_non_empty_cells"),
        (F.col("n") - F.col("non_null")).alias("number_empty_cells"),
        F.hll_sketch_estimate("distinct").alias("unique_values"),
        "not_finite", "max_length", F.try_divide(F.col("len_sum").cast("double"), F.col("non_null")).alias("average_length"),
        F.when(some, F.col("mean")).alias("mean"), F.col("low").alias("min_value"), F.col("high").alias("max_value"),
        F.when(F.col("numbers") > 1, F.sqrt(F.greatest("m2", F.lit(0.0)) / (F.col("numbers") - 1))).alias("stddev"),
        F.when(some & (F.col("m2") > 0), F.sqrt(F.col("numbers").cast("double")) * F.col("m3") / F.pow("m2", F.lit(1.5))).alias("skewness"),
        F.when(some, F.expr(f"kll_sketch_get_quantile_double(ranks, {asked})")).alias("quantiles"),
        F.expr(asked).alias("quantiles_of"),
        F.transform(F.slice(F.array_sort(top), 1, k), lambda t: F.struct(t["item"].alias("value"), (-t["c"]).alias("count"))).alias("top_values"),
        F.ceil(F.col("non_null") * TOP_ERROR).cast("bigint").alias("top_error"),
    )


def equal_depth(states: DataFrame, buckets: int = 10) -> DataFrame:
    """Bounds of equal-depth buckets of each number column: (ordinal, column_name,
    bucket, low, high, depth), every bucket with the same share of the
    numbers within RANK_ERROR at either end. No second scan."""
    bounds = "array(" + ", ".join(f"{i / buckets}D" for i in range(buckets + 1)) + ")"
    held = states.where("numbers > 0").select("ordinal", "column_name", "numbers", F.expr(f"kll_sketch_get_quantile_double(ranks, {bounds})").alias("b"))
    each = held.select("ordinal", "column_name", "numbers", "b", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    return each.select("ordinal", "column_name", "bucket", F.expr("b[bucket]").alias("low"), F.expr("b[bucket + 1]").alias("high"), (F.col("numbers") / buckets).alias("depth"))
