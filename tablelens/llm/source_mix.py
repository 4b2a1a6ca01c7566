"""Mixing sources to target weights (operator 13): Pareto order sampling.

1. Sizes. One scan gives each document its size, its source and two numbers
   drawn by hash from the key and the text, so reruns agree.
2. Targets. Sources in order share all sizes by their weights; a target stops at
   MOST times its source's size and what is above is shared again by weight, until
   none is above: the level of that filling is found by a few sums over the
   sources (one row each).
3. Whole copies. A document is expected to be taken target / source size times
   (by its own weight too, where documents have one); the whole part of
   that is certain.
4. Pareto order. The rest is a chance for one copy more. In each source documents
   are ranked by the odds of the random number over the odds of that
   chance, and are taken in that order up to a fixed size: the words that the
   whole copies leave. The first document that doesn't fit is found by
   histograms of the order, each within the bucket of the one before, so no
   task sorts a source.
5. Fill. The words that are left there go to the next FILL documents in order
   that still fit, and at last to one that brings the sum nearer to the target
   than leaving them.

Null texts have size 0. A null source is a source of its own, the last in order.
Documents of size 0 take no words. Rows that repeat are documents of their own;
of equal ones any may be the one that is taken (the rows of the result are the
same). Texts of any length count in full. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.checkpoint import scratch_table
from .common import named, quoted, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, again and again.
WEIGHTS = (5, 2, 1)
#: A document is taken so many times at most.
MOST = 3
SEED = "mix"
#: Bits of each of the two numbers that order a source, and of a bucket of their histogram.
BITS, STEP = 50, 10
#: A source's rows that are ordered at once, in the last bucket.
BLOCK = 10_000
#: Documents in order that are tried for the words that are left.
FILL = 1000
#: Tables of up to this number of rows are sent to all tasks (some 100 bytes each); larger ones are joined.
FEW = 100_000


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(FEW + 1).count() <= FEW else table


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None, carry: bool = False) -> DataFrame:
    """(k, s, size, u, v, w, r) of every row: u in (0, 1) and v order, r numbers the
    rows; with `carry` also `row`, all columns of docs."""
    t, k = text_or_empty(text), named(docs, key)
    h = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(k.cast("string"), F.lit("")), F.lit(":"), F.md5(t.cast("binary"))).cast("binary"))
    number = lambda start: F.conv(F.substring(h, start, 13), 16, 10).cast("long")  # noqa: E731 (52 bits)
    w = F.greatest(F.coalesce(named(docs, weight).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight else F.lit(1.0)
    rows = docs.select(
        k.alias("k"), named(docs, source).cast("string").alias("s"), F.regexp_count(t, F.lit(WORD)).cast("long").alias("size"),
        ((number(1) + 0.5) / F.lit(float(1 << 52))).alias("u"), F.shiftright(number(14), 52 - BITS).alias("v"), w.alias("w"),
        F.monotonically_increasing_id().alias("r"), *([F.struct(*[named(docs, c) for c in docs.columns]).alias("row")] if carry else []),
    )
    return scratch_table(rows, "sized")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(s, source_size, target) of each source."""
    sums = rows.groupBy("s").agg(F.sum("size").alias("source_size"))
    dealt = sums.repartitionByRange(F.asc_nulls_last("s")).withColumn("p", F.spark_partition_id())
    dealt = scratch_table(dealt, "sources")  # part p has the sources after those of part p - 1
    here = F.row_number().over(Window.partitionBy("p").orderBy(F.asc_nulls_last("s"))) - 1
    part = dealt.groupBy("p").agg(F.count("*").alias("c"))  # a row for each partition of the shuffle
    before = part.withColumn("before", F.sum("c").over(Window.orderBy("p")) - F.col("c")).drop("c")
    place = (F.col("before") + F.col("here")) % len(weights)
    weighed = dealt.withColumn("here", here).join(F.broadcast(before), "p")
    weighed = scratch_table(weighed.select("s", "source_size", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).alias("weight")), "weighed")
    most = MOST * F.col("source_size")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:  # sources that are full stay full: the level rises
        above = most < level * F.col("weight")
        got = weighed.agg(F.sum(F.when(above, most)).alias("m"), F.count(F.when(above, 1)).alias("c"), F.sum(F.when(~above, F.col("weight"))).alias("w")).first()
        if got["c"] == full or not got["w"]:
            break
        full, level = got["c"], (total - (got["m"] or 0)) / got["w"]
    return weighed.select("s", "source_size", F.least(most.cast("double"), level * F.col("weight")).alias("target"))


def _copies(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with source_size, target and `expected` copies: those of a source are in
    proportion to the documents' weights, MOST at most."""
    level = sources.withColumn("level", F.try_divide("target", F.col("source_size").cast("double")))
    plain = rows.filter("w <> 1").isEmpty()
    while not plain:
        joined = _by_source(rows, level).withColumn("full", F.col("level") * F.col("w") >= MOST)
        sums = joined.groupBy("s").agg(
            F.sum(F.when(F.col("full"), MOST * F.col("size")).otherwise(0)).alias("held"),
            F.sum(F.when(~F.col("full"), F.col("w") * F.col("size")).otherwise(0.0)).alias("rest"),
        )
        new = F.coalesce(F.greatest(F.try_divide(F.col("target") - F.col("held"), F.col("rest")), "level"), F.col("level"))
        before, level = level, scratch_table(level.join(sums, level["s"].eqNullSafe(sums["s"])).select(level["s"], "source_size", "target", new.alias("level")), "level")
        # the level rises until no more documents are full
        moved = level.join(before.select(F.col("s").alias("b"), F.col("level").alias("old")), F.col("s").eqNullSafe(F.col("b"))).filter("level > old * (1 + 1e-9)")
        plain = moved.isEmpty()
    expected = F.least(F.coalesce(F.col("level") * F.col("w"), F.lit(0.0)), F.lit(float(MOST)))
    return _by_source(rows, level).withColumn("expected", expected)


def _by_source(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """rows with the columns of their source in a table that has a row for each. Beyond
    FEW sources both sides are salted, as one source may hold a third of all rows."""
    other = table.withColumnRenamed("s", "s_")
    if table.limit(FEW + 1).count() <= FEW:
        return rows.join(F.broadcast(other), F.col("s").eqNullSafe(F.col("s_")), how).drop("s_")
    salted = other.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumn("s_", F.struct("s_", "salt_")).drop("salt_")
    salt = F.struct(F.col("s").alias("s_"), F.pmod("r", F.lit(16)).cast("int").alias("salt_"))
    return rows.join(salted, salt.eqNullSafe(F.col("s_")), how).drop("s_")


def _digit(level: int) -> Column:
    """The level-th bucket number of a row's place, from the top: place, v, then r."""
    per = BITS // STEP
    column, at = ("place", level) if level < per else ("v", level - per) if level < 2 * per else ("r", level - 2 * per)
    bits = BITS if level < 2 * per else 60
    return F.shiftright(F.col(column), bits - STEP * (at + 1)).bitwiseAND(F.lit((1 << STEP) - 1) if level != 2 * per else F.lit(-1))


ORDER = ("place", "v", "r")


def _crossing(ranked: DataFrame, need: DataFrame) -> DataFrame:
    """ranked (s, size, place, v, r), need (s, need): for each source (s, place, v,
    r, gap) of the first row in order that doesn't fit, and the words left before it.
    Sources whose rows all fit have nulls there."""
    open_, left, level = ranked, need, 0
    while True:
        digit = _digit(level)
        hist = open_.withColumn("digit", digit).groupBy("s", "digit").agg(F.sum("size").alias("words"), F.count("*").alias("held"))
        upto = F.sum("words").over(Window.partitionBy("s").orderBy("digit"))  # at most 1024 rows a source
        hist = _by_source(hist.withColumn("upto", upto).withColumn("r", F.lit(0).cast("long")), left).filter("upto > need")
        hit = hist.groupBy("s").agg(F.min(F.struct("digit", F.expr("need - (upto - words)").alias("need"), "held")).alias("hit"))
        hit = scratch_table(hit.select("s", "hit.*"), "hit")
        inside = _by_source(open_.withColumn("here", digit), hit.select("s", "digit", "need")).filter("here = digit")
        level += 1
        if (hit.agg(F.max("held")).first()[0] or 0) <= BLOCK or level == 2 * BITS // STEP + 6:
            break
        open_, left = scratch_table(inside.select("s", "size", *ORDER), "open"), hit.select("s", "need")
    upto = F.sum("size").over(Window.partitionBy("s").orderBy(*ORDER))
    over = inside.withColumn("upto", upto).filter("upto > need").groupBy("s").agg(F.min(F.struct(*ORDER, (F.col("need") - F.col("upto") + F.col("size")).alias("gap"))).alias("at"))
    over = over.select(F.col("s").alias("s_"), "at.*")
    total = ranked.groupBy("s").agg(F.sum("size").alias("words"))
    rest = need.join(total.withColumnRenamed("s", "t_"), F.col("s").eqNullSafe(F.col("t_")), "left").join(over, F.col("s").eqNullSafe(F.col("s_")), "left")
    return scratch_table(rest.select("s", *[F.col(c) for c in ORDER], F.coalesce("gap", F.col("need") - F.coalesce("words", F.lit(0))).alias("gap")), "crossing")


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """rows (`sized`) with source_size, target and copies: how often the mix takes each."""
    rows = _copies(rows, targets(rows, weights))
    chance = F.col("expected") - F.floor("expected")
    odds = F.col("u") / (1 - F.col("u")) / (chance / (1 - chance))
    place = F.floor(odds / (1 + odds) * F.lit(float(1 << BITS)))
    whole = F.floor("expected").cast("long")
    rows = scratch_table(rows.withColumn("whole", whole).withColumn("place", F.when(chance > 0, F.least(place, F.lit((1 << BITS) - 1)))), "placed")
    need = rows.groupBy("s").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("need"))
    need = scratch_table(need, "need")
    ranked = rows.filter("place IS NOT NULL").select("s", "size", *ORDER)
    at = _crossing(ranked, need)
    ends = at.select("s", F.struct(*ORDER).alias("end"), "gap")
    after = _by_source(ranked.withColumn("at", F.struct(*ORDER)), ends).filter("at >= end")
    # the next documents that fit, in order
    fits = after.filter("size > 0 AND size <= gap").withColumn("n", F.row_number().over(Window.partitionBy("s").orderBy(*ORDER))).filter(f"n <= {FILL}")
    held = fits.groupBy("s").agg(F.first("gap").alias("gap"), F.array_sort(F.collect_list(F.struct(*ORDER, "size"))).alias("docs"))
    start = F.struct(F.col("gap").alias("gap"), F.array().cast("array<bigint>").alias("taken"))
    take = lambda held, x: F.when(
        x["size"] <= held["gap"], F.struct((held["gap"] - x["size"]).alias("gap"), F.concat(held["taken"], F.array(x["r"])).alias("taken"))
    ).otherwise(held)
    filled = scratch_table(held.select("s", F.aggregate("docs", start, take).alias("x")).select("s", F.col("x.gap").alias("left"), "x.taken"), "filled")
    # the last place: a document that is too large, but nearer than nothing
    left = ends.join(filled.withColumnRenamed("s", "s_"), F.col("s").eqNullSafe(F.col("s_")), "left").select("s", "end", F.coalesce("left", "gap").alias("left"), F.coalesce("taken", F.array().cast("array<bigint>")).alias("taken"))
    last = _by_source(ranked.withColumn("at", F.struct(*ORDER)), left).filter("at >= end AND size > left AND size - left < left AND NOT array_contains(taken, r)")
    last = last.groupBy("s").agg(F.min(F.struct("size", *ORDER)).alias("x")).select(F.col("x.r").alias("r"))
    more = _small(scratch_table(filled.select(F.explode("taken").alias("r")).union(last).withColumn("more", F.lit(True)), "more"))
    out = _by_source(rows, at.select("s", F.struct(*ORDER).alias("end"), F.col("place").isNull().alias("all")))
    before = F.col("place").isNotNull() & (F.col("all") | (F.struct(*ORDER) < F.col("end")))
    out = out.join(more, "r", "left")
    return out.withColumn("copies", F.col("whole") + (before | F.coalesce("more", F.lit(False))).cast("long")).drop("end", "all", "more", "place", "expected", "whole")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken."""
    taken = plan(sized(docs, key, text, source, weight, carry=True), weights).filter("copies > 0")
    each = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("n"))
    return each.select(*[F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns])


def shares(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """key, size, source_size, target and taken of every row."""
    found = plan(sized(docs, key, text, source, weight), weights)
    return found.select(F.col("k").alias(key), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
