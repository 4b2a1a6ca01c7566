"""Audit of how filters interact (operator 11): exact constrained least squares.

Five filters look at every text. What they remove together depends on their
order, and a fair share for each is its Shapley value. Both need no more than
how many documents fail each set of filters:

1. Cells. One scan gives each document the mask of the filters it fails. The
   copies' filter needs the first of equal texts: a rank by the digest of the
   text, of which each task passes on its own first rows only. Documents are
   counted by (part, mask) with their labels: at most 32 rows a part, whatever
   the size of the table.
2. Coalitions. removed(S) for all 32 sets S of filters: the documents whose mask
   meets S. The step at which a filter follows the set S removes
   removed(S + filter) - removed(S), so 32 numbers give all 120 orders.
3. Shapley values. They are the additive game nearest to `removed` under the
   Shapley kernel's weights, among those that share out removed(all) exactly.
   The normal equations with that constraint are solved in rational numbers,
   so the shares are exact and 120 times a share is the number of documents that
   the filter removes, summed over all orders.

A null text counts as empty, a null part as the empty string. An empty text
has no words, fails A and, where an earlier document is empty too, E. Rows
without a key are nobody's copy and make nobody a copy; rows that repeat a key
and a text count one by one and aren't copies of one another. Labels of the
same key are taken together: good, or toxic, if any of them says so. Words in
texts of any length are all counted. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from fractions import Fraction
from math import comb

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.checkpoint import scratch_table
from .common import map_arrow, named, ship, text_or_empty

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
#: The copies' filter; the others look at a text alone.
COPY = 1 << FILTERS.index("E")
CAPITALS, SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_mask(t: bytes, chars: int) -> int:
    """The filters A to D that a text (in UTF-8) fails, as bits. Bytes are split at
    the six white space characters of ASCII, no others."""
    words = t.split()
    fails = (
        len(words) < 100,
        100 * len(set(words)) < 80 * len(words),
        100 * (len(t) - len(t.translate(None, CAPITALS))) > 10 * chars,
        len(t) != len(t.translate(None, SIGNS)),
    )
    return sum(f << i for i, f in enumerate(fails))


def masks(texts: pa.Array) -> pa.Array:
    chars = pc.utf8_length(texts)
    return pa.array(list(map(text_mask, texts.cast(pa.binary()).to_pylist(), chars.to_pylist())), pa.int32())


def cells(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters they fail."""
    t = text_or_empty(text)
    ship(docs.sparkSession)
    slim = docs.select(
        named(docs, key).alias("k"),
        F.coalesce(named(docs, part).cast("string"), F.lit("")).alias("part"),
        F.arrow_udf(masks, "int")(t).alias("mask"),
        F.unhex(F.sha2(t.cast("binary"), 256)).alias("x"),
    )
    # rows that repeat collapse in the tasks, so neither a hot text nor a hot key is moved row by row
    slim = scratch_table(slim.groupBy("x", "k", "part", "mask").agg(F.count("*").alias("n")), "slim")
    first = F.rank().over(Window.partitionBy("x").orderBy("k"))
    firsts = slim.filter("k IS NOT NULL").withColumn("place", first).filter("place = 1")
    none = F.lit(0).cast("long")
    both = slim.select("k", "part", "mask", "n", F.when(F.col("k").isNull(), F.col("n")).otherwise(none).alias("first"))
    both = both.unionByName(firsts.select("k", "part", "mask", none.alias("n"), F.col("n").alias("first")))
    both = both.groupBy("k", "part", "mask").agg(F.sum("n").alias("n"), F.sum("first").alias("first"))
    said = labels.select(named(labels, key).alias("k"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    said = said.filter("k IS NOT NULL AND (good OR toxic)").groupBy("k").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    found = both.join(said, "k", "left")
    copy = F.when(F.col("copy"), F.col("n") - F.col("first")).otherwise(F.col("first"))
    found = found.withColumn("copy", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("n", copy).filter("n > 0")
    mask = F.col("mask") + F.when(F.col("copy"), F.lit(COPY)).otherwise(F.lit(0))
    some = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), none)
    return found.groupBy("part", mask.alias("mask")).agg(F.sum("n").alias("n"), some("good").alias("good"), some("toxic").alias("toxic"))


def coalitions(count: dict[int, int]) -> list[int]:
    """For each set of filters the documents that at least one of them removes."""
    return [sum(n for mask, n in count.items() if mask & s) for s in range(ALL + 1)]


def solve(a: list[list[Fraction]], b: list[Fraction]) -> list[Fraction]:
    """a x = b in rational numbers."""
    rows = [[*r, y] for r, y in zip(a, b)]
    for i in range(len(rows)):
        at = next(j for j in range(i, len(rows)) if rows[j][i])
        rows[i], rows[at] = rows[at], rows[i]
        rows[i] = [v / rows[i][i] for v in rows[i]]
        for j in range(len(rows)):
            if j != i and rows[j][i]:
                rows[j] = [v - rows[j][i] * w for v, w in zip(rows[j], rows[i])]
    return [r[-1] for r in rows]


def shapley(value: list[int]) -> list[Fraction]:
    """Shares of the game's value: weighted least squares over all sets that are
    neither empty nor whole, under the constraint that the shares add up to the
    whole's value (its multiplier is the last unknown)."""
    n = (len(value) - 1).bit_length()
    a = [[Fraction(0)] * (n + 1) for _ in range(n + 1)]
    b = [Fraction(0)] * (n + 1)
    for s in range(1, len(value) - 1):
        members = [i for i in range(n) if s >> i & 1]
        weight = Fraction(n - 1, comb(n, len(members)) * len(members) * (n - len(members)))
        for i in members:
            b[i] += weight * (value[s] - value[0])
            for j in members:
                a[i][j] += weight
    for i in range(n):
        a[i][n] = a[n][i] = Fraction(1)
    b[n] = Fraction(value[-1] - value[0])
    return solve(a, b)[:n]


def steps_of(count: dict[int, int], good: dict[int, int], toxic: dict[int, int]) -> Iterator[tuple]:
    """(order, step, *COUNTS) of a part, from its cells."""
    removed, lost_good, lost_toxic = coalitions(count), coalitions(good), coalitions(toxic)
    total = sum(count.values())
    share = [x * len(ORDERS) for x in shapley(removed)]
    assert all(x.denominator == 1 for x in share)
    for order in ORDERS:
        before = 0
        for step, letter in enumerate(order, 1):
            i = FILTERS.index(letter)
            after = before | 1 << i
            gone = removed[after] - removed[before]
            yield (
                order, step, total - removed[after], gone, removed[1 << i] - gone, removed[ALL] - removed[ALL ^ 1 << i],
                lost_good[after] - lost_good[before], lost_toxic[after] - lost_toxic[before], int(share[i]),
            )
            before = after


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """A row for each part, order of the filters and step, with COUNTS. A part's
    at most 32 cells are one row, so nothing here grows with the documents."""
    rows = cells(docs, labels, key, text, part).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, held in zip(b.column("part").to_pylist(), b.column("cells").to_pylist()):
                made = list(zip(*steps_of(*({c["mask"]: c[v] for c in held} for v in ("n", "good", "toxic")))))
                kinds = [pa.string(), pa.int32(), *[pa.int64()] * len(COUNTS)]
                yield pa.record_batch(
                    [pa.array([name] * len(made[0]), pa.string()), *[pa.array(c, k) for c, k in zip(made, kinds)]],
                    ["part", "filter_order", "step", *COUNTS],
                )

    return map_arrow(rows, run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
