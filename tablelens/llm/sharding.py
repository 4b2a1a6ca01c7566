"""Consistent-hash ring with virtual nodes and bounded loads (operator 10).

DataFrame functions only. A row's key is its text (equal texts share a place
on the ring), the ring has `vnodes` virtual nodes a shard on `CELLS` places,
and a shard holds at most its bound. What overflows a full shard continues
clockwise to the next shard with room.

How this runs without one task for each shard: all rows between two
neighbouring virtual nodes (an arc) meet the shards in the same order, so the
walk needs no more than the number of rows of each arc. These counts (at most
shards x vnodes rows, whatever the input) are walked on the driver and give,
for each arc, runs of ranks that go to a shard. A row's rank in its arc comes
from cells of about ROWS rows that are dealt by a stored random number, so no
text, key or arc ends up in one task.

With `epsilon` 0 (law `rows`) the bounds add up to the number of rows: every
shard is full and counts differ by one at most. With a larger epsilon a bound
is (1 + epsilon) times the mean and fewer rows move when shards are added.

Null texts count as empty, null and repeated ids are rows like any others, an
empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.checkpoint import scratch_table
from .common import text_or_empty

SHARDS = 16
VNODES = 64
#: Places on the ring, a power of two.
BITS = 14
#: Rows that get their rank in one task's window, about.
ROWS = 1024


def ring(shards: int, vnodes: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(place, shard) of the virtual nodes, clockwise; a place has one node."""
    nodes: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            nodes.setdefault(zlib.crc32(f"shard {s} node {v}".encode()) >> (32 - bits), s)
    return sorted(nodes.items())


def arc_of_place(nodes: list[tuple[int, int]], bits: int = BITS) -> list[int]:
    """For each place the first node at or after it, clockwise."""
    out, k = [], 0
    for place in range(1 << bits):
        while k < len(nodes) and nodes[k][0] < place:
            k += 1
        out.append(k % len(nodes))
    return out


def clockwise(nodes: list[tuple[int, int]]) -> list[list[int]]:
    """For each arc the different shards in the order in which a row meets them."""
    return [list(dict.fromkeys(nodes[(a + i) % len(nodes)][1] for i in range(len(nodes)))) for a in range(len(nodes))]


def bounds(n: int, shards: int, epsilon: float) -> list[int]:
    if epsilon:
        return [max(-(-n // shards), int((1 + epsilon) * n / shards))] * shards
    return [n // shards + (s < n % shards) for s in range(shards)]


def walk(counts: dict[int, int], orders: list[list[int]], bound: list[int]) -> list[list[dict]]:
    """For each arc, runs of ranks: from f (inclusive) to t go to shard s at slots from b."""
    runs: list[list[dict]] = [[] for _ in orders]
    placed, room = [0] * len(orders), list(bound)
    for step in range(max(map(len, orders))):
        for arc, order in enumerate(orders):
            wait = counts.get(arc, 0) - placed[arc]
            if wait and step < len(order):
                s = order[step]
                take = min(wait, room[s])
                if take:
                    runs[arc].append({"f": placed[arc], "t": placed[arc] + take, "s": s, "b": bound[s] - room[s]})
                    placed[arc] += take
                    room[s] -= take
    return runs


def _constant(value, schema: str):
    return F.from_json(F.lit(json.dumps(value)), schema)


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, vnodes: int = VNODES, epsilon: float = 0.0) -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every row."""
    nodes = ring(shards, vnodes)
    orders = clockwise(nodes)
    t = text_or_empty(text)
    place = F.shiftrightunsigned(F.xxhash64(t), 64 - BITS)
    rows = docs.select(
        F.col(key),
        (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.element_at(_constant(arc_of_place(nodes), "array<int>"), (place + 1).cast("int")).alias("arc"),
        F.xxhash64(F.monotonically_increasing_id()).alias("deal"),
    )
    rows = scratch_table(rows, "rows")
    counts = {r["arc"]: r["n"] for r in rows.groupBy("arc").agg(F.count("*").alias("n")).collect()}  # at most one row for each virtual node
    runs = walk(counts, orders, bounds(sum(counts.values()), shards, epsilon))
    cells = [-(-counts.get(a, 0) // ROWS) or 1 for a in range(len(nodes))]
    rows = rows.withColumn("cell", F.pmod("deal", F.element_at(_constant(cells, "array<bigint>"), F.col("arc") + 1)))
    before = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("arc", "cell").agg(F.count("*").alias("n")).select("arc", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("arc", "cell").orderBy(key, "text_crc32", "deal")
    ranked = rows.withColumn("rank", F.row_number().over(inside) - 1).join(first, ["arc", "cell"]).withColumn("rank", F.col("rank") + F.col("first"))
    mine = F.element_at(_constant(runs, "array<array<struct<f:bigint,t:bigint,s:int,b:bigint>>>"), F.col("arc") + 1)
    run = F.element_at(F.filter(mine, lambda r: (F.col("rank") >= r["f"]) & (F.col("rank") < r["t"])), 1)
    return ranked.withColumn("run", run).select(key, "size", "text_crc32", F.col("run.s").alias("shard"), (F.col("run.b") + F.col("rank") - F.col("run.f")).alias("slot"))


def shard_report(docs: DataFrame) -> DataFrame:
    """What the query returns: `shard` under the law of equal row counts."""
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
