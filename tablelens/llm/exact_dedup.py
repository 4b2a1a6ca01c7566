"""Grace hash deduplication (operator 4).

1. Build. Each task runs its rows through an open-addressing table that
   compares complete contents, so the copies inside a task collapse to one
   row: a hot text leaves a task once, however many rows it has.
2. Partition. The rows that are left are dealt by hash into buckets, which
   Spark's shuffle writes to and reads from its spill files. A bucket whose
   different contents are larger than `BUCKET_BYTES` is partitioned again by
   the next hash, and so on (a bucket of a single hash needs no more).
3. Probe. Each bucket streams through another table of the same kind. Only
   different contents are held, so its memory is bounded by the bucket size.

Two texts are equal if their bytes are; a null text counts as empty. Of equal
rows the one with the largest key stays, null keys last, and of rows that share
text and key one. Very long texts are compared in full like all others. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoint import scratch_table
from .common import map_arrow, named, text_or_empty

#: Bytes of different contents that a bucket may hold.
BUCKET_BYTES = 24 << 20
#: Bytes of different contents, and of what else a task keeps of its rows, that it holds before it passes them on.
TASK_BYTES = 24 << 20
#: Into how many buckets a bucket that does not fit is partitioned again.
FAN_OUT = 8
#: Buckets that are too large are sent to all tasks up to this number, else joined.
FEW = 100_000


class ContentTable:
    """Open addressing with linear probing; equal hashes are compared in full."""

    def __init__(self, size: int = 1 << 12):
        self.slot = np.full(size, -1, np.int64)
        self.hash = np.zeros(0, np.uint64)
        self.content: list[bytes] = []
        self.bytes = 0

    def add(self, h: np.ndarray, content: list[bytes]) -> np.ndarray:
        """The entry of each content; new contents become entries."""
        while 2 * (len(self.content) + len(h)) > len(self.slot):
            self._grow()
        mask = np.uint64(len(self.slot) - 1)
        pos = (h & mask).astype(np.int64)
        out, todo = np.full(len(h), -1, np.int64), np.arange(len(h))
        hashes = np.concatenate([self.hash, h])
        used = len(self.content)
        while len(todo):
            entry = self.slot[pos[todo]]
            free = todo[entry < 0]
            if len(free):  # of those that ask for a free slot, one gets it
                self.slot[pos[free]] = -2 - free
                won = free[self.slot[pos[free]] == -2 - free]
                made = used + np.arange(len(won))
                self.slot[pos[won]], hashes[made], out[won] = made, h[won], made
                self.content.extend(content[i] for i in won)
                self.bytes += sum(len(content[i]) for i in won)
                used += len(won)
            todo = todo[out[todo] < 0]
            entry = self.slot[pos[todo]]
            same = [hashes[e] == h[i] and self.content[e] == content[i] for i, e in zip(todo.tolist(), entry.tolist())]
            same = np.array(same, bool)
            out[todo[same]] = entry[same]
            todo = todo[~same]
            pos[todo] = (pos[todo] + 1) & int(mask)
        self.hash = hashes[:used]
        return out

    def _grow(self) -> None:
        n = 2 * len(self.slot)
        self.slot = np.full(n, -1, np.int64)
        pos, todo = (self.hash & np.uint64(n - 1)).astype(np.int64), np.arange(len(self.hash))
        while len(todo):
            free = todo[self.slot[pos[todo]] < 0]
            self.slot[pos[free]] = free
            todo = todo[self.slot[pos[todo]] != todo]
            pos[todo] = (pos[todo] + 1) & (n - 1)


def _best(entry: np.ndarray, key: pa.Array) -> np.ndarray:
    """For each entry the row with the largest key (of any type), null keys last, then the last row."""
    rows = pa.table({"entry": entry, "null": key.is_valid(), "key": key})
    order = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in rows.column_names]).to_numpy()
    return order[np.append(np.flatnonzero(np.diff(entry[order])), len(order) - 1)]


def _slim(docs: DataFrame, key: str, text: str, whole: bool) -> DataFrame:
    t = text_or_empty(text)
    others = [named(docs, c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text]
    rest = F.struct(*others, named(docs, text).isNull().alias("null")) if whole else F.lit(0)
    return docs.select(named(docs, key).alias("k"), F.xxhash64(t).alias("h"), t.cast("binary").alias("t"), rest.alias("rest"))


def _build(slim: DataFrame, members: bool) -> DataFrame:
    """Rows with a content: the best row of each content in a task (n: its rows).
    With `members` also a row without content for each row of the input; g says
    which content of which task it has, r is its number."""
    rest, kind = (slim.schema[c].dataType.simpleString() for c in ("rest", "k"))
    out = ["k", "r", "g", "n", "h", "t", "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        table, kept, entries, held = ContentTable(), [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows = pa.Table.from_batches(kept).combine_chunks()
            k, rest_, entry = rows.column("k").combine_chunks(), rows.column("rest").combine_chunks(), np.concatenate(entries)
            best, count, r = _best(entry, k), np.bincount(entry), np.arange(len(entry)) + number
            g = entry + number
            first = pa.array(best)
            for lo in range(0, len(best), 2048):
                some = first[lo : lo + 2048]
                at = best[lo : lo + 2048]
                contents = pa.array([table.content[e] for e in entry[at]], pa.binary())
                yield pa.record_batch([k.take(some), pa.array(r[at]), pa.array(g[at]), pa.array(count[entry[at]]), pa.array(table.hash[entry[at]].view(np.int64)), contents, rest_.take(some)], out)
            if members:
                for lo in range(0, len(entry), 65_536):
                    some = slice(lo, lo + 65_536)
                    none = [pa.nulls(len(entry[some]), t) for t in (pa.int64(), pa.int64(), pa.binary(), rest_.type)]
                    yield pa.record_batch([k[some], pa.array(r[some]), pa.array(g[some]), *none], out)
            number += len(entry)

        for b in batches:
            for lo in range(0, b.num_rows, 512):
                some = b.slice(lo, 512)
                entries.append(table.add(some.column("h").to_numpy().view(np.uint64), some.column("t").to_pylist()))
                kept.append(pa.record_batch([some.column("k"), pa.concat_arrays([some.column("rest")])], ["k", "rest"]))
                held += kept[-1].nbytes + 32 * len(some)
                if table.bytes + held > TASK_BYTES:
                    yield from flush()
                    table, kept, entries, held = ContentTable(), [], [], 0
        if kept:
            yield from flush()

    return map_arrow(slim, run, f"k {kind}, r long, g long, n long, h long, t binary, rest {rest}")


def _buckets(built: DataFrame) -> DataFrame:
    """The rows with a content, dealt so that every bucket fits; one task for each bucket, about."""
    rows = built.filter("t IS NOT NULL")
    sized = rows.groupBy("h").agg(F.max(F.octet_length("t")).cast("long").alias("b"))
    sized = scratch_table(sized, "sizes")  # one row for each hash
    fan = max(1, -(-(sized.agg(F.sum("b")).first()[0] or 0) // BUCKET_BYTES))
    name, number, level = F.pmod("h", F.lit(fan)), fan, 0
    rows, sized = rows.withColumn("bucket", name), sized.withColumn("bucket", name)
    while True:
        large = sized.groupBy("bucket").agg(F.sum("b").alias("b"), F.count("*").alias("hashes")).filter((F.col("b") > 2 * BUCKET_BYTES) & (F.col("hashes") > 1)).select("bucket", F.lit(True).alias("large"))
        many = large.count()
        if not many:
            return rows.repartitionById(number, F.pmod("bucket", F.lit(number)).cast("int"))
        level += 1
        large = F.broadcast(large) if many <= FEW else large
        again = F.xxhash64("bucket", F.pmod(F.xxhash64("h", F.lit(level)), F.lit(FAN_OUT)))
        rows, sized = (x.join(large, "bucket", "left").withColumn("bucket", F.when(F.col("large"), again).otherwise(F.col("bucket"))).drop("large") for x in (rows, sized))
        number += many * (FAN_OUT - 1)


def _probe(buckets: DataFrame, schema: str, emit) -> DataFrame:
    """emit(rows without contents, their entries, the contents) gives a task's result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, kept, entries = ContentTable(), [], []
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                some = b.slice(lo, 512)
                entries.append(table.add(some.column("h").to_numpy().view(np.uint64), some.column("t").to_pylist()))
                names = ["k", "r", "g", "n", "rest"]
                kept.append(pa.record_batch([pa.concat_arrays([some.column(c)]) for c in names], names))
        if kept:
            yield from emit(pa.Table.from_batches(kept).combine_chunks(), np.concatenate(entries), table.content)

    return map_arrow(buckets, run, schema)


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, keep, group_size, kept) and `digest` (sha256 of the text) of every row."""
    slim = _slim(docs, key, text, False)
    built = scratch_table(_build(slim.withColumn("rest", F.sha2("t", 256)), True), "built")

    def emit(rows: pa.Table, entry: np.ndarray, content: list[bytes]) -> Iterator[pa.RecordBatch]:
        k = rows.column("k").combine_chunks()
        best, size = _best(entry, k), np.bincount(entry, rows.column("n").to_numpy()).astype(np.int64)
        at = pa.array(best[entry])
        r = rows.column("r").combine_chunks()
        yield pa.record_batch([rows.column("g").combine_chunks(), k.take(at), r.take(at), pa.array(size[entry]), rows.column("rest").combine_chunks().take(at)], ["g", "keep", "keep_r", "group_size", "digest"])

    groups = _probe(_buckets(built), f"g long, keep {built.schema['k'].dataType.simpleString()}, keep_r long, group_size long, digest string", emit)
    rows = built.filter("t IS NULL").select("k", "r", "g")
    return rows.join(groups, "g").select(F.col("k").alias(key), "keep", "group_size", (F.col("r") == F.col("keep_r")).alias("kept"), "digest")


def distinct(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    built = scratch_table(_build(_slim(docs, key, text, True), False), "built")
    rest = built.schema["rest"].dataType.simpleString()

    def emit(rows: pa.Table, entry: np.ndarray, content: list[bytes]) -> Iterator[pa.RecordBatch]:
        best = _best(entry, rows.column("k").combine_chunks())
        kept = rows.column("rest").combine_chunks()
        for lo in range(0, len(best), 2048):
            at = best[lo : lo + 2048]
            yield pa.record_batch([kept.take(pa.array(at)), pa.array([content[e] for e in entry[at]], pa.binary())], ["rest", "t"])

    found = _probe(_buckets(built), f"rest {rest}, t binary", emit)
    kind = docs.schema[text].dataType
    body = F.when(~F.col("rest.null"), F.col("t").cast("string")).cast(kind)
    return found.select(*[(body if c == text else F.col(f"rest.c{i}")).alias(c) for i, c in enumerate(docs.columns)])
