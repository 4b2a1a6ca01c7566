"""Token counts by a separator scan (operator 2).

A flat token file is nothing but ids of fixed width, one document after the
other, each ended by a separator id: no index, no lengths. `scan` takes such
files as blocks (file, block, ids) cut anywhere, e.g. by `read_flat` from raw
binary files or as `write_flat` stores them, and gives every document's place
and number of tokens:

1. each block is searched for the separator in one vectorised comparison,
2. a prefix scan over the blocks of a file (running count of separators,
   running maximum of the last separator's position) carries the open
   document from block to block, so a document may span any number of blocks,
3. ends become documents. A file's tokens after its last separator are one
   more document with `ended` false.

Only positions of separators leave a task, never tokens. Nulls count as empty
texts and give documents of 0 tokens; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.checkpoint import scratch_table
from .bpe import rank_codec
from .common import map_arrow, steps, text_or_empty

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: An id that the vocabulary leaves free.
SEPARATOR = 50256
#: Ids of a block.
BLOCK = 65_536
#: Keys stored together.
NAMES = 4096


def write_flat(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, separator: int = SEPARATOR, block: int = BLOCK) -> DataFrame:
    """Encodes every text into flat files, one for each task, in the shared folder.

    Rows: (file, kind 'ids', no, data: `block` little-endian 16-bit ids, fewer in
    the last block of a file) and (file, kind 'names', no, data: NAMES 64-bit keys
    in the order of the file's documents). The latter say which document is
    which and nothing about where one begins.
    """
    slim = docs.select(docs[key].cast("long").alias("k"), text_or_empty(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codec, file = rank_codec(path), TaskContext.get().partitionId()
        held, no = {"ids": np.zeros(0, "<u2"), "names": np.zeros(0, "<i8"), "null": np.zeros(0, "u1")}, {"ids": 0, "names": 0, "null": 0}

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            for kind, n in (("ids", block), ("names", NAMES), ("null", NAMES)):
                x, out = held[kind], []
                while len(x) >= n or last and len(x):
                    out.append(x[:n].tobytes())
                    x = x[n:]
                held[kind] = x
                if out:
                    first = no[kind]
                    no[kind] += len(out)
                    yield pa.record_batch([pa.array([file] * len(out), pa.int64()), pa.array([kind] * len(out)), pa.array(range(first, no[kind]), pa.int64()), pa.array(out, pa.binary())], ["file", "kind", "no", "data"])

        for b in batches:
            texts, keys = b.column(1).to_pylist(), b.column(0)
            for lo, hi in steps(texts):
                ids, lens = codec.encode(texts[lo:hi])
                some = keys.slice(lo, hi - lo)
                held["ids"] = np.concatenate([held["ids"], np.insert(ids, np.cumsum(lens), separator).astype("<u2")])
                held["names"] = np.concatenate([held["names"], some.fill_null(0).to_numpy().astype("<i8")])
                held["null"] = np.concatenate([held["null"], some.is_null().to_numpy(zero_copy_only=False).astype("u1")])
                yield from cut(False)
        yield from cut(True)

    return scratch_table(map_arrow(slim, run, "file long, kind string, no long, data binary"), "tokens")


def read_flat(spark: SparkSession, paths: str | list[str], width: int = 2, block: int = BLOCK) -> DataFrame:
    """Blocks of raw binary files of little-endian unsigned ids of `width` bytes (each file below Spark's 2 GB for a binary value)."""
    files = spark.read.format("binaryFile").load(paths)
    size = block * width
    cut = F.expr(f"transform(sequence(0L, greatest(ceil(length / {size}) - 1, 0L)), i -> struct(i AS no, substring(content, CAST(i * {size} + 1 AS INT), {size}) AS data))")
    return files.select(F.col("path").alias("file"), F.explode(cut).alias("b")).select("file", "b.no", "b.data")


def scan(blocks: DataFrame, separator: int = SEPARATOR, width: int = 2) -> DataFrame:
    """blocks: (file, no, data). One row for each document: file, ordinal, start, n_tokens, ended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, ends = [], []
            for x in b.column("data").to_pylist():
                ids = np.frombuffer(x or b"", f"<u{width}")
                sizes.append(len(ids))
                ends.append(np.flatnonzero(ids == separator))
            yield pa.record_batch([b.column("file"), b.column("no"), pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], ["file", "no", "size", "ends"])

    kind = blocks.schema["file"].dataType.simpleString()
    found = map_arrow(blocks.select("file", "no", "data"), run, f"file {kind}, no long, size long, ends array<long>")
    before = Window.partitionBy("file").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("number", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
    placed = placed.withColumn("stop", F.col("base") + F.expr("try_element_at(ends, -1)"))
    placed = placed.withColumn("carry", F.coalesce(F.max("stop").over(before), F.lit(-1)))  # the last separator before the block
    ends = placed.select("file", "number", "base", "carry", "ends", F.posexplode("ends").alias("i", "at"))
    done = ends.select(
        "file",
        (F.col("number") + F.col("i")).alias("ordinal"),
        (F.when(F.col("i") == 0, F.col("carry")).otherwise(F.col("base") + F.expr("ends[i - 1]")) + 1).alias("start"),
        (F.col("base") + F.col("at")).alias("stop"),
        F.lit(True).alias("ended"),
    )
    rest = placed.groupBy("file").agg(F.sum(F.size("ends")).cast("long").alias("ordinal"), (F.coalesce(F.max("stop"), F.lit(-1)) + 1).alias("start"), F.sum("size").alias("stop"), F.lit(False).alias("ended"))
    return done.unionByName(rest.filter("start < stop")).select("file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "ended")


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(key, file, ordinal, start, n_tokens) of every row, by way of flat files."""
    flat = write_flat(docs, key, text, path)

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, kind, no, data in zip(*(c.to_pylist() for c in b.columns)):
                x = np.frombuffer(data, "<i8" if kind == "names" else "u1").astype(np.int64)
                yield pa.record_batch([pa.array(np.full(len(x), file), pa.int64()), pa.array([kind] * len(x), pa.string()), pa.array(np.arange(len(x)) + no * NAMES), pa.array(x)], ["file", "kind", "ordinal", "value"])

    rows = map_arrow(flat.filter("kind <> 'ids'"), names, "file long, kind string, ordinal long, value long")
    who = rows.groupBy("file", "ordinal").agg(F.max(F.when(F.col("kind") == "names", F.col("value"))).alias("k"), F.max(F.when(F.col("kind") == "null", F.col("value"))).alias("gone"))
    who = who.select("file", "ordinal", F.when(F.col("gone") == 0, F.col("k")).alias(key))
    return scan(flat.filter("kind = 'ids'")).join(who, ["file", "ordinal"]).select(key, "file", "ordinal", "start", "n_tokens")
