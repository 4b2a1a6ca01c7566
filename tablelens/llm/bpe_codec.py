"""Byte-level BPE encoding and decoding of a text column (operator 7).

`encode_decode` adds nothing to the driver and shuffles nothing: every task
streams its Arrow batches through `bpe.RankCodec` (padded numpy matrices, see
bpe.py) and decodes the ids again.

Nulls count as empty texts; an empty text has no ids. Repeated rows give
repeated results. Very long texts are encoded in segments cut where the
pattern always splits, so their ids are those of the whole text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import rank_codec
from .common import map_arrow, offsets, steps, text_or_empty

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>) of every row."""
    return _run(docs, key, text, path, "ids array<int>", lambda codec, ids, edge: [pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids, pa.int32()))])


def decode(rows: DataFrame, key: str = "doc_id", ids: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """(key, text) of rows of ids; bytes that are no UTF-8 become U+FFFD."""
    slim = rows.select(rows[key].alias("k"), rows[ids].alias("i"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = rank_codec(path)
        for b in batches:
            out = [codec.decode(np.array(x or [], np.int64)).tobytes().decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(out, pa.string())], ["k", "text"])

    return map_arrow(slim, run, f"k {slim.schema['k'].dataType.simpleString()}, text string").withColumnRenamed("k", key)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): the ids and the bytes decoded from them."""

    def columns(codec, ids, edge):
        raw, data = ids.astype("<u4"), codec.decode(ids)
        ends = np.concatenate([[0], np.cumsum(codec.token_size[ids])])[edge]
        pairs = list(zip(edge[:-1], edge[1:]))
        return [
            pa.array(np.diff(edge), pa.int64()),
            pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in pairs], pa.string()),
            pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:])], pa.string()),
        ]

    return _run(docs, key, text, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", columns)


def _run(docs: DataFrame, key: str, text: str, path: str, schema: str, columns) -> DataFrame:
    slim = docs.select(docs[key].alias("k"), text_or_empty(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = rank_codec(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in steps(texts):
                ids, lens = codec.encode(texts[lo:hi])
                made = columns(codec, ids, offsets(lens))
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), *made], ["k", *(f"c{i}" for i in range(len(made)))])

    names = [x.split(" ")[0] for x in schema.split(", ")]
    typed = ", ".join(f"c{i} {x.split(' ')[1]}" for i, x in enumerate(schema.split(", ")))
    out = map_arrow(slim, run, f"k {slim.schema['k'].dataType.simpleString()}, {typed}")
    return out.toDF(key, *names)
