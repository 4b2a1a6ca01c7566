"""Threshold-scaled sketches as document fingerprints (operator 8).

DataFrame functions only. The shingles of a text are its runs of WORDS words
(split at white space; a shorter text is one shingle). A fingerprint keeps
every shingle hash below a fixed fraction of the hash range (and always the
least one, so that no text is without). The threshold is the same for all
texts, so fingerprints of parts merge into that of the whole by a union, and
shared hashes estimate containment even between texts of very unequal size.

`with_next` pairs every document with the next one in falling order of ids
without one global window: ids are cut into ranges of about RANGE rows at ids
that approx_percentile finds; a window runs in each range. A range's first
document is also put behind the range before it, so its last one finds its
successor there.

Null texts count as empty; their only shingle is the empty one. Null ids come
last. Rows that share an id follow one another in the order of their texts'
hashes. Equal texts have equal fingerprints. A single row is its own next one.
An empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

WORDS = 5
#: One of so many hashes is kept.
SCALE = 4
#: Rows of a range of ids, about, and the most ranges (two levels of their root).
RANGE, RANGES = 2048, 128 * 128


def sketch(text: Column, words: int = WORDS, scale: int = SCALE) -> Column:
    """Sorted array of the kept hashes (32 bits, unsigned)."""
    hashed = F.transform(F.split(F.trim(text), r"\s+"), lambda w: F.xxhash64(w))
    return _kept(hashed, words, scale)


def _kept(hashed: Column, words: int, scale: int) -> Column:
    # Shingle i is the hash of hashes i..i+words-1; 32 bits of it are kept.
    most = (1 << 32) // scale

    def of(h: Column) -> Column:
        n = F.greatest(F.size(h) - words, F.lit(0))
        return F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(h, i, words)), 32))

    def keep(s: Column) -> Column:
        low = F.filter(s, lambda x: x < most)
        return F.array_sort(F.array_distinct(F.when(F.size(low) > 0, low).otherwise(F.array(F.array_min(s)))))

    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  value is computed once
    return once(once(hashed, of), keep)


def likeness(a: Column, b: Column) -> Column:
    """Shared part of both (Jaccard)."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def containment(a: Column, b: Column) -> Column:
    """Part of a's hashes that b has."""
    return F.size(F.array_intersect(a, b)) / F.size(a)


def as_text(a: Column) -> Column:
    """Eight hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def with_next(rows: DataFrame, key: str, tie: str, columns: list[str]) -> DataFrame:
    """rows and, as next_<column>, what the next row in falling order of key has."""
    n, low, high, ranges = rows.agg(F.count("*"), F.min(key), F.max(key), F.count(F.lit(1)) / RANGE).first()
    parts = int(min(RANGES, max(1, ranges)))
    cuts = []
    if parts > 1:
        found = rows.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], max(10_000, 20 * parts))).first()[0]
        cuts = sorted({c for c in found or [] if c < high})
    # range i holds the ids above cuts[i-1] up to cuts[i]; the root of their number bounds both levels of the search
    step = max(1, int(len(cuts) ** 0.5))
    level = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    id_ = F.col(key).cast("long")
    if cuts:
        tops = F.from_json(F.lit(json.dumps([b[-1] for b in level])), "array<bigint>")
        blocks = F.from_json(F.lit(json.dumps(level)), "array<array<bigint>>")
        below = F.size(F.filter(tops, lambda c: c < id_))
        inside = F.size(F.filter(F.element_at(blocks, F.least(below + 1, F.lit(len(level)))), lambda c: c < id_))
        at = F.when(below >= len(level), F.lit(len(cuts))).otherwise(below * step + inside)
    else:
        at = F.lit(0)
    last = 0  # the range of the last row: nulls come last, then the least id
    at = F.when(id_.isNull(), F.lit(last)).otherwise(at)
    rows = rows.withColumn("__at", at.cast("int"))
    first = F.array_contains(F.from_json(F.lit(json.dumps(cuts)), "array<bigint>"), id_) if cuts else F.lit(False)
    wraps = id_.eqNullSafe(F.lit(high).cast("long"))
    places = F.concat(
        F.array(F.struct(F.col("__at").alias("at"), F.lit(0).alias("turn"))),
        F.when(first, F.array(F.struct((F.col("__at") + 1).alias("at"), F.lit(1).alias("turn")))).otherwise(F.array().cast("array<struct<at:int,turn:int>>")),
        F.when(wraps, F.array(F.struct(F.lit(last).alias("at"), F.lit(2).alias("turn")))).otherwise(F.array().cast("array<struct<at:int,turn:int>>")),
    )
    rows = rows.withColumn("__place", F.explode(places)).select(*[c for c in rows.columns if c != "__at"], F.col("__place.at").alias("__at"), F.col("__place.turn").alias("__turn"))
    order = Window.partitionBy("__at").orderBy("__turn", F.col(key).desc_nulls_last(), tie)
    out = rows
    for c in columns:
        out = out.withColumn(f"next_{c}", F.lead(c).over(order))
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """key and the fingerprint (array) of every text."""
    return docs.select(key, sketch(text_or_empty(text), words, scale).alias("fingerprint"))


def edited_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text (the last third replaced by
    the beginning of the next document's) and the likeness of both and of the
    next document's."""
    t = text_or_empty(text)
    rows = docs.select(F.col(key), t.alias("t"), F.xxhash64(t).alias("x"))
    rows = with_next(rows, key, "x", ["t"])
    n = F.char_length("t")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.expr("left(t, char_length(t) - CAST(floor(char_length(t) / 3) AS INT))"), F.expr("left(next_t, CAST(floor(char_length(t) / 3) AS INT))"))
    rows = rows.select(key, "x", "__at", "__turn", n.cast("long").alias("n_chars"), edited.alias("e"), sketch(F.col("t")).alias("f"))
    order = Window.partitionBy("__at").orderBy("__turn", F.col(key).desc_nulls_last(), "x")
    rows = rows.withColumn("nf", F.lead("f").over(order)).filter("__turn = 0")
    rows = rows.select(key, "n_chars", F.sha2("e", 256).alias("edited_sha256"), "f", sketch(F.col("e")).alias("ef"), "nf")
    return rows.select(
        key,
        "n_chars",
        "edited_sha256",
        as_text(F.col("f")).alias("fingerprint"),
        as_text(F.col("ef")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("ef")).alias("near_edited"),
        likeness(F.col("f"), F.col("nf")).alias("near_next"),
        containment(F.col("f"), F.col("ef")).alias("contained_edited"),
        containment(F.col("f"), F.col("nf")).alias("contained_next"),
    )
