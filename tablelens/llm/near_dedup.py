"""Order MinHash near-duplicate detection (operator 5).

Words are runs of letters and digits between white space, in lower case. A
document's k-mers are its runs of K words, each labelled with how often it has
occurred before.

1. Sketch. For each of SKETCHES hash functions the PICKED labelled k-mers of
   least hash are kept in the order of the text; their hash is one value. Two
   texts share a value with a probability that falls with their edit distance
   (not only with their sets of k-mers). SHORT_SKETCHES more are over runs of
   SHORT_K words, which find pairs at the least similarity, and texts of at most
   EXACT words get deletion keys, which find all. Words and values are written once.
2. Copies. Texts of the same words become one representative by an aggregate,
   so a group of copies costs one row for each task, whatever its size.
3. Candidates. The representatives of a bucket (sketch, value) are compared
   with its first one: n - 1 pairs, not n^2. Those that fail are compared with
   those that are near it (unless the distances to it rule that out). What is left
   of at most SMALL rows is compared pair by pair. The rows that are left of any
   larger bucket are compared inside the bucket: bit maps of the words rule most pairs
   out (an edit takes one word of a text), the others are verified there, in one
   of the buckets where they meet. Those of buckets of more than HUGE rows are joined: two near texts share some of their rarest runs of
   GRAM words (so many that the edits can't hit all), at about the same place. Both
   ways are exact. Texts whose links so far make them one class aren't compared again.
4. Verification. Banded alignment: the edit distance in words within a band
   around the diagonal that is as wide as SIMILARITY allows, first in a narrow
   band, for a batch of pairs at once. Similarity is 1 - distance / longer.
5. Classes. Connected components of the links, by repeated minimum labels.

Null texts count as empty. Texts without a letter or digit are near only to
texts that are identical. Texts of fewer than K words have one k-mer. Null or
repeated ids are rows of their own. Empty tables give empty results.
"""

from __future__ import annotations

import bisect
import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoint import drop_tables, free_shuffles, scratch_table
from .bpe import LETTER, NUMBER, SPACE, classes, splitmix, word_hashes
from .common import map_arrow, named, offsets, steps, text_or_empty

#: Words of a k-mer.
K = 5
#: Hash functions, and k-mers that each keeps.
SKETCHES, PICKED = 32, 2
#: Hash functions over runs of SHORT_K words besides: at the least similarity few runs of K words are whole.
SHORT_K, SHORT_SKETCHES = 2, 16
#: Values of a text before its deletion keys.
VALUES = SKETCHES + SHORT_SKETCHES
#: Texts up to so many words also get a key for each choice of words that may be left out.
EXACT = 14
#: Bits of a value's place.
PLACES = 8
SIMILARITY = 0.8
#: Rows of a bucket whose undecided pairs are all compared.
SMALL = 32
#: Rows of larger buckets that one task compares at once with as many, their words, and rows of buckets that are joined instead.
BLOCK, BLOCK_WORDS, HUGE = 1 << 13, 1 << 23, 1 << 18
#: Bits of a map for each word of the text, at least, and 64-bit words of maps compared at once.
MAP_BITS, CELLS = 4, 1 << 18
#: Words of a run that the rows of huge buckets are joined by, and the least texts that have enough of them
#: (n // GRAM > n (1 - SIMILARITY) / SIMILARITY); below WORDS_BELOW, all that are near a lesser one, words join as well.
GRAM, GRAMS_FROM, WORDS_BELOW = 3, 9, 12
#: Words that two such texts share count so often: one is enough.
ALWAYS = 1 << 20
#: Counters of the values, by hash (a power of two): any order of the values is exact, the rarest first gives the fewest pairs.
COUNTERS = 1 << 18
#: The first band, as a part of the length; what it can't decide gets the whole band.
NARROW = 1 / 16
#: Pairs up to this number send the numbers of their rows to all tasks (8 bytes each); more are joined.
FEW = 1_000_000
#: Characters sketched at once.
STEP = 1_000_000
#: Cells of an alignment matrix row, over all pairs of a batch.
WIDE = 400_000


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and the number of each text."""
    lowered = [t.lower() for t in texts]
    edge = offsets(np.fromiter(map(len, lowered), np.int64, len(lowered)))
    cp = np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32)
    kind = classes()[cp]
    real = np.flatnonzero((kind == LETTER) | (kind == NUMBER))
    if not len(real):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    cut = kind == SPACE
    cut[edge[:-1][edge[:-1] < len(cp)]] = True
    group = np.cumsum(cut)[real]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    lens = np.diff(np.append(starts, len(real)))
    return word_hashes(cp[real], starts, lens), np.diff(np.searchsorted(real[starts], edge))


def sketch(words: np.ndarray, count: np.ndarray, k: int = K, sketches: int = SKETCHES, picked: int = PICKED) -> np.ndarray:
    """(texts, sketches) values; texts without words get 0."""
    out = np.zeros((len(count), sketches), np.uint64)
    some = np.flatnonzero(count)
    if not len(some):
        return out
    mers = np.maximum(count[some] - k + 1, 1)
    edge, start = offsets(mers), offsets(count)[:-1][some]
    doc = np.repeat(np.arange(len(some)), mers)
    at = np.arange(edge[-1]) - edge[doc] + start[doc]
    end = (start + count[some])[doc]
    mix = splitmix(k + 2, 11)
    mer = np.zeros(len(at), np.uint64)
    for j in range(k):
        inside = at + j < end
        mer += np.where(inside, words[np.minimum(at + j, len(words) - 1)], np.uint64(0)) * mix[j]
    mer ^= mer >> np.uint64(31)
    own = mer * mix[k] + doc.astype(np.uint64) * mix[k + 1]  # the same k-mer in the same text
    order = np.argsort(own, kind="stable")
    new = np.concatenate([[True], own[order][1:] != own[order][:-1]])
    seen = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    label = np.zeros(len(order), np.uint64)
    label[order] = seen.astype(np.uint64)
    base = (mer + label * mix[k]) * mix[k + 1]
    base ^= base >> np.uint64(29)
    for i, (a, salt) in enumerate(zip(splitmix(sketches, 101), splitmix(sketches, 202))):
        h = base * a
        h ^= h >> np.uint64(32)
        where = []
        for _ in range(picked):
            least = np.minimum.reduceat(h, edge[:-1])
            hit = np.flatnonzero(h == least[doc])
            hit = hit[np.searchsorted(hit, edge[:-1])]  # the first of each text
            where.append(hit)
            h[hit] = np.uint64(2**64 - 1)
        where = np.sort(np.array(where), axis=0)  # in the order of the text
        value = np.full(len(some), salt)
        for p in where:
            value = (value ^ base[p]) * mix[0]
            value ^= value >> np.uint64(29)
        out[some, i] = value
    return out


@functools.cache
def _left(n: int) -> list[np.ndarray]:
    """The places that stay when up to floor(n (1 - SIMILARITY)) of n words go."""
    return [np.array(list(itertools.combinations(range(n), n - d)), np.int64) for d in range(int(n * (1 - SIMILARITY) + 1e-9) + 1)]


def deletion_keys(words: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """For each text of 1 to EXACT words the hashes of it without up to as many
    words as it may have edits. Two such texts within the limit share one: of
    s replaced, a added and i missing words the longer text leaves out s + a and
    the shorter s + i."""
    edge, coef = offsets(count), splitmix(EXACT, 404)
    mixed = words ^ (words >> np.uint64(32))
    out = []
    for lo, n in zip(edge[:-1].tolist(), count.tolist()):
        if not 0 < n <= EXACT:
            out.append(np.zeros(0, np.uint64))
            continue
        own = mixed[lo : lo + n]
        out.append(np.unique(np.concatenate([(own[keep] * coef[: keep.shape[1]]).sum(axis=1, dtype=np.uint64) for keep in _left(n)])))
    return out


def distances(pairs: list[tuple[np.ndarray, np.ndarray]], limit: np.ndarray) -> np.ndarray:
    """Word edit distance of each pair, or -1 where it is above the limit."""
    out = np.full(len(pairs), -1, np.int64)
    todo = []
    for i, (a, b) in enumerate(pairs):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > limit[i]:
            continue
        same = a == b[: len(a)]
        lead = len(a) if same.all() else int(same.argmin())
        a, b = a[lead:], b[lead:]
        if len(a):
            same = a[::-1] == b[::-1][: len(a)]
            tail = len(a) if same.all() else int(same.argmin())
            a, b = a[: len(a) - tail], b[: len(b) - tail]
        if not len(a) or limit[i] == 0:
            out[i] = len(b) if len(b) <= limit[i] else -1
            continue
        if len(b) - _common(a, b) > limit[i]:  # words that the other lacks must be edited
            continue
        todo.append((i, a, b))
    wide = []
    for narrow in (True, False):
        rows = todo if narrow else wide
        band = [min(int(limit[i]), max(8, int(len(b) * NARROW), len(b) - len(a))) if narrow else int(limit[i]) for i, a, b in rows]
        order = sorted(range(len(rows)), key=lambda x: (len(rows[x][1]), band[x]))
        while order:
            take, width = [], 0
            while order and (not take or (len(take) + 1) * (2 * max(width, band[order[-1]]) + 1) <= WIDE) and (not take or 2 * len(rows[order[-1]][1]) >= len(rows[take[0]][1])):
                take.append(order.pop())
                width = max(width, band[take[-1]])
            got = _align([rows[x][1:] for x in take], width)
            for x, d in zip(take, got.tolist()):
                i = rows[x][0]
                if d <= min(band[x], limit[i]):
                    out[i] = d
                elif narrow and band[x] < limit[i]:
                    wide.append(rows[x])
    return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    _, inv = np.unique(both, return_inverse=True)
    n = int(inv.max()) + 1
    return int(np.minimum(np.bincount(inv[: len(a)], minlength=n), np.bincount(inv[len(a) :], minlength=n)).sum())


def _align(pairs: list[tuple[np.ndarray, np.ndarray]], t: int) -> np.ndarray:
    """Distances by dynamic programming over the diagonals -t..t of all pairs at
    once (above t they may be too large). The texts' ends are padded: a text
    that has ended keeps its last row."""
    n = np.array([len(a) for a, _ in pairs])
    m = np.array([len(b) for _, b in pairs])
    rows, width = int(n.max()), 2 * t + 1
    kind = np.int32
    a = np.zeros((len(pairs), rows), np.uint32)
    b = np.zeros((len(pairs), rows + width), np.uint32)
    inside = np.zeros((len(pairs), rows + width), bool)
    for i, (x, y) in enumerate(pairs):
        a[i, : len(x)] = x
        y = y[: max(0, rows + width - t)]
        b[i, t : t + len(y)] = y  # column j of the text stands at t + j
        inside[i, t : t + len(y)] = True
    d = np.arange(width, dtype=kind) - t
    far = kind(1 << 28)
    row = np.where(d >= 0, d, far).astype(kind) + np.zeros((len(pairs), 1), kind)  # from the empty prefix
    last = row.copy()
    ended = np.flatnonzero(n == 0)
    steps_ = np.arange(width, dtype=kind)
    for i in range(rows):
        differ = (b[:, i : i + width] != a[:, i : i + 1]) | ~inside[:, i : i + width]
        new = row + differ
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
        new -= steps_
        np.minimum.accumulate(new, axis=1, out=new)
        new += steps_
        if i < t:  # columns left of the text
            new[:, : t - i - 1] = far
            new[:, t - i - 1] = i + 1
        row = new
        ended = np.flatnonzero(n == i + 1)
        if len(ended):
            last[ended] = row[ended]
    at = m - n + t
    ok = (at >= 0) & (at < width)
    return np.where(ok, last[np.arange(len(pairs)), np.clip(at, 0, width - 1)], far)


def _sum(words: np.ndarray, count: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each text's words in order."""
    edge, coef = offsets(count), splitmix(max(1, int(count.max(initial=0))), seed)
    place = np.arange(len(words)) - np.repeat(edge[:-1], count)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((words ^ (words >> np.uint64(32))) * coef[place], dtype=np.uint64)])
    return (sums[edge[1:]] - sums[edge[:-1]]) ^ count.astype(np.uint64)


def _sketched(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row (key, r, x: hash of the text, s and s2: 128 bits of hash of its words, n: words, values, words)."""
    t = text_or_empty(text)
    slim = docs.select(named(docs, key).alias("k"), F.monotonically_increasing_id().alias("r"), F.xxhash64(t).alias("x"), t.alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("t").to_pylist()
            for lo, hi in steps(texts, STEP):
                some = b.slice(lo, hi - lo)
                words, count = words_of(texts[lo:hi])
                values = np.hstack([sketch(words, count), sketch(words, count, SHORT_K, SHORT_SKETCHES)])
                values = [np.concatenate([v, d]) for v, d in zip(values, deletion_keys(words, count))]
                edge = offsets(count)
                same = [np.where(count > 0, _sum(words, count, seed), some.column("x").to_numpy().view(np.uint64)) for seed in (303, 505)]
                short = (words >> np.uint64(32)).astype("<u4").tobytes()
                flat = pa.ListArray.from_arrays(pa.array(offsets(np.array([len(v) for v in values])), pa.int32()), pa.array(np.concatenate(values).view(np.int64)))
                yield pa.record_batch(
                    [some.column("k"), some.column("r"), some.column("x"), *[pa.array(x.view(np.int64)) for x in same], pa.array(count), flat, pa.array([short[4 * x : 4 * y] for x, y in zip(edge[:-1].tolist(), edge[1:].tolist())], pa.binary())],
                    ["k", "r", "x", "s", "s2", "n", "values", "words"],
                )

    made = map_arrow(slim, run, f"k {slim.schema['k'].dataType.simpleString()}, r long, x long, s long, s2 long, n long, values array<long>, words binary")
    return scratch_table(made, "sketched")


def _distances(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distance of each pair, or -1 where it is above the limit, and the limit."""
    limit = np.floor(np.array([max(len(x), len(y)) for x, y in zip(left, right)]) * (1 - SIMILARITY) + 1e-9).astype(np.int64)
    return distances(list(zip(left, right)), limit), limit


def _verify(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """pairs (r, head): adds `near` and `low`, the distance or, of pairs that are not
    near, a lower bound. Only the words of rows of some pair are moved, those of about as
    many pairs as there are rows at a time."""
    spark = pairs.sparkSession
    pairs = scratch_table(pairs, "pairs")
    held = pairs.count()
    words, copy = rows.select("r", "words"), None
    if held > FEW:  # fewer are looked up in the table of all rows
        some = pairs.select("r").union(pairs.select("head")).distinct()
        words = copy = scratch_table(words.join(some, "r", "left_semi"), "words")
        free_shuffles(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                some = b.slice(lo, 512)
                left, right = ([np.frombuffer(x, "<u4") for x in some.column(c).to_pylist()] for c in ("words", "other"))
                got, limit = _distances(left, right)
                low = [d if d >= 0 else max(m + 1, max(len(x), len(y)) - _common(x, y)) for d, m, x, y in zip(got.tolist(), limit.tolist(), left, right)]
                yield pa.record_batch([some.column("r"), some.column("head"), pa.array(got >= 0), pa.array(low, pa.int64())], ["r", "head", "near", "low"])

    parts = -(-held // max(1, rows.count()))
    done = []
    for i in range(max(1, parts)):
        part = pairs if parts <= 1 else pairs.filter(F.pmod(F.xxhash64("r", "head"), F.lit(parts)) == i)
        # few pairs go to the words, so that only the way to the head's words is a shuffle; other words stay
        few = F.broadcast if held <= FEW * max(1, parts) else lambda df: df
        other = words.join(few(part.select(F.col("head").alias("r")).distinct()), "r", "left_semi")
        both = words.join(few(part), "r").join(other.select(F.col("r").alias("head"), F.col("words").alias("other")), "head")
        done.append(scratch_table(map_arrow(both.select("r", "head", "words", "other"), run, "r long, head long, near boolean, low long"), "checked"))
        free_shuffles(spark)
    drop_tables(pairs, *[copy] * (copy is not None))
    return functools.reduce(DataFrame.unionByName, done)


#: The edits that texts of n and m words may have.
LIMIT = f"CAST(floor(greatest(n, m) * {1 - SIMILARITY} + 1e-9) AS LONG)"


def links(rows: DataFrame, reps: DataFrame, drop: bool = False) -> DataFrame:
    """reps: one (r, n, values) for each different text; rows: (r, words). Verified (r, head).
    drop: reps is a scratch table that is deleted as soon as its buckets are known."""
    # A bucket's rows carry the text's number and the sketch's in one value.
    start = reps.filter("n > 0").select("r", F.posexplode("values").alias("i", "v"))
    bucket = start.select(F.xxhash64(F.least("i", F.lit(VALUES)), "v").alias("b"), (F.shiftleft("r", PLACES) + F.col("i")).alias("ri"))
    size = reps.select("r", "n")
    found = None

    def check(pairs: DataFrame) -> None:
        """Verifies the pairs (r, head) that are not yet found."""
        nonlocal found
        pairs = pairs.select(F.greatest("r", "head").alias("r"), F.least("r", "head").alias("head")).distinct()
        if found is not None:
            pairs = pairs.join(found, ["r", "head"], "left_anti")
        checked = _verify(pairs, rows)
        found = checked if found is None else found.unionByName(checked)

    heads = scratch_table(bucket.groupBy("b").agg(F.min("ri").alias("first"), F.count("*").alias("held")).filter("held > 1"), "heads")
    free_shuffles(reps.sparkSession)
    members = bucket.join(heads, "b").select("b", F.shiftright("ri", PLACES).alias("r"), F.shiftright("first", PLACES).alias("head"), "held").filter("r <> head")
    members = scratch_table(members.join(size, "r").join(size.toDF("head", "m"), "head"), "members")
    drop_tables(heads, *[reps] * drop)
    free_shuffles(reps.sparkSession)
    if members.isEmpty():
        return reps.sparkSession.createDataFrame([], "r long, head long")
    check(members.filter(f"abs(n - m) <= {LIMIT}").select("r", "head"))
    low = F.coalesce("low", F.expr(f"greatest(abs(n - m), {LIMIT} + 1)"))
    state = members.join(found, ["r", "head"], "left").select("b", "r", "n", "held", F.coalesce("near", F.lit(False)).alias("near"), low.alias("low"))
    state = scratch_table(state, "state")
    drop_tables(members)
    free_shuffles(reps.sparkSession)
    rest = state.filter("NOT near")
    # A row that is not near the head may be near the rows that are, unless the
    # head is farther from it than both limits: most are ruled out by the farthest.
    near = state.filter("near").select("b", F.col("r").alias("head"), F.col("n").alias("m"), F.col("low").alias("far"))
    farthest = near.groupBy("b").agg(F.max("far").alias("farthest"))
    reach = rest.join(farthest, "b").filter(f"low - farthest <= floor(n * {(1 - SIMILARITY) / SIMILARITY} + 1e-9)").select("b", "r", "n", "low", "held")
    others = reach.filter(f"held <= {SMALL}").join(near, "b").filter(f"r <> head AND abs(n - m) <= {LIMIT} AND low - far <= {LIMIT}").select("r", "head")
    small = rest.filter(f"held <= {SMALL}").select("b", "r", "n")
    within = small.join(small.toDF("b", "head", "m"), "b").filter(f"head < r AND abs(n - m) <= {LIMIT}").select("r", "head")
    check(others.union(within))
    large = scratch_table(rest.filter(f"held > {SMALL}").select("b", "r", "n", "held"), "large")
    if not large.isEmpty():
        between = reach.select("b", "r", "n", "held", F.lit(0).alias("root")).union(state.filter("near").select("b", "r", "n", "held", F.lit(1).alias("root")))
        found = found.unionByName(_within(between.filter(f"held > {SMALL}"), rows))
    drop_tables(state)
    if not large.isEmpty():
        label = components(found.filter("near").select("r", "head"))
        left = large.join(label, "r", "left").select("b", "r", "n", "held", F.coalesce("root", "r").alias("root"))
        found = found.unionByName(_within(left.filter(f"held <= {HUGE}"), rows))
        huge = left.filter(f"held > {HUGE}").select("r", "root").distinct()
        if not huge.isEmpty():
            check(_sharing(huge, rows))
    drop_tables(large)
    return found.filter("near").select("r", "head").distinct()


def labelled(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of a text's words, each with how often it has occurred before."""
    mix, at = splitmix(2, 606), np.arange(len(words))
    order = np.argsort(words, kind="stable")
    new = np.concatenate([[True], words[order][1:] != words[order][:-1]])[: len(words)]
    seen = np.zeros(len(words), np.uint64)
    seen[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    h = (words.astype(np.uint64) + seen * mix[0]) * mix[1]
    return h ^ (h >> np.uint64(29))


def word_maps(words: np.ndarray) -> bytes:
    """Two bit maps of one size, a power of two: of a text's words and of its runs of
    two words, each with how often it has occurred before."""
    bits = 1 << max(6, (MAP_BITS * len(words) - 1).bit_length())
    out = np.zeros((2, bits), bool)
    for flags, x in zip(out, (words, (words[:-1].astype(np.uint64) << np.uint64(32)) | words[1:])):
        flags[(labelled(x) % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(out, axis=1, bitorder="little").tobytes()


def may_be_near(n: np.ndarray, maps: list[bytes], differ: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The places of the pairs of texts (n words each) that differ in each of `differ`
    and may be near: d edits take at most d words from a text and at most 2 d of its
    runs of two, so that no more bits of its maps are missing in the other's.
    A larger map is folded to the size of the smaller (near texts' are at most twice as large)."""
    size = np.array([len(x) for x in maps])
    held, out = {}, [(np.zeros(0, np.int64),) * 2]
    for s in np.unique(size).tolist():
        at = np.flatnonzero(size == s)
        at = at[np.argsort(n[at], kind="stable")]
        held[s] = at, np.frombuffer(b"".join(maps[i] for i in at.tolist()), "<u8").reshape(len(at), 2, -1)
    for s, (at, own) in held.items():
        out += _map_pairs(n, differ, at, own, at, own)
        if 2 * s in held:
            more, wide = held[2 * s]
            out += _map_pairs(n, differ, at, own, more, wide[:, :, : s // 16] | wide[:, :, s // 16 :])
    return tuple(np.concatenate(x) for x in zip(*out))


def _map_pairs(n: np.ndarray, differ: list[np.ndarray], at: np.ndarray, own: np.ndarray, more: np.ndarray, other: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The pairs of a row of `at` and a row of `more`, both by length; of the same rows each pair once."""
    out, wide, same = [], own.shape[2], at is more
    has, had = (np.bitwise_count(x).sum(axis=2, dtype=np.int32) for x in (own, other))
    limit = np.floor(n[more] * (1 - SIMILARITY) + 1e-9).astype(np.int64)
    step = max(1, min(64, CELLS // wide))
    reach = n[more] - limit  # grows with the length
    for lo in range(0, len(at), step):
        hi = min(lo + step, len(at))
        upto = int(np.searchsorted(reach, n[at[hi - 1]], "right"))
        across = max(1, CELLS // (step * wide))
        for left in range(lo + 1 if same else 0, upto, across):
            right = min(left + across, upto)
            common = np.bitwise_count(own[lo:hi, None, 0] & other[None, left:right, 0]).sum(axis=2, dtype=np.int32)
            may = np.maximum(has[lo:hi, None, 0], had[None, left:right, 0]) - common <= limit[left:right]
            may &= n[at[lo:hi], None] >= reach[left:right]
            if same:
                may &= np.arange(lo, hi)[:, None] < np.arange(left, right)
            for x in differ:
                may &= x[at[lo:hi], None] != x[more[left:right]]
            i, j = np.nonzero(may)
            i, j = i + lo, j + left
            for some in np.array_split(np.arange(len(i)), -(-len(i) * wide // CELLS) or 1):
                a, b = i[some], j[some]
                common = np.bitwise_count(own[a, 1] & other[b, 1]).sum(axis=1, dtype=np.int32)
                keep = np.maximum(has[a, 1], had[b, 1]) - common <= 2 * limit[b]
                out.append((at[a[keep]], more[b[keep]]))
    return out


def meets_elsewhere(pair: tuple[np.ndarray, np.ndarray], r: np.ndarray, buckets: list[np.ndarray], roots: list[np.ndarray], b: int) -> np.ndarray:
    """Whether another bucket than b is the one that compares a pair of rows (their places, i and j).
    buckets, roots: of each row, all that it is compared in, and as what. Of the buckets
    where the roots differ a hash of the pair takes one, so that the work of rows that meet often is spread."""
    (i, j), mix = pair, splitmix(2, 808)
    held = np.array([len(x) for x in buckets])
    out, wide = np.zeros(len(i), bool), int(held.max(initial=0))
    if wide < 2:
        return out
    bucket, root = np.zeros((len(held), wide), np.uint64), np.zeros((len(held), wide), np.int64)
    real = np.arange(wide) < held[:, None]
    bucket[real], root[real] = np.concatenate(buckets).view(np.uint64), np.concatenate(roots)
    some = np.flatnonzero((held[i] > 1) & (held[j] > 1))
    for part in np.array_split(some, -(-len(some) * wide * wide // CELLS) or 1):
        x, y = i[part], j[part]
        salt = ((r[x] + r[y]).astype(np.uint64) * mix[0])[:, None]
        before = (bucket[x] ^ salt) * mix[1] < (np.array(b, np.int64).view(np.uint64) ^ salt) * mix[1]
        meet = (bucket[x, :, None] == bucket[y, None, :]) & (root[x, :, None] != root[y, None, :])
        meet &= (before & real[x])[:, :, None] & real[y, None, :]
        out[part] = meet.any(axis=(1, 2))
    return out


def _within(left: DataFrame, rows: DataFrame) -> DataFrame:
    """left: rows (b, r, n: words, held: rows of the bucket, root) of buckets.
    The near pairs (r, head, near, low: distance) of one bucket and different roots: bit maps
    rule out most of the others (see may_be_near), what is left is verified in one of the
    buckets where it meets. A task holds two blocks of a bucket at most; about as many rows as there are
    texts are dealt at a time."""
    spark = left.sparkSession
    mixed = left.groupBy("b").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.sum("n").alias("sum")).filter("lo < hi").select("b", "sum")
    left = left.join(mixed, "b").withColumn("blocks", F.expr(f"CAST(ceil(greatest(held / {BLOCK}, sum / {BLOCK_WORDS})) AS INT)"))
    left = scratch_table(left.select("b", "r", F.col("root").cast("long").alias("root"), "blocks"), "left")
    free_shuffles(spark)

    def compare(key: tuple, block: pa.Table) -> pa.Table:
        r, root, part = (block.column(c).to_numpy() for c in ("r", "root", "part"))
        texts = [np.frombuffer(x, "<u4") for x in block.column("words").to_pylist()]
        buckets, roots = ([np.asarray(x, np.int64) for x in block.column(c).to_pylist()] for c in ("buckets", "roots"))
        i, j = may_be_near(np.array([len(x) for x in texts], np.int64), [word_maps(x) for x in texts], [root] if key[1] == key[2] else [root, part])
        new = ~meets_elsewhere((i, j), r, buckets, roots, key[0].as_py())
        i, j = i[new], j[new]
        out = [np.zeros(0, np.int64)]
        for lo in range(0, len(i), 512):
            out.append(_distances([texts[x] for x in i[lo : lo + 512].tolist()], [texts[x] for x in j[lo : lo + 512].tolist()])[0])
        low = np.concatenate(out)
        near = low >= 0
        i, j, low = i[near], j[near], low[near]
        return pa.table({"r": np.maximum(r[i], r[j]), "head": np.minimum(r[i], r[j]), "near": np.ones(len(i), bool), "low": low})

    # the pairs of blocks: each row goes to those that its block is one of
    dealt = left.withColumn("part", F.expr("CAST(pmod(xxhash64(r), blocks) AS INT)")).withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("b", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "part", "r", "root")
    where = left.groupBy("r").agg(F.collect_list(F.struct("b", "root")).alias("w")).select("r", F.col("w.b").alias("buckets"), F.col("w.root").alias("roots"))
    total = left.agg(F.sum("blocks")).first()[0] or 0
    parts = max(1, -(-total // max(1, rows.count())))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # as many: the bytes of a bucket don't tell its work
    few = F.broadcast if total <= FEW * parts else lambda df: df  # few rows go to the words, so that the words move once
    words, copy = few(where).join(rows.select("r", "words"), "r"), None
    if total > FEW * parts or parts > 1:
        words = copy = scratch_table(words, "words")
        free_shuffles(spark)
    done = []
    for i in range(parts):
        part = few(dealt.filter(F.pmod("b", F.lit(parts)) == i)).join(words, "r").repartition(tasks, "b", "i", "j")
        done.append(scratch_table(part.groupBy("b", "i", "j").applyInArrow(compare, "r long, head long, near boolean, low long"), "within"))
        free_shuffles(spark)
    drop_tables(left, *[copy] * (copy is not None))
    return functools.reduce(DataFrame.unionByName, done)


def _grams(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of a text's runs of GRAM words."""
    mix, n = splitmix(GRAM + 1, 707), max(0, len(words) - GRAM + 1)
    h = np.zeros(n, np.uint64)
    for j in range(GRAM):
        h = (h ^ words[j : j + n].astype(np.uint64)) * mix[j]
        h ^= h >> np.uint64(29)
    return h * mix[GRAM]


def _values(words: np.ndarray) -> np.ndarray:
    """What the texts are joined by: runs of GRAM words, and words of texts too short for them."""
    out = labelled(words) if len(words) < WORDS_BELOW else np.zeros(0, np.uint64)
    return np.concatenate([out, _grams(words)]) if len(words) >= GRAMS_FROM else out


def _hits(places: np.ndarray) -> int:
    """The least words that hit all runs at these places: each that isn't hit yet is hit at its last word."""
    hits = free = 0
    for p in places.tolist():
        if p >= free:
            hits, free = hits + 1, p + GRAM
    return hits


def _enough(rank: list[np.ndarray], need: np.ndarray) -> np.ndarray:
    """For each text (the ranks of its runs, by place) the least number of ranks
    whose runs can't all be hit by fewer than `need` words."""
    lo, hi = np.ones(len(rank), np.int64), np.array([int(x.max()) + 1 for x in rank])
    if len(rank) < 16:  # a few long texts, each by itself
        return np.array([bisect.bisect_left(range(b), n, 1, key=lambda upto: _hits(np.flatnonzero(x < upto))) for x, n, b in zip(rank, need.tolist(), hi.tolist())])
    at = np.full((max(map(len, rank)), len(rank)), np.iinfo(np.int32).max, np.int32)
    for i, x in enumerate(rank):
        at[: len(x), i] = x
    while (lo < hi).any():
        mid = (lo + hi) // 2
        hits, free = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for i, row in enumerate(at < mid):  # as in _hits
            hit = row & (free <= i)
            hits += hit
            free[hit] = i + GRAM
        done = hits >= need
        hi = np.where(done, mid, hi)
        lo = np.where(done, lo, np.minimum(mid + 1, hi))
    return hi


def first_values(texts: list[np.ndarray], often: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """The values of each text that come first, the rarest first, with the first and
    the last place of each (-1: anywhere) and how often it is there. A text of n words is
    within e = n (1 - SIMILARITY) / SIMILARITY edits of all that are near it, and
    no e words hit all its first runs. So of two near texts, d edits apart, the one whose
    last value comes first keeps e + 1 - d of those runs, and the other has them
    among its first values, at places no farther apart than the edits."""
    out = [(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3) for _ in texts]

    def order(h: np.ndarray) -> np.ndarray:
        return np.lexsort((h, often[(h % np.uint64(COUNTERS)).astype(np.int64)]))

    todo = []
    for i, x in enumerate(texts):
        if 0 < len(x) < WORDS_BELOW:
            h = labelled(x)
            h = h[order(h)[: int((1 - SIMILARITY) * len(h) + 1e-9) + 1]]
            out[i] = h, np.full(len(h), -1), np.full(len(h), -1), np.full(len(h), ALWAYS)
        if len(x) >= GRAMS_FROM:
            kinds, which = np.unique(_grams(x), return_inverse=True)
            place = np.empty(len(kinds), np.int32)
            place[order(kinds)] = np.arange(len(kinds), dtype=np.int32)
            todo.append((i, kinds, place, place[which]))
    todo.sort(key=lambda t: len(t[3]))
    while todo:
        take = [todo.pop()]
        while todo and (len(take) + 1) * len(take[0][3]) <= WIDE:
            take.append(todo.pop())
        need = np.array([int(len(texts[i]) * (1 - SIMILARITY) / SIMILARITY + 1e-9) + 1 for i, *_ in take])
        for (i, kinds, place, rank), upto in zip(take, _enough([t[3] for t in take], need).tolist()):
            by = np.argsort(rank, kind="stable")
            count = np.bincount(rank)[:upto]
            edge = offsets(count)
            new = kinds[np.argsort(place)[:upto]], by[edge[:-1]], by[edge[1:] - 1], count
            out[i] = tuple(np.concatenate(x) for x in zip(out[i], new))
    return out


def _sharing(some: DataFrame, rows: DataFrame) -> DataFrame:
    """Candidates (r, head) among some (r, root), rows of one root left out: every near
    pair is one (see first_values)."""
    few = F.broadcast if some.count() <= FEW else lambda df: df
    held = scratch_table(rows.join(few(some), "r").select("r", "root", "words"), "held")
    free_shuffles(some.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for x in b.column("words").to_pylist():
                np.add.at(total, (_values(np.frombuffer(x, "<u4")) % np.uint64(COUNTERS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["at", "c"])

    counted = map_arrow(held.select("words"), count, "at long, c long").groupBy("at").agg(F.sum("c").alias("c"))
    often = np.zeros(COUNTERS, np.int64)
    for r in counted.collect():  # COUNTERS rows at most
        often[r["at"]] = r["c"]
    often = some.sparkSession.sparkContext.broadcast(often)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [np.frombuffer(x, "<u4") for x in part.column("words").to_pylist()]
                found = first_values(texts, often.value)
                each = np.repeat(np.arange(part.num_rows), [len(x[0]) for x in found])
                sizes = pa.array(np.array([len(x) for x in texts], np.int32))
                g, *places = (np.concatenate(x) for x in zip(*found))
                yield pa.record_batch([pa.array(g.view(np.int64)), part.column("r").take(each), part.column("root").take(each), sizes.take(each), *[pa.array(x.astype(np.int32)) for x in places]], ["g", "r", "root", "n", "at", "upto", "c"])

    each = scratch_table(map_arrow(held, rarest, "g long, r long, root long, n int, at int, upto int, c int"), "rarest")
    drop_tables(held)
    shared = each.join(each.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("g"), "g", "left_semi")
    shared = scratch_table(shared, "shared")
    drop_tables(each)
    free_shuffles(some.sparkSession)
    # words before a common run are added or removed at least as often as its place moves, those after it as the rest does
    moved = f"abs(n - m) + 2 * greatest(0, at - last - greatest(0, n - m), least(0, n - m) - (upto - place)) <= {LIMIT}"
    # by roots first: the rows of one root, which may be most of a value's rows, never meet
    kinds = shared.groupBy("g", "root").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    apart = kinds.join(kinds.toDF("g", "other", "least", "most"), "g").filter(f"root < other AND lo - most <= floor(lo * {1 - SIMILARITY} + 1e-9) AND least - hi <= floor(least * {1 - SIMILARITY} + 1e-9)").select("g", "root", "other")
    both = apart.join(shared, ["g", "root"]).join(shared.toDF("g", "head", "other", "m", "place", "last", "d"), ["g", "other"]).filter(moved)
    both = both.groupBy("r", "head", "n", "m").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    kept = " OR ".join(f"{c} > floor({n} * {(1 - SIMILARITY) / SIMILARITY} + 1e-9) - {LIMIT}" for c, n in (("c", "n"), ("d", "m")))
    pairs = scratch_table(both.filter(kept).select(F.greatest("r", "head").alias("r"), F.least("r", "head").alias("head")), "sharing")
    drop_tables(shared)
    free_shuffles(some.sparkSession)
    often.unpersist()
    return pairs


def components(edges: DataFrame) -> DataFrame:
    """edges (r, head) with head < r: (r, root) for every node that has one, root the least node.
    Each turn hangs every root under the least of its lesser neighbours and joins the
    trees, so that at least every second turn halves the roots; edges within a tree are
    gone then, and those between the same trees are one. Written tables cut the lineage."""
    left, label = scratch_table(edges.select(F.col("r").alias("x"), F.col("head").alias("y")).distinct(), "edges"), None
    while True:
        lower = scratch_table(left.groupBy("x").agg(F.min("y").alias("y")), "lower")
        if label is not None and lower.isEmpty():
            return label
        while True:  # every way up is halved until all end at a root
            up = lower.select(F.col("x").alias("y"), F.col("y").alias("above"))
            if lower.join(up, "y", "left_semi").isEmpty():
                break
            lower = scratch_table(lower.join(up, "y", "left").select("x", F.coalesce("above", "y").alias("y")), "lower")
        root = lambda c: lower.select(F.col("x").alias(c), F.col("y").alias(f"{c}_root"))
        seen = left.join(root("x"), "x", "left").join(root("y"), "y", "left").select(F.coalesce("x_root", "x").alias("x"), F.coalesce("y_root", "y").alias("y"))
        left = scratch_table(seen.filter("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "edges")
        hung = lower.toDF("r", "root")
        if label is not None:  # what hung before hangs under its root's root
            above = lower.toDF("root", "above")
            hung = label.join(above, "root", "left").select("r", F.coalesce("above", "root").alias("root")).union(hung)
        label = scratch_table(hung, "label")


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: key, class_id (the least key of its class, nulls
    last), class_size, n_links (verified links of its text), kept, and x, the hash
    of its text. One row of each class is kept: that of class_id."""
    rows = _sketched(docs, key, text)
    same = ["s", "s2", "n"]
    one = scratch_table(rows.groupBy(*same).agg(F.min("r").alias("rep"), F.count("*").alias("copies"), F.min(F.struct(F.col("k").isNull().alias("gone"), "k", "r")).alias("first")), "one")
    reps = scratch_table(rows.select("r", "n", "values").join(one.select(F.col("rep").alias("r")), "r", "left_semi"), "reps")
    free_shuffles(docs.sparkSession)
    edges = scratch_table(links(rows.select("r", "words"), reps, drop=True), "links")
    label = components(edges)
    degree = edges.select(F.explode(F.array("r", "head")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    text_class = one.join(label.withColumnRenamed("r", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep")).join(degree, "rep", "left")
    group = text_class.groupBy("root").agg(F.sum("copies").alias("class_size"), F.min("first").alias("first"))
    known = text_class.select(*same, "root", F.coalesce("n_links", F.lit(0)).alias("n_links")).join(group, "root")
    known = known.select(*same, "n_links", "class_size", F.col("first.k").alias("class_id"), F.col("first.r").alias("keep"))
    out = rows.select("k", "r", "x", *same).join(known, same)
    return out.select(F.col("k").alias(key), "class_id", "class_size", "n_links", (F.col("r") == F.col("keep")).alias("kept"), "x")


def drop_near(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that are not kept (rows of the same key and text go or stay together with one of them)."""
    found = near_classes(docs, key, text)
    found = scratch_table(found.toDF("k", *found.columns[1:]).select("k", "x", "kept"), "found")
    gone = found.groupBy("k", "x").agg(F.max("kept").alias("kept")).filter(~F.col("kept")).select("k", "x")
    x = F.xxhash64(text_or_empty(text))
    return docs.join(gone, named(docs, key).eqNullSafe(gone["k"]) & (x == gone["x"]), "left_anti")
