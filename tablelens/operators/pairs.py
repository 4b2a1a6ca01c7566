"""Pass 3 (on request) — facts about pairs and tuples of columns.

* ``correlation``: Pearson ρ for every pair of numeric columns from a
  co-moment matrix of each task, pairwise-complete rows; a constant column
  yields NULL.
* ``composite_keys``: minimal column sets (up to ``max_size``) whose tuples
  are all distinct and never NULL. Sets grow by a column at a time (a superset
  of a key is never minimal), bounded by their distinct tuples, and are looked
  at on all rows of some values of their widest column (a tuple twice in those
  is twice in the table, so pruning is exact). The sets left over all sizes
  are verified together on the full table, by the few rows whose tuple in a part
  that many of them share comes twice. Only candidate ids — schema-sized —
  reach the driver.
"""

from __future__ import annotations

import gc
import functools
import heapq
import itertools
import json
import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.checkpoint import drop_tables, scratch_table
from ..functions.types import is_float_like, is_numeric, literal_rows
from .frequency import to_slot
from .scalars import col_ref

CORR_SCHEMA = T.StructType(
    [
        T.StructField("ordinal_a", T.IntegerType()),
        T.StructField("column_a", T.StringType()),
        T.StructField("ordinal_b", T.IntegerType()),
        T.StructField("column_b", T.StringType()),
        T.StructField("rho", T.DoubleType()),
        T.StructField("pairs", T.LongType()),
    ]
)

def numeric_columns(df: DataFrame) -> list[tuple[int, str]]:
    return [(i, f.name) for i, f in enumerate(df.schema.fields) if is_numeric(f.dataType)]


def _moments(p: int):
    """For mapInArrow over p columns of doubles: the task's co-moments, a row for each pair.

    Batches are numpy matrices. Columns with the same NULLs form a group; two
    groups are taken over the rows where both have values, shifted by their
    first row and centred, so that one matrix product gives all their pairs and
    constants give exact zeros. Batches are merged by the parallel formulas
    for means and sums of squares. Values that aren't finite are counted apart.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        n, bad = np.zeros((p, p)), np.zeros((p, p))
        mean, square, cross = np.zeros((p, p)), np.zeros((p, p)), np.zeros((p, p))
        low, high = np.full((p, p), np.inf), np.full((p, p), -np.inf)
        some, pending = False, []
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)
            there = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in b.columns], axis=1)
            some |= len(x) > 0
            finite = there & np.isfinite(x)
            both = there.astype(float)
            bad += both.T @ both - finite.astype(float).T @ finite
            groups: dict[bytes, list[int]] = {}
            for i in range(p):
                groups.setdefault(np.packbits(finite[:, i]).tobytes(), []).append(i)
            for one in groups.values():
                for other in groups.values():
                    rows = finite[:, one[0]] & finite[:, other[0]]
                    m = int(rows.sum())
                    if not m:
                        continue
                    left, right = x[np.ix_(rows, one)], x[np.ix_(rows, other)]
                    centred = []
                    for part in (left, right):
                        part = part - part[0]
                        centred.append(part - part.mean(axis=0))
                    at = np.ix_(one, other)
                    here = (left[0] + (left - left[0]).mean(axis=0))[:, None]  # of the left columns
                    there_ = (right[0] + (right - right[0]).mean(axis=0))[None, :]
                    total, before = n[at] + m, n[at]
                    dl, dr = here - mean[at], there_ - mean.T[at]
                    cross[at] += centred[0].T @ centred[1] + dl * dr * before * m / total
                    square[at] += (centred[0] ** 2).sum(axis=0)[:, None] + dl**2 * before * m / total
                    # both halves of `mean` are read above: the other half is another pair of groups' turn
                    new = mean[at] + dl * m / total
                    pending.append((at, new, total))
                    low[at] = np.minimum(low[at], left.min(axis=0)[:, None])
                    high[at] = np.maximum(high[at], left.max(axis=0)[:, None])
            for at, new, total in pending:
                mean[at], n[at] = new, total
            pending.clear()
        if some:
            i, j = np.triu_indices(p, 1)
            columns = {"n": n[i, j], "bad": bad[i, j], "cross": cross[i, j]}
            for name, (a, c) in {"x": (i, j), "y": (j, i)}.items():
                columns |= {f"m{name}": mean[a, c], f"s{name}": square[a, c], f"l{name}": low[a, c], f"h{name}": high[a, c]}
            yield pa.record_batch({"pair": np.arange(len(i), dtype=np.int32)} | columns)

    return run


def correlation(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Long form (ordinal_a, column_a, ordinal_b, column_b, rho, pairs), a < b.

    One scan: every task reduces its rows to a co-moment matrix (``_moments``),
    whatever the number of columns, and a row per pair and task is shuffled
    and merged.
    """
    nums = numeric_columns(df)
    if columns is not None:
        wanted = set(columns)
        nums = [p for p in nums if p[1] in wanted]
    pairs = list(itertools.combinations(nums, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], CORR_SCHEMA)
    names = ["n", "bad", "cross", *[f"{k}{v}" for v in "xy" for k in "mslh"]]
    base = df.select(*[col_ref(n).cast("double").alias(f"v{i}") for i, n in nums])
    parts = base.mapInArrow(_moments(len(nums)), "pair int, " + ", ".join(f"{c} double" for c in names))
    # a row for each task and pair: centred anew on the mean of all tasks
    of_pair = Window.partitionBy("pair")
    n = F.col("n")
    held = parts.select("*", *[F.try_divide(F.sum(n * F.col(f"m{v}")).over(of_pair), F.sum(n).over(of_pair)).alias(f"a{v}") for v in "xy"])
    dev = {v: F.col(f"m{v}") - F.col(f"a{v}") for v in "xy"}
    merged = held.groupBy("pair").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"),
        F.sum(F.col("cross") + n * dev["x"] * dev["y"]).alias("cross"),
        *[F.sum(F.col(f"s{v}") + n * dev[v] * dev[v]).alias(f"s{v}") for v in "xy"],
        *[(F.min(f"l{v}") < F.max(f"h{v}")).alias(f"varies_{v}") for v in "xy"],
    )
    rho = F.when(F.col("bad") > 0, F.lit(float("nan"))).when(
        F.col("varies_x") & F.col("varies_y"), F.try_divide(F.col("cross"), F.sqrt("sx") * F.sqrt("sy")))

    def lookup(values, dt):
        return F.element_at(F.array(*[F.lit(v).cast(dt) for v in values]), F.col("pair") + 1)

    return merged.select(
        lookup([p[0][0] for p in pairs], "int").alias("ordinal_a"),
        lookup([p[0][1] for p in pairs], "string").alias("column_a"),
        lookup([p[1][0] for p in pairs], "int").alias("ordinal_b"),
        lookup([p[1][1] for p in pairs], "string").alias("column_b"),
        rho.cast("double").alias("rho"),
        (F.col("n") + F.col("bad")).cast("bigint").alias("pairs"),
    )


# ---------------------------------------------------------------- composite keys

#: Rows of a base's first sample, about, how many times more the next one has, and how many there are.
SKETCH_ROWS, GROWTH, LOOKS = 1 << 13, 16, 2
#: The largest part of the rows that is sampled before all are looked at.
LAST = 0.5
#: Candidates of a job, and the rows (of all its candidates) that it shuffles, about: more only for one candidate.
KEY_CHUNK, SHIPPED = 4096, 1 << 24
#: Parts whose half digests a job shuffles (8 bytes a row and part), how many a task sorts before it deals
#: them out, and how many, about, meet in a group.
PARTS, SORTED, MET = 4, 1 << 18, 1 << 20
#: Rows, about, whose tuple in a part comes twice, and the largest share of all rows that they are; no more
#: such tuples are sent to all tasks (some 20 bytes each).
FEW, SHARE = 1_000_000, 1 / 16
#: Relative error of a single column's distinct count (of a sketch of 2 ** KEY_LOG2 counters).
KEY_RSD, KEY_LOG2 = 0.02, 12
#: Standard errors that an estimate is allowed to be off.
SURE = 6


def _key_value(c, dt: T.DataType):
    """A value as the frequency pass groups it (adding zero folds -0.0 into 0.0)."""
    v = to_slot(c, dt)
    return v + F.lit(0.0) if is_float_like(dt) else v


def _hashed(df: DataFrame, fields: list[T.StructField], idx: list[int]) -> DataFrame:
    """(a0, b0, a1, ...): two 64-bit hashes of each column's value, NULL for NULL. A job reads
    only the columns of its sets."""
    values = [(k, i, _key_value(col_ref(fields[i].name), fields[i].dataType)) for k, i in enumerate(idx)]
    return df.select(*[F.when(v.isNotNull(), F.xxhash64(F.lit(half), F.lit(i), v)).alias(f"{name}{k}")
                       for half, name in ((1, "a"), (2, "b")) for k, i, v in values])


def _column_counts(hashed: DataFrame, idx: list[int]) -> tuple[int, int, dict[int, int], dict[int, float]]:
    """Tasks that had rows, rows, each column's values that aren't NULL, and an
    upper bound of its distinct values: one scan, a HyperLogLog sketch a column in each task."""
    distinct = lambda c: F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(KEY_LOG2))), F.lit(0))
    got = hashed.withColumn("p", F.spark_partition_id()).agg(
        F.count(F.lit(1)).alias("n"), F.approx_count_distinct("p").alias("tasks"),
        F.array(*[F.count(f"a{k}") for k in range(len(idx))]).alias("present"),
        F.array(*[distinct(f"a{k}") for k in range(len(idx))]).alias("d")).first()  # one row
    n = got["n"]
    return got["tasks"], n, dict(zip(idx, got["present"])), {i: min(n, d * (1 + SURE * KEY_RSD) + 1) for i, d in zip(idx, got["d"])}


def _digest(idx: list[int], c: tuple[int, ...]) -> Column:
    """The first half of the digest of a row's tuple, as in ``_tuples``."""
    return functools.reduce(Column.bitwiseXOR, [F.col(f"a{idx.index(i)}") for i in c])


def _tuples(hashed: DataFrame, idx: list[int], sets: dict[str, list[tuple[int, ...]]]) -> DataFrame:
    """(cand, then h1 and h2 for each name): the tuples of every row for a list of
    column sets under each name, as 128-bit digests (different ones prove different tuples)."""
    return _tuples_of(hashed.withColumn("of", F.lit(0)), idx, sets, [0] * len(next(iter(sets.values()))))


def _tuples_of(rows: DataFrame, idx: list[int], sets: dict[str, list[tuple[int, ...]]], of: list[int]) -> DataFrame:
    """As ``_tuples``, for each row only the candidates whose number ``of`` is the row's."""
    used = sorted({i for cs in sets.values() for c in cs for i in c})
    # place 0 of the hashes is no column
    held = rows.select("of", *[F.array(F.lit(0).cast("long"), *[F.col(f"{name}{idx.index(i)}") for i in used]).alias(f"d{half}") for half, name in ((1, "a"), (2, "b"))])
    size = {name: max(map(len, cs)) for name, cs in sets.items()}
    lists: list[list[dict]] = [[] for _ in range(max(of) + 1)]
    for k, cs in enumerate(zip(*sets.values())):
        lists[of[k]].append({"cand": k} | {name: [used.index(i) + 1 for i in c] + [0] * (size[name] - len(c)) for name, c in zip(sets, cs)})
    listed = F.from_json(F.lit(json.dumps(lists)), f"array<array<struct<cand:int,{','.join(f'{name}:array<int>' for name in sets)}>>>")
    xor = lambda name, half: F.expr(" ^ ".join(f"d{half}[{name}[{j}]]" for j in range(size[name]))).alias(f"{name}_h{half}")
    return held.select("d1", "d2", F.inline(F.get(listed, F.col("of")))).select("cand", *[xor(name, half) for name in sets for half in (1, 2)])


def _parts_of(sets: list, rows: float) -> Iterator[list]:
    """The sets of one job after another, each of which groups about ``rows`` rows of every
    set: together no more than SHIPPED, or one set."""
    step = max(1, min(KEY_CHUNK, int(SHIPPED / max(1, rows))))
    for start in range(0, len(sets), step):
        yield sets[start : start + step]


def _freed(spark: SparkSession, rows: float) -> None:
    """Spark deletes the files of a shuffle when the driver no longer holds its plan, so
    after a job of many rows the plans go at once: disk is that of one job."""
    if rows >= SHIPPED / 8:
        gc.collect()
        spark._jvm.System.gc()


def _sketches(hashed: DataFrame, idx: list[int], cands: list[tuple[int, ...]], theta: float) -> dict[int, tuple[int, int]]:
    """For each candidate the distinct tuples whose digest lies below a fraction
    ``theta`` of its range, and how many of them occur twice.

    That sketch merges by union, its size is about ``theta`` times the distinct
    tuples, and as all copies of a tuple are in it or none, a tuple found
    twice proves that the candidate isn't a key. Only digests below the
    fraction leave a task.
    """
    out: dict[int, tuple[int, int]] = {}
    for start in range(0, len(cands), KEY_CHUNK):
        keyed = _tuples(hashed, idx, {"own": cands[start : start + KEY_CHUNK]})
        if theta < 1:
            keyed = keyed.where(F.col("own_h1").bitwiseAND(F.lit((1 << 63) - 1)) < int(theta * (1 << 63)))
        held = keyed.groupBy("cand", "own_h1", "own_h2").agg(F.count(F.lit(1)).alias("cnt"))
        for r in held.groupBy("cand").agg(F.count(F.lit(1)).alias("d"), F.count_if(F.col("cnt") > 1).alias("twice")).collect():  # one row per candidate
            out[start + r["cand"]] = (r["d"], r["twice"])
    return {k: out.get(k, (0, 0)) for k in range(len(cands))}


def _all_rows(hashed: DataFrame, idx: list[int], cands: list[tuple[int, ...]]) -> list[bool]:
    """Whether each candidate is a key, by grouping all rows: half digests that differ prove
    different tuples, so only these are shuffled. Where one comes twice, its
    rows' other halves are compared; a collision of the first halves is grouped by both."""
    halves = _tuples(hashed, idx, {"own": cands}).groupBy("cand", "own_h1").agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")
    twice = {r["cand"]: r["h"] for r in halves.groupBy("cand").agg(F.min("own_h1").alias("h")).collect()}  # one row per candidate
    if not twice:
        return [True] * len(cands)
    asked = sorted(twice)
    one = F.element_at(F.array(*[F.lit(twice[k]) for k in asked]), F.col("cand") + 1)
    same = _tuples(hashed, idx, {"own": [cands[k] for k in asked]}).where(F.col("own_h1") == one)
    same = same.groupBy("cand", "own_h1", "own_h2").agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1").select("cand").distinct()
    bad = {asked[r["cand"]] for r in same.collect()}
    unsure = [k for k in asked if k not in bad]
    if unsure:
        both = _sketches(hashed, idx, [cands[k] for k in unsure], 1.0)
        bad |= {k for j, k in enumerate(unsure) if both[j][1]}
    return [k not in bad for k in range(len(cands))]


def _sample(hashed: DataFrame, idx: list[int], bases: list[int], theta: float) -> DataFrame:
    """(hashes, of, spot): for each base column (its number: of) the rows whose value has its hash (the spot)
    below a fraction ``theta`` of the range, so all rows of a value or none. Two rows
    with the same tuple of a set that has the base are both in its sample or neither is."""
    below = F.lit(int(theta * (1 << 63)))
    spots = [F.col(f"a{idx.index(i)}").bitwiseAND(F.lit((1 << 63) - 1)) for i in bases]
    rows = hashed.where(functools.reduce(Column.__or__, [s < below for s in spots]))
    each = F.array(*[F.struct(F.lit(k).alias("of"), s.alias("spot")) for k, s in enumerate(spots)])
    return scratch_table(rows.select("*", F.inline(F.filter(each, lambda x: x["spot"] < below))), "sample")


def _seen_twice(sample: DataFrame, idx: list[int], cands: list[tuple[int, ...]], of: list[int], theta: float) -> dict[int, int]:
    """How many rows in the sample of each candidate's base (its number: of), up to ``theta``, have a
    tuple that comes twice there; candidates without one are left out."""
    keyed = _tuples_of(sample.where(F.col("spot") < F.lit(int(theta * (1 << 63)))), idx, {"own": cands}, of)
    held = keyed.groupBy("cand", "own_h1", "own_h2").agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")
    return {r["cand"]: r["rows"] for r in held.groupBy("cand").agg(F.sum("cnt").alias("rows")).collect()}  # one row per candidate


def _dealt(parts: int, shares: int):
    """For mapInArrow over a column of half digests for each part: blocks of digests, sorted,
    each of one of equal shares of their range. Of a digest that a block has more than twice, two go on."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bounds = np.array([(k << 64) // shares for k in range(1, shares)], np.uint64)

        def blocks(held):
            for p in range(parts):
                x = np.sort(np.concatenate([digests[p] for digests in held]))
                x = np.concatenate([x[:2], x[2:][x[2:] != x[:-2]]])
                cuts = [0, *np.searchsorted(x, bounds).tolist(), len(x)]
                some = [k for k in range(shares) if cuts[k] < cuts[k + 1]]
                yield pa.record_batch({
                    "part": pa.array([p] * len(some), pa.int32()), "share": pa.array(some, pa.int32()),
                    "digests": pa.array([x[cuts[k] : cuts[k + 1]].tobytes() for k in some], pa.binary())})

        held, rows = [], 0
        for b in batches:
            held.append([c.to_numpy(zero_copy_only=False).view(np.uint64) for c in b.columns])
            rows += b.num_rows
            if rows >= SORTED:
                yield from blocks(held)
                held, rows = [], 0
        if rows:
            yield from blocks(held)

    return run


def _met():
    """For applyInArrow over the blocks of a share: its digests that come twice."""

    def run(blocks):
        import numpy as np
        import pyarrow as pa

        x = np.sort(np.frombuffer(b"".join(blocks.column("digests").to_pylist()), np.int64))
        twice = np.unique(x[1:][x[1:] == x[:-1]])
        return pa.table({"part": np.full(len(twice), blocks.column("part")[0].as_py(), np.int32), "h1": twice})

    return run


def _repeated(hashed: DataFrame, idx: list[int], n: int, parts: list[tuple[int, ...]]) -> DataFrame:
    """(part, h1): the first halves of digests that come twice in each part's column set."""
    shares = -(-n // MET)
    blocks = hashed.select(*[_digest(idx, c).alias(f"d{k}") for k, c in enumerate(parts)]).mapInArrow(
        _dealt(len(parts), shares), "part int, share int, digests binary")
    dealt = blocks.repartition(max(hashed.sparkSession.sparkContext.defaultParallelism, len(parts) * shares // 8), "part", "share")
    return dealt.groupBy("part", "share").applyInArrow(_met(), "part int, h1 long")


def _cover(cands: list[tuple[int, ...]], repeats: dict[tuple[int, ...], float], few: float) -> list[tuple[int, ...]]:
    """Few parts of the candidates (or whole ones), each with fewer repeats than ``few``, so that as
    many candidates as can be have one: the part of most candidates left, again and again."""
    holders: dict[tuple[int, ...], set[tuple[int, ...]]] = {}
    for c in cands:
        for size in range(1, len(c) + 1):
            for p in itertools.combinations(c, size):
                if repeats.get(p, few) < few:
                    holders.setdefault(p, set()).add(c)
    heap = [(-len(of), repeats[p], p) for p, of in holders.items()]
    heapq.heapify(heap)
    left, parts = set(cands), []
    while heap:
        gain, cost, p = heapq.heappop(heap)
        now = len(left & holders[p])
        if now == -gain:
            parts.append(p)
            left -= holders[p]
        elif now:
            heapq.heappush(heap, (-now, cost, p))
    return parts


def _by_parts(hashed: DataFrame, idx: list[int], n: int, asked: dict[tuple[int, ...], list[tuple[int, ...]]], repeats: dict[tuple[int, ...], float]) -> dict[tuple[int, ...], bool]:
    """Whether the sets asked of each part are keys, by all rows. A tuple that comes twice does
    so in each part as well, so only rows are grouped whose tuple in the part comes
    twice. A part with more of them than FEW has its count put in ``repeats``, and its sets are left out."""
    fine: dict[tuple[int, ...], bool] = {}
    for start in range(0, len(asked), PARTS * PARTS):
        parts = list(asked)[start : start + PARTS * PARTS]
        tables, found = [], {}
        for lo in range(0, len(parts), PARTS):
            some = _repeated(hashed, idx, n, parts[lo : lo + PARTS])
            tables.append(scratch_table(some.withColumn("part", F.col("part") + lo), "twice"))
            found |= {r["part"]: r["count"] for r in tables[-1].groupBy("part").count().collect()}  # one row per part
            _freed(hashed.sparkSession, n * PARTS)
        repeats |= {parts[k]: count for k, count in found.items() if count > FEW}
        pulls: list[list[int]] = [[]]  # parts that together have no more than FEW
        for k in (k for k in range(len(parts)) if found.get(k, 0) <= FEW):
            if sum(found.get(x, 0) for x in (*pulls[-1], k)) > FEW:
                pulls.append([])
            pulls[-1].append(k)
        for few in pulls:
            gone: set[int] = set()
            sets = [(j, c) for j, k in enumerate(few) for c in asked[parts[k]]]
            if found.keys() & set(few):
                twice = functools.reduce(DataFrame.union, tables).where(F.col("part").isin(few)).select("h1")
                each = F.posexplode(F.array(*[_digest(idx, parts[k]) for k in few])).alias("of", "h1")
                rows = hashed.select("*", each).join(F.broadcast(twice), "h1", "left_semi")
                keyed = _tuples_of(rows, idx, {"own": [c for _, c in sets]}, [j for j, _ in sets])
                bad = keyed.groupBy("cand", "own_h1", "own_h2").agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1").select("cand").distinct()
                gone = {r["cand"] for r in bad.collect()}  # candidates only
            fine |= {c: k not in gone for k, (_, c) in enumerate(sets)}
        drop_tables(*tables)
    return fine


def composite_keys(df: DataFrame, max_size: int = 3, columns: list[str] | None = None) -> DataFrame:
    """Minimal keys of size 1..max_size: (key_columns, size), column names
    joined by ',' in schema order.

    Sets grow by a column at a time from those that are no key. A bound of the
    distinct tuples of each (products of what its parts have) drops the sets that
    no further columns can lift to the row count, so only few of all combinations
    are ever listed, and only sets that may be keys are looked at. Those are
    looked for in the sample of their widest column; sets without a tuple twice
    there are presumed keys. Those of all sizes are then verified on all
    rows, and where some turn out to be none, sets grow on from them.
    """
    fields = list(df.schema.fields)
    idx = [i for i, f in enumerate(fields) if columns is None or f.name in set(columns)]
    hashed = _hashed(df, fields, idx) if idx else df
    tasks, n, present, single = _column_counts(hashed, idx) if idx else (0, 0, {}, {})
    parallel = df.sparkSession.sparkContext.defaultParallelism
    if 2 * tasks < parallel and n > parallel:  # a source that can't be split leaves most cores idle
        hashed = scratch_table(hashed.repartition(parallel), "hashed")
    usable = [i for i in idx if present.get(i) == n]  # a column with a NULL is in no key
    widest = sorted(usable, key=lambda i: -single[i])
    bases = [i for k, i in enumerate(widest) if math.prod(single[j] for j in widest[k : k + max_size]) >= n]
    thetas = [t for t in (SKETCH_ROWS * GROWTH**k / max(1, n) for k in range(LOOKS)) if bases and t < LAST]
    # the next samples only where they stay small: a row has all hashes
    thetas = [t for k, t in enumerate(thetas) if not k or t * n * len(bases) * len(idx) <= SHIPPED * 8]
    sample = _sample(hashed, idx, bases, thetas[-1]) if thetas else None
    known: dict[tuple[int, ...], bool] = {}
    tight: dict[tuple[int, ...], float] = {}  # bounds of distinct tuples from sketches
    repeats: dict[tuple[int, ...], float] = {}  # estimates of the rows whose tuple comes twice, 0 where the samples have none

    def reaches(c: tuple[int, ...], bound: float) -> bool:
        """Whether the set may be part of a key."""
        for i in itertools.islice((i for i in widest if i not in c), max_size - len(c)):
            bound *= single[i]
        return bound >= n

    def look(cands: list[tuple[int, ...]]) -> None:
        """Sets with a tuple twice in a sample are no keys."""
        for theta in thetas:
            unseen = []
            for start in range(0, len(cands), KEY_CHUNK):
                some = cands[start : start + KEY_CHUNK]
                found = _seen_twice(sample, idx, some, [bases.index(min(c, key=widest.index)) for c in some], theta)
                known.update({some[k]: False for k in found})
                repeats.update({some[k]: twice / theta for k, twice in found.items()})
                unseen += [c for k, c in enumerate(some) if k not in found]
            cands = unseen
        if thetas:
            repeats.update(dict.fromkeys(cands, 0.0))

    def tighten(cands: list[tuple[int, ...]]) -> None:
        """Fewer sets grow from those that have fewer tuples than their bounds say."""
        theta = SKETCH_ROWS / n
        for some in _parts_of(cands, theta * n) if theta < LAST else ():
            for k, (d, _) in _sketches(hashed, idx, some, theta).items():
                tight[some[k]] = (d + SURE * math.sqrt(d) + SURE * SURE) / theta
            _freed(hashed.sparkSession, theta * n * len(some))

    def presumed() -> list[tuple[int, ...]]:
        """The smallest sets that aren't known to be no keys."""
        out: list[tuple[int, ...]] = []
        open_: dict[tuple[int, ...], float] = {(): 1.0}  # no keys, with bounds of their distinct tuples
        for size in range(1, max_size + 1 if n else 0):
            bounds: dict[tuple[int, ...], float] = {}
            for held in open_:
                for i in usable:
                    if held and i <= held[-1]:
                        continue
                    c = (*held, i)
                    parts = [open_.get(c[:k] + c[k + 1 :]) for k in range(len(c))]
                    if None in parts:  # a part is a key, or in none
                        continue
                    bounds[c] = min(tight.get(c, n * 2.0), *(b * single[c[k]] for k, b in enumerate(parts)))
            bounds = {c: b for c, b in bounds.items() if reaches(c, b)}
            look([c for c, b in bounds.items() if b >= n and c not in known and c not in repeats])
            found = [c for c, b in bounds.items() if b >= n and known.get(c, True)]
            out += found
            open_ = {c: b for c, b in bounds.items() if c not in set(found)}
            if size < max_size and len(open_) * len(usable) > KEY_CHUNK:
                tighten([c for c, b in open_.items() if b >= n and c not in tight])
                open_ = {c: t for c, b in open_.items() if reaches(c, t := min(b, tight.get(c, b)))}
        return out

    while asked := [c for c in presumed() if c not in known]:
        parts = _cover(asked, repeats, min(FEW, n * SHARE))
        of = {p: [c for c in asked if set(p) <= set(c)] for p in parts}
        rest = [c for c in asked if not any(set(p) <= set(c) for p in parts)]
        for p in parts:  # the rows at hand decide all sets that have the part
            more = [i for i in usable if i not in p]
            sizes = range(max_size - len(p) + 1)
            if sum(math.comb(len(more), size) for size in sizes) <= KEY_CHUNK:
                of[p] = [tuple(sorted((*p, *x))) for size in sizes for x in itertools.combinations(more, size)]
        known |= _by_parts(hashed, idx, n, of, repeats)
        for some in _parts_of(rest, n):
            known |= dict(zip(some, _all_rows(hashed, idx, some)))
            _freed(hashed.sparkSession, n * len(some))
    if sample is not None:
        drop_tables(sample)
    keys = sorted(presumed(), key=lambda c: (len(c), c))
    rows = [([fields[i].name for i in k], len(k)) for k in keys]
    return literal_rows(df.sparkSession, rows, "key_columns array<string>, size int")
