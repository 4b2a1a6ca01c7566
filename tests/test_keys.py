"""Composite keys: threshold sketches against brute force."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from tablelens.operators import pairs


def brute(rows, columns, max_size):
    keys = []
    for size in range(1, max_size + 1):
        for c in itertools.combinations(range(len(columns)), size):
            if any(set(k) <= set(c) for k in keys):
                continue
            tuples = [tuple(r[i] for i in c) for r in rows]
            if rows and len(set(tuples)) == len(rows) and not any(v is None for t in tuples for v in t):
                keys.append(c)
    return [[columns[i] for i in k] for k in keys]


def found(spark, rows, columns, max_size, **options):
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in columns)).repartition(3)
    return [r["key_columns"] for r in pairs.composite_keys(df, max_size, **options).collect()]


@pytest.mark.parametrize("seed", range(4))
def test_random_tables(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(pairs, "SKETCH_ROWS", 30)
    monkeypatch.setattr(pairs, "GROWTH", 3)
    if seed % 2:
        monkeypatch.setattr(pairs, "FEW", 0)  # no part is sent to all tasks
        monkeypatch.setattr(pairs, "KEY_CHUNK", 3)
    columns = [f"c{i}" for i in range(7)]
    widths = [2, 3, 5, 9, 17, 40, 200]
    rows = [tuple(rng.randrange(w) if rng.random() > 0.002 or w != 17 else None for w in widths) for _ in range(300)]
    assert found(spark, rows, columns, 4) == brute(rows, columns, 4)


def test_all_copies_of_a_row_and_an_empty_table(spark):
    assert found(spark, [(1, 2)] * 50, ["a", "b"], 2) == []
    df = spark.createDataFrame([], "a int, b int")
    assert pairs.composite_keys(df, 2).count() == 0
    assert pairs.composite_keys(df.select(), 2).count() == 0


def test_a_key_that_only_one_pair_of_rows_breaks(spark):
    """Sketches can't see it; all rows must be looked at."""
    rows = [(i // 100, i % 100, 7) for i in range(20_000)]
    assert found(spark, rows, ["a", "b", "c"], 3) == [["a", "b"]]
    rows[-1] = rows[0]
    assert found(spark, rows, ["a", "b", "c"], 3) == []


def test_a_hundred_columns(spark, monkeypatch):
    """Sets that no further column can lift to the row count are never listed."""
    rng = random.Random(1)
    columns = [f"c{i}" for i in range(100)]
    rows = [(i // 50, i % 50, *[rng.randrange(2) for _ in range(98)]) for i in range(5000)]
    listed = []
    sketches = pairs._sketches
    monkeypatch.setattr(pairs, "_sketches", lambda h, i, cands, t: listed.extend(cands) or sketches(h, i, cands, t))
    t = time.time()
    assert found(spark, rows, columns, 4) == [["c0", "c1"]]
    assert len(listed) < 500 and time.time() - t < 120


def test_a_job_shuffles_few_candidates_of_a_large_table(spark, monkeypatch):
    """However many candidates are left, a job groups about SHIPPED rows."""
    rng = random.Random(5)
    monkeypatch.setattr(pairs, "SKETCH_ROWS", 30)
    monkeypatch.setattr(pairs, "SHIPPED", 700)
    monkeypatch.setattr(pairs, "FEW", 0)
    columns = [f"c{i}" for i in range(6)]
    rows = [tuple(rng.randrange(w) for w in (30, 40, 50, 60, 70, 300)) for _ in range(300)]
    jobs, tuples = [], pairs._tuples
    monkeypatch.setattr(pairs, "_tuples", lambda h, i, sets: jobs.append(len(sets["own"])) or tuples(h, i, sets))
    verified = pairs._all_rows
    whole = []
    monkeypatch.setattr(pairs, "_all_rows", lambda h, i, cands: whole.append(len(cands)) or verified(h, i, cands))
    keys = found(spark, rows, columns, 3)
    assert keys == brute(rows, columns, 3) and len(keys) > 4
    assert max(whole) <= 2 and sum(whole) > 4


def test_halves_of_digests_that_collide(spark):
    """Tuples whose first halves are equal are told apart by the others."""
    rows = [(i // 10, i % 10) for i in range(100)]
    df = spark.createDataFrame(rows, "a int, b int")
    h = pairs._hashed(df, df.schema.fields, [0, 1])
    weak = h.select(*[(F.lit(0).cast("long") if c.startswith("a") else F.col(c)).alias(c) for c in h.columns])
    assert pairs._all_rows(weak, [0, 1], [(0, 1), (0,), (1,)]) == [True, False, False]


def test_the_table_is_read_a_few_times(spark, monkeypatch):
    """Sets of all sizes are looked for in one sample and verified together: however
    many there are, all rows are read for the counts, the sample, the parts and the repeated rows."""
    monkeypatch.setattr(pairs, "SKETCH_ROWS", 64)
    rng = random.Random(3)
    columns = [f"c{i}" for i in range(8)]
    rows = [(i // 4, *[rng.randrange(w) for w in (300, 60, 7, 40, 2000, 11, 3)]) for i in range(3000)]
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    schema = ", ".join(f"{c} int" for c in columns)
    df = spark.createDataFrame(rows, schema).repartition(3).mapInArrow(count, schema)
    keys = [r["key_columns"] for r in pairs.composite_keys(df, 4).collect()]
    assert keys == brute(rows, columns, 4) and {len(k) for k in keys} == {3, 4}
    assert read.value <= 10 * len(rows), read.value / len(rows)


@pytest.mark.parametrize("few, share", [(10**6, 1.0), (10**6, 1 / 16), (40, 1.0)])
def test_sets_are_verified_by_their_parts(spark, monkeypatch, few, share):
    """Also where digests come in many blocks and shares, and where a part turns out to repeat too much."""
    for name, value in {"SKETCH_ROWS": 20, "GROWTH": 4, "FEW": few, "SHARE": share, "PARTS": 2, "SORTED": 32, "MET": 50}.items():
        monkeypatch.setattr(pairs, name, value)
    rng = random.Random(few)
    columns = [f"c{i}" for i in range(6)]
    rows = [tuple(rng.randrange(w) for w in (400, 90, 30, 8, 4, 2)) for _ in range(500)]
    rows += [(7, 7, *r[2:]) for r in rows[:60]]  # a heavy tuple
    assert found(spark, rows, columns, 4) == brute(rows, columns, 4)


def test_repeated_digests(spark, monkeypatch):
    monkeypatch.setattr(pairs, "SORTED", 64)
    monkeypatch.setattr(pairs, "MET", 100)
    rows = [(i // 2 if i < 40 else i, 5 if i < 500 else i) for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(3)
    hashed = pairs._hashed(df, df.schema.fields, [0, 1])
    twice = pairs._repeated(hashed, [0, 1], len(rows), [(0,), (1,), (0, 1)]).collect()
    assert len({(r["part"], r["h1"]) for r in twice}) == len(twice)
    assert [sum(r["part"] == k for r in twice) for k in range(3)] == [20, 1, 20]
