import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from helpers import SF_SMALL, documents, edge_docs, empty_docs
from oracle_check import compare, duck
from pyspark.sql import functions as F

from tablelens.llm import queries, source_mix


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def filled(sizes, weights=source_mix.WEIGHTS):
    """Targets by sharing again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * sizes[s] if s in full else rest * weight[s] / open_ for s in names}
        above = {s for s in names if target[s] > 3 * sizes[s]}
        if not above:
            return target
        full |= above


def drawn(key, text):
    h = hashlib.md5(f"mix:{'' if key is None else key}:{hashlib.md5((text or '').encode()).hexdigest()}".encode()).hexdigest()
    return (int(h[:13], 16) + 0.5) / (1 << 52), int(h[13:26], 16) >> 2


def brute(docs, key="doc_id"):
    """(key, size, source_size, target, taken) of every row by sorting each source."""
    sources = defaultdict(list)
    for r in docs.collect():
        sources[r["source"]].append((r[key], r["text"]))
    sizes = {s: sum(size_of(t) for _, t in rows) for s, rows in sources.items()}
    target, out = filled(sizes) if sources else {}, []
    for s, rows in sources.items():
        expected = min(target[s] / sizes[s], 3.0) if sizes[s] else 0.0
        whole, chance = math.floor(expected), expected - math.floor(expected)
        need = target[s] - whole * sizes[s]
        taken = [whole] * len(rows)
        if chance:
            places = []
            for i, (k, t) in enumerate(rows):
                u, v = drawn(k, t)
                odds = u / (1 - u) / (chance / (1 - chance))
                places.append((math.floor(odds / (1 + odds) * (1 << 50)), v, i))
            order, gap, open_ = sorted(places), need, True
            rest = []
            for _, _, i in order:
                n = size_of(rows[i][1])
                open_ = open_ and n <= gap
                if open_:
                    taken[i] += 1
                    gap -= n
                else:
                    rest.append((n, i))
            tries = [x for x in rest if 0 < x[0] <= gap][: source_mix.FILL]
            for x in tries:
                if x[0] <= gap:
                    taken[x[1]] += 1
                    gap -= x[0]
                    rest.remove(x)
            near = [(n, j, i) for j, (n, i) in enumerate(rest) if n > gap and n - gap < gap]
            if near:
                taken[min(near)[2]] += 1
        out += [(str(k), size_of(t), sizes[s], round(target[s], 6), size_of(t) * c) for (k, t), c in zip(rows, taken)]
    return sorted(out)


def rows_of(found):
    found = found.toDF("key", *found.columns[1:])
    return sorted((str(r.key), r.size, r.source_size, round(r.target, 6), r.taken) for r in found.collect())


def test_query_is_its_sql(spark):
    key = "op13_pareto_mix"
    assert compare(spark, duck(SF_SMALL), key, queries.QUERIES[key], queries.ORACLES[key], SF_SMALL)["ok"]


def test_brute_force_and_law(spark):
    docs = documents(spark)
    found = rows_of(source_mix.shares(docs))
    assert found == brute(docs)
    assert all(taken <= 3 * size for _, size, _, _, taken in found)


@pytest.mark.parametrize("block", [1, 7])
def test_deep_histograms_and_many_sources(spark, monkeypatch, block):
    """Buckets within buckets, ties included, and joins where nothing is sent to all tasks."""
    monkeypatch.setattr(source_mix, "BLOCK", block)
    monkeypatch.setattr(source_mix, "FEW", 0)
    docs = spark.range(3000).selectExpr(
        "IF(id % 3 = 0, 0, id) AS doc_id", "repeat('w ', CAST(IF(id % 3 = 0, 4, 1 + id % 11) AS INT)) AS text", "IF(id % 3 = 0, 'hot', concat('s', id % 5)) AS source"
    )
    assert rows_of(source_mix.shares(docs)) == brute(docs)


def test_reruns_agree_whatever_the_partitions(spark):
    docs = documents(spark).drop("n_chars")
    assert rows_of(source_mix.shares(docs.repartition(7))) == rows_of(source_mix.shares(docs.coalesce(1)))


def test_edges(spark):
    docs = edge_docs(spark)
    assert rows_of(source_mix.shares(docs)) == brute(docs)
    assert source_mix.shares(empty_docs(spark)).count() == 0
    assert source_mix.mix(empty_docs(spark)).count() == 0
    assert source_mix.mix(docs).columns == docs.columns
    blank = docs.withColumn("text", F.lit(None).cast("string"))
    assert {r[4] for r in rows_of(source_mix.shares(blank))} == {0}
    odd = docs.selectExpr("CAST(doc_id AS STRING) AS `a.b`", "text", "source", "1 AS row", "2 AS size", "3 AS r")
    assert rows_of(source_mix.shares(odd, "a.b")) == brute(docs)


def test_the_mix_holds_the_copies(spark):
    docs = documents(spark)
    want = {int(k): taken // size for k, size, _, _, taken in rows_of(source_mix.shares(docs)) if size and taken}
    got = Counter(r.doc_id for r in source_mix.mix(docs).collect())
    assert {k: n for k, n in got.items() if k in want} == want


def test_odds_follow_the_documents_weights(spark):
    """Of two kinds of documents one is wanted three times as often."""
    docs = spark.range(8000).selectExpr("id AS doc_id", "concat('w ', id, ' x') AS text", "IF(id < 6000, 'a', 'b') AS source", "IF(id % 2 = 0, 0.25D, 0.75D) AS want")
    rows = source_mix.plan(source_mix.sized(docs, weight="want"), weights=(1, 3))
    sums = {(r.s, r.w): r.c for r in rows.groupBy("s", "w").agg(F.avg("copies").alias("c")).collect()}
    target = {r.s: (r.target, r.words) for r in rows.groupBy("s").agg(F.first("target").alias("target"), F.sum(F.col("size") * F.col("copies")).alias("words")).collect()}
    assert all(abs(words - wanted) <= 3 for wanted, words in target.values())
    assert abs(sums["a", 0.75] / sums["a", 0.25] - 3) < 0.3
    assert sums["b", 0.75] == 3 and sums["b", 0.25] > 2  # 3 at most


def test_each_source_comes_near_its_target(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = docs.select("doc_id", "source").join(source_mix.shares(docs), "doc_id")
    for r in sums.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("w")).collect():
        assert abs(r.w - r.t) <= 0.02 * r.t
