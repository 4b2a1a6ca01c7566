import zlib
from collections import Counter, defaultdict

import pytest
from helpers import documents, edge_docs, empty_docs

from tablelens.llm import queries, sharding


def check(rows, texts, shards=16):
    assert Counter((str(r.doc_id), r.size, r.text_crc32) for r in rows) == Counter((str(k), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in texts)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert set(by) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    n = [len(by[s]) for s in range(shards)]
    return max(n) - min(n)


@pytest.mark.parametrize("cell", [sharding.ROWS, 3])
def test_query(spark, monkeypatch, cell):
    monkeypatch.setattr(sharding, "ROWS", cell)
    rows = queries.QUERIES["op10_bounded_ring"](spark, "/root/testdata/sf0.001").collect()
    assert check(rows, [(r.doc_id, r.text) for r in documents(spark).collect()]) <= 1
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_walk_is_one_key_at_a_time():
    """Keys of an arc in turn, arcs clockwise, one shard further in each round."""
    nodes = sharding.ring(5, 7)
    orders = sharding.clockwise(nodes)
    counts = {a: (a * 37) % 23 for a in range(len(orders))}
    n = sum(counts.values())
    bound = sharding.bounds(n, 5, 0.0)
    room, slots = list(bound), [0] * 5
    waiting, placed = [(a, i) for a in range(len(orders)) for i in range(counts[a])], {}
    for step in range(5):
        rest = []
        for a, i in waiting:
            s = orders[a][step]
            if room[s]:
                placed[a, i] = (s, slots[s])
                room[s] -= 1
                slots[s] += 1
            else:
                rest.append((a, i))
        waiting = rest
    assert not waiting
    runs = sharding.walk(counts, orders, bound)
    got = {(a, i): (x["s"], x["b"] + i - x["f"]) for a, rs in enumerate(runs) for x in rs for i in range(x["f"], x["t"])}
    assert got == placed


def test_equal_texts_stay_together_and_few_rows_move(spark):
    docs = documents(spark)
    at = lambda shards, e: {r.doc_id: r.shard for r in sharding.shard(docs, shards=shards, epsilon=e).collect()}
    a, b = at(16, 0.25), at(17, 0.25)
    assert max(Counter(a.values()).values()) <= 1.25 * len(a) / 16 + 1
    assert sum(a[k] != b[k] for k in a) < len(a) / 3
    texts = defaultdict(set)
    for r in docs.collect():
        texts[r.text].add(a[r.doc_id])
    assert sum(len(s) > 1 for s in texts.values()) <= 16


def test_one_text_may_be_a_third_of_all_rows(spark):
    docs = spark.range(900).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'the same', CAST(id AS STRING)) AS text")
    assert check(sharding.shard(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()]) <= 1


def test_edges(spark):
    docs = edge_docs(spark)
    assert check(sharding.shard(docs, shards=5).collect(), [(r.doc_id, r.text) for r in docs.collect()], 5) <= 1
    assert check(sharding.shard(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()]) <= 1
    assert sharding.shard(empty_docs(spark)).count() == 0


def test_main_path_is_native(spark):
    plan = sharding.shard(documents(spark))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
