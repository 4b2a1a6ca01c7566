import hashlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import SF_SMALL, documents, edge_docs, empty_docs
from oracle_check import compare, duck

from tablelens.llm import exact_dedup, queries


def brute(docs):
    groups = defaultdict(list)
    for r in docs.collect():
        groups[r.text or ""].append(r.doc_id)
    out = []
    for text, keys in groups.items():
        keep = max((k for k in keys if k is not None), default=None)
        first = True
        for k in keys:
            kept = k == keep and first
            first = first and not kept
            out.append((str(k), str(keep), len(keys), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


def rows_of(found):
    return sorted((str(r.doc_id), str(r.keep), r.group_size, r.kept, r.digest) for r in found.collect())


def test_query_is_its_sql(spark):
    key = "op4_grace_dedup"
    assert compare(spark, duck(SF_SMALL), key, queries.QUERIES[key], queries.ORACLES[key], SF_SMALL)["ok"]


@pytest.mark.parametrize("limit", [None, 3000, 1])
def test_buckets_that_do_not_fit_are_partitioned_again(spark, monkeypatch, limit):
    if limit:
        monkeypatch.setattr(exact_dedup, "BUCKET_BYTES", limit)
    docs = documents(spark).limit(60) if limit == 1 else documents(spark)
    if limit == 1:
        monkeypatch.setattr(exact_dedup, "BUCKET_BYTES", 100_000)
        monkeypatch.setattr(exact_dedup, "FEW", 0)
    assert rows_of(exact_dedup.duplicates(docs)) == brute(docs)


def test_edges(spark):
    docs = edge_docs(spark)
    assert rows_of(exact_dedup.duplicates(docs)) == brute(docs)
    kept = exact_dedup.distinct(docs)
    assert kept.columns == docs.columns
    want = {r.text or "" for r in docs.collect()}
    got = [r.text or "" for r in kept.collect()]
    assert sorted(got) == sorted(want)
    assert {r.doc_id for r in kept.collect()} >= {4, 7, 8, 9, 10, 11}
    assert exact_dedup.duplicates(empty_docs(spark)).count() == 0
    assert exact_dedup.distinct(empty_docs(spark)).count() == 0


def test_table_compares_contents_when_hashes_are_equal():
    table = exact_dedup.ContentTable(8)
    words = [f"w{i % 40}".encode() for i in range(200)]
    h = np.full(200, 7, np.uint64)
    got = np.concatenate([table.add(h[:90], words[:90]), table.add(h[90:], words[90:])])
    assert [table.content[e] for e in got] == words
    assert len(table.content) == 40


def test_any_key_and_any_names(spark):
    """Text keys, dots in names, and columns named as the operator's own."""
    docs = spark.createDataFrame(
        [("k1", "a", 1, 2, 3), ("k3", "a", 1, 2, 3), (None, "a", 1, 2, 3), ("k2", None, 1, 2, 3), ("k20", "", 1, 2, 3)],
        "`a.b` string, text string, __null int, rest int, t int",
    )
    got = {r["a.b"]: (r["keep"], r["group_size"], r["kept"]) for r in exact_dedup.duplicates(docs, "a.b").collect()}
    assert got == {"k1": ("k3", 3, False), "k3": ("k3", 3, True), None: ("k3", 3, False), "k2": ("k20", 2, False), "k20": ("k20", 2, True)}
    kept = exact_dedup.distinct(docs, "a.b")
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [("k20", "", 1, 2, 3), ("k3", "a", 1, 2, 3)]


def test_one_text_repeated_is_passed_on_in_parts(spark, monkeypatch):
    """What a task holds is bounded by its rows, too, not by different texts alone."""
    monkeypatch.setattr(exact_dedup, "TASK_BYTES", 100_000)
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'same' AS text").coalesce(1)
    got = exact_dedup.duplicates(docs)
    assert got.count() == 20_000 and [(r.doc_id, r.group_size) for r in got.filter("kept").collect()] == [(19_999, 20_000)]
