import hashlib

import pytest
from helpers import documents, edge_docs, empty_docs

from tablelens.llm import fingerprints, queries


def edited(rows):
    rows = sorted(rows, key=lambda r: -r.doc_id)
    for i, r in enumerate(rows):
        n = len(r.text) // 3
        yield r, r.text[: len(r.text) - n] + rows[(i + 1) % len(rows)].text[:n], rows[(i + 1) % len(rows)].text


def shingles(text):
    w = text.strip(" ").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("size", [fingerprints.RANGE, 7, 1])
def test_query(spark, monkeypatch, size):
    monkeypatch.setattr(fingerprints, "RANGE", size)
    rows = {r.doc_id: r for r in queries.QUERIES["op8_scaled_sketch"](spark, "/root/testdata/sf0.001").collect()}
    docs = documents(spark).collect()
    assert len(rows) == len(docs)
    off = []
    for r, e, after in edited(docs):
        got = rows[r.doc_id]
        assert (got.n_chars, got.edited_sha256) == (len(r.text), hashlib.sha256(e.encode()).hexdigest())
        off.append(abs(got.near_edited - jaccard(r.text, e)))
        assert abs(got.near_next - jaccard(r.text, after)) < 0.25
    assert sum(off) / len(off) < 0.1
    by = {}
    for r in docs:
        assert by.setdefault(r.text, rows[r.doc_id].fingerprint) == rows[r.doc_id].fingerprint


def test_fingerprints_merge(spark):
    a, b = " ".join(f"a{i}" for i in range(300)), " ".join(f"b{i}" for i in range(2000))
    rows = spark.createDataFrame([(1, a), (2, b), (3, f"{a} {b}")], "doc_id long, text string")
    f = {r.doc_id: set(r.fingerprint) for r in fingerprints.fingerprints(rows).collect()}
    assert f[1] | f[2] <= f[3] and len(f[3] - f[1] - f[2]) <= 4  # only shingles across the joint are new
    most = (1 << 32) // fingerprints.SCALE
    assert all(x < most for x in f[3])


def test_edges(spark):
    rows = fingerprints.edited_pairs(edge_docs(spark)).collect()
    assert len(rows) == edge_docs(spark).count()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and r.fingerprint for r in rows)
    one = {r.doc_id: r for r in rows if r.doc_id}
    assert one[2].fingerprint == one[3].fingerprint == one[10].fingerprint and one[2].n_chars == 0
    assert one[11].edited_sha256 == hashlib.sha256(("x" * 6000 + "   ").encode()).hexdigest()
    assert fingerprints.edited_pairs(empty_docs(spark)).count() == 0
    single = spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")
    got = fingerprints.edited_pairs(single).collect()
    assert got[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and got[0].near_next == 1


def test_main_path_is_native(spark):
    plan = fingerprints.edited_pairs(documents(spark))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
    assert plan.count("Exchange hashpartitioning") <= 2
