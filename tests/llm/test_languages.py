import zlib

import numpy as np
from helpers import documents, edge_docs, empty_docs

from tablelens.llm import languages, queries


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 8, 20):
        code = languages.codewords(n)
        assert code.shape[0] == n and len({tuple(c) for c in code.tolist()}) == n
        apart = min((code[a] != code[b]).sum() for a in range(n) for b in range(a))
        assert apart >= (2 ** (n - 2) if n <= languages.EXHAUSTIVE else 4)


def test_decoding_corrects_a_wrong_bit_and_flags_ambiguity():
    code = languages.codewords(4)
    model = languages.Model(list("abcd"), code, None, np.ones(7), np.zeros(7), np.ones(7))
    for c in range(4):
        for wrong in range(7):
            margin = 4.0 * code[c]
            margin[wrong] *= -0.5
            best, score, unsure = languages.decode(margin[None], model)
            assert best[0] == c and score[0] > 0.5 and not unsure[0]
    assert languages.decode(np.zeros((1, 7)), model)[2][0]


def test_grams_of_a_long_text_are_those_of_its_parts(monkeypatch):
    odds = np.random.default_rng(0).normal(size=(languages.BUCKETS, 3)).astype(np.float32)
    texts = ["ab c", "", "1 2", "word " * 300, "é"]
    mean, n = languages.means(texts, odds)
    for i, t in enumerate(texts):
        alone, m = languages.means([t], odds)
        assert m[0] == n[i] and np.allclose(alone[0], mean[i])
    monkeypatch.setattr(languages, "STEP", 100)
    parts, m = languages.means(texts, odds)
    assert abs(m[3] - n[3]) <= 2 * 300 / 10 and np.allclose(parts[3], mean[3], atol=0.1)


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.QUERIES["op3_output_codes"](spark, sf).collect()}
    held = {r.doc_id: r.lang for r in documents(spark, sf).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert {k for k, r in rows.items() if r.held_out} == set(held) and len(rows) == 1000
    assert np.mean([rows[k].lang_pred == v for k, v in held.items()]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = documents(spark).limit(100)
    other = docs.selectExpr("doc_id", "text", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2, 'zz', lang) AS lang")
    pick = lambda d: sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in languages.report(d).collect())
    assert pick(docs) == pick(other)


def test_edges(spark):
    docs = edge_docs(spark)
    rows = languages.report(docs).collect()
    assert len(rows) == docs.count()
    letters = {str(r.doc_id): any(c.isalpha() for c in r.text or "") for r in docs.collect() if r.doc_id}
    for r in rows:
        if r.doc_id:
            assert (r.lang_pred != "und") == letters[str(r.doc_id)]
    kept = languages.accepted(docs)
    assert kept.columns == docs.columns
    assert sorted(r.text or "" for r in kept.collect()) == sorted(r.text for r in docs.collect() if any(c.isalpha() for c in r.text or ""))
    assert languages.report(empty_docs(spark)).count() == 0
    unlabelled = docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert {r.lang_pred for r in languages.report(unlabelled).collect()} == {"und"}
