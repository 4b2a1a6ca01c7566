import itertools
import re
from collections import defaultdict
from fractions import Fraction

import pytest
from helpers import SF_SMALL, documents, edge_docs, empty_docs
from oracle_check import compare, duck

from tablelens.llm import filter_audit, queries


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 100,
        "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
    }


def brute(docs, labels):
    """Applies the filters one after another, in every order."""
    rows = docs.collect()
    least = {}
    for r in rows:
        if r.doc_id is not None:
            least[r.text or ""] = min(least.get(r.text or "", r.doc_id), r.doc_id)
    good, toxic = ({x.doc_id for x in labels.collect() if x[c] == 1 and x.doc_id is not None} for c in ("quality", "toxic"))
    parts = defaultdict(list)
    for r in rows:
        t = r.text or ""
        parts[r.lang or ""].append((fails(t) | {"E": r.doc_id is not None and r.doc_id > least[t]}, r.doc_id in good, r.doc_id in toxic))
    out, shapley = [], defaultdict(int)
    for part, held in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = held
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[0][f]]
                left = [x for x in left if not x[0][f]]
                failing = sum(x[0][f] for x in held)
                alone = sum(x[0][f] and sum(x[0].values()) == 1 for x in held)
                shapley[part, f] += len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), failing - len(gone), alone, sum(x[1] for x in gone), sum(x[2] for x in gone)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def rows_of(found):
    return sorted(tuple(r) for r in found.select("part", "filter_order", "step", *filter_audit.COUNTS).collect())


def labels_of(spark, docs):
    return spark.createDataFrame(
        [(1, 1, 0), (4, 0, 1), (4, 1, None), (7, 1, 1), (9, None, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int"
    )


def test_query_is_its_sql(spark):
    key = "op11_filter_audit"
    assert compare(spark, duck(SF_SMALL), key, queries.QUERIES[key], queries.ORACLES[key], SF_SMALL)["ok"]


def test_all_orders_by_brute_force(spark):
    docs, labels = documents(spark), spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    assert rows_of(filter_audit.audit(docs, labels)) == brute(docs, labels)


def test_edges(spark):
    docs = edge_docs(spark)
    assert rows_of(filter_audit.audit(docs, labels_of(spark, docs))) == brute(docs, labels_of(spark, docs))
    assert filter_audit.audit(empty_docs(spark), labels_of(spark, docs)).count() == 0
    none = labels_of(spark, docs).limit(0)
    assert rows_of(filter_audit.audit(docs, none)) == brute(docs, none)


def test_text_keys_and_odd_names(spark):
    docs, labels = edge_docs(spark), labels_of(spark, edge_docs(spark))
    docs = docs.selectExpr("CAST(doc_id AS STRING) AS `a.b`", "text AS `the text`", "lang AS `l.n`", "1 AS `__x`", "2 AS place", "3 AS mask")
    found = filter_audit.audit(docs, labels.selectExpr("CAST(doc_id AS STRING) AS `a.b`", "quality", "toxic"), "a.b", "the text", "l.n")
    assert len(rows_of(found)) == 600 * len({r[0] or "" for r in docs.select("`l.n`").collect()})


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_shares_are_shapley_values(n):
    value = [0] + [(s * 7919) % 101 + s for s in range(1, 1 << n)]
    want = []
    for i in range(n):
        sums = []
        for order in itertools.permutations(range(n)):
            before = sum(1 << j for j in order[: order.index(i)])
            sums.append(value[before | 1 << i] - value[before])
        want.append(Fraction(sum(sums), len(sums)))
    assert filter_audit.shapley(value) == want


def test_a_hot_text_passes_a_task_once(spark):
    """The first of equal texts is found without moving each of them."""
    docs = spark.range(5000).selectExpr("id AS doc_id", "'same' AS text", "'en' AS lang").repartition(8)
    found = filter_audit.cells(docs, labels_of(spark, docs))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert {(r["mask"] >= filter_audit.COPY): r["n"] for r in found.collect()} == {False: 1, True: 4999}
