import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from helpers import documents, edge_docs, empty_docs
from tokenizers import Tokenizer

from tablelens.llm import packing, queries


def check_sequences(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for rs in by.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= capacity
    return len(by)


def brute_pieces(docs, capacity=packing.CAPACITY):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    out = []
    for r in docs.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, packing.END]
        for p, s in enumerate(range(0, len(ids), capacity)):
            some = ids[s : s + capacity]
            out.append((str(r.doc_id), p, s, len(some), zlib.crc32(np.array(some, "<u4").tobytes())))
    return sorted(out)


def test_query(spark):
    rows = queries.QUERIES["op1_best_fit_packing"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == brute_pieces(documents(spark))
    n = check_sequences(rows, packing.CAPACITY)
    assert n <= -(-sum(r.length for r in rows) // packing.CAPACITY) + 1


def test_edges(spark):
    docs = edge_docs(spark)
    rows = packing.pack_documents(docs, capacity=16).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == brute_pieces(docs, 16)
    check_sequences(rows, 16)
    assert packing.pack_documents(empty_docs(spark)).count() == 0


def test_groups_are_packed_again(spark):
    r = random.Random(5)
    sizes = [(i, r.randint(1, 100)) for i in range(2000)]
    rows = packing.pack(spark.createDataFrame(sizes, "id long, length long"), capacity=100, group=100, loose=0).collect()
    assert sorted((x.id, x.length) for x in rows) == sizes
    assert check_sequences(rows, 100) <= 1.05 * sum(s for _, s in sizes) / 100


def test_local_search_empties_bins():
    size = np.array([44, 44, 40, 35, 27, 37, 27, 27, 59, 48])
    bins = packing.best_fit(size, 100)
    got = packing.local_search(size, [list(b) for b in bins], 100)
    assert sorted(i for b in got for i in b) == list(range(10))
    assert all(size[b].sum() <= 100 for b in got)
    assert (len(bins), len(got)) == (5, 4)


def test_search_never_needs_more_bins():
    r = np.random.default_rng(2)
    for _ in range(30):
        size = r.integers(1, 100, 120)
        first = packing.best_fit(size, 100)
        got = packing.local_search(size, [list(b) for b in first], 100)
        assert sorted(i for b in got for i in b) == list(range(120)) and all(size[b].sum() <= 100 for b in got)
        assert len(got) <= len(first)


def test_exchanges_raise_the_squared_fill():
    # one for one: 60 goes out of the lower bin, 55 comes back
    size = np.array([60, 10, 55, 40])
    out, back, b = packing._exchange([0, 1], size, np.array([70, 95]), np.array([0, 0, 1, 1]), np.array([0, 5]), 0)
    assert (out, back, b) == ([0], [2], 1)
    # two for one: 30 and 15 for 40
    size = np.array([30, 15, 40, 55])
    out, back, b = packing._exchange([0, 1], size, np.array([45, 95]), np.array([0, 0, 1, 1]), np.array([0, 5]), 0)
    assert (sorted(out), back, b) == ([0, 1], [2], 1)
    # one for two: 45 for 20 and 20
    size = np.array([45, 20, 20, 55])
    out, back, b = packing._exchange([0], size, np.array([45, 95]), np.array([0, 1, 1, 1]), np.array([0, 5]), 0)
    assert (out, sorted(back), b) == ([0], [1, 2], 1)
