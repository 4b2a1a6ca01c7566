import re
from collections import defaultdict

from helpers import SF_SMALL, documents, edge_docs, empty_docs
from test_near_dedup import brute_classes
from test_packing import brute_pieces, check_sequences
from test_secrets import base

import corpus_pipeline
from tablelens.plans.checkpoint import scratch_table


def test_each_stage_on_what_the_one_before_kept(spark):
    docs = documents(spark)
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language_id", "exact_copies", "near_copies", "secret_scan", "pack"]

    spoken = scratch_table(stage["language_id"](spark, docs, SF_SMALL))
    assert spoken.columns == columns
    assert {r.doc_id for r in spoken.collect()} == {r.doc_id for r in docs.collect() if re.search(r"[^\W\d_]", r.text or "")}

    single = scratch_table(stage["exact_copies"](spark, spoken, SF_SMALL))
    last = defaultdict(int)
    for r in spoken.collect():
        last[r.text] = max(last[r.text], r.doc_id)
    assert single.columns == columns and sorted(tuple(r) for r in single.collect()) == sorted(tuple(r) for r in spoken.collect() if last[r.text] == r.doc_id)

    apart = scratch_table(stage["near_copies"](spark, single, SF_SMALL))
    want = {min(map(int, g)) for g in brute_classes(single.collect())}
    assert apart.columns == columns and {r.doc_id for r in apart.collect()} == want

    clean = scratch_table(stage["secret_scan"](spark, apart, SF_SMALL))
    before = {r.doc_id: r for r in apart.collect()}
    assert clean.columns == columns and clean.count() == len(before)
    for r in clean.collect():
        assert not base(r.text) and r.n_chars == len(r.text)
        if not base(before[r.doc_id].text):
            assert r.text == before[r.doc_id].text

    packed = stage["pack"](spark, clean, SF_SMALL).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in packed) == brute_pieces(clean)
    check_sequences(packed, 4096)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF_SMALL)
    assert got.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(got.columns)


def test_edges(spark):
    for docs in (edge_docs(spark), empty_docs(spark)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = scratch_table(stage(spark, docs, SF_SMALL))
            assert name == "pack" or docs.columns == columns
        docs.collect()
