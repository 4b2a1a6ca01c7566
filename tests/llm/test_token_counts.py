import base64

import numpy as np
import public_tokenizers as P
import tiktoken
from helpers import documents, edge_docs, empty_docs

from tablelens.llm import queries, token_counts


def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_query(spark):
    enc = tik()
    rows = queries.QUERIES["op2_token_counts"](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {r.doc_id: len(enc.encode_ordinary(r.text)) for r in documents(spark).collect()}
    assert len(rows) == documents(spark).count()


def test_edges(spark):
    enc = tik()
    docs = edge_docs(spark)
    want = sorted((str(r.doc_id), len(enc.encode_ordinary(r.text or ""))) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_tokens) for r in token_counts.count_tokens(docs).collect()) == want
    assert token_counts.count_tokens(empty_docs(spark)).count() == 0


def brute(ids, separator):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == separator:
            out.append((len(out), start, i - start, True))
            start = i + 1
    if start < len(ids):
        out.append((len(out), start, len(ids) - start, False))
    return out


def test_raw_files_cut_into_blocks_anywhere(spark, tmp_path):
    r = np.random.default_rng(3)
    want = {}
    for k, n in enumerate([0, 1, 7, 64, 1000, 5000]):
        ids = r.integers(0, 9, n).astype("<u2")
        ids[r.random(n) < (0.3 if k % 2 else 0.002)] = 9
        (tmp_path / f"{k}.bin").write_bytes(ids.tobytes())
        want[f"{k}.bin"] = brute(ids.tolist(), 9)
    for block in (1, 7, 64, 100_000):
        got = {name: [] for name in want}
        for x in token_counts.scan(token_counts.read_flat(spark, str(tmp_path), 2, block), 9).collect():
            got[x.file.rsplit("/", 1)[1]].append((x.ordinal, x.start, x.n_tokens, x.ended))
        assert {k: sorted(v) for k, v in got.items()} == want
