import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from helpers import LONG, documents, edge_docs, empty_docs
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tablelens.llm import bpe, bpe_codec, queries
from tablelens.llm.common import offsets

TEXTS = [
    "", " ", "a  b", "x \n y", "  \n\n", "'s 'S don't we'll x'rex I'VE 12'd a''s", "a" * 3000 + "b" * 500, "ab" * 2000, "日本語 テスト 🎉🎉", "x   ", "  y  z",
    "tab\t \tq", "\0 a\0b", "....!!!!" * 200, "1234567890 " * 50, "ſtrá ße", "x\x1cy \x1c z", "İstanbul IİΣ ΑΣ É", "á éx", "’s “q” naïve—x", "x<|endoftext|>y", "   x y", LONG,
]


@pytest.fixture(scope="module")
def rank():
    return bpe.RankCodec(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def word():
    return bpe.WordCodec(P.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t


def split(ids, lens):
    e = offsets(lens)
    return [ids[a:b].tolist() for a, b in zip(e[:-1], e[1:])]


def test_rank_codec_is_tiktoken(rank, tik):
    got = split(*rank.encode(TEXTS))
    for t, ids in zip(TEXTS, got):
        assert ids == tik.encode_ordinary(t), t[:40]
        assert rank.decode(np.array(ids, int)).tobytes() == t.encode()


def test_word_codec_is_tokenizers(word, library):
    for t, ids in zip(TEXTS, split(*word.encode(TEXTS))):
        assert ids == library.encode(t, add_special_tokens=False).ids, t[:40]


def test_long_texts_are_cut_where_words_begin(rank, tik, monkeypatch):
    monkeypatch.setattr(bpe, "SEGMENT", 50)
    texts = ["one two  three \n four's " * 30, "y" * 300, LONG[:5000]]
    assert split(*rank.encode(texts)) == [tik.encode_ordinary(t) for t in texts]


def test_words_are_forgotten_when_there_are_too_many(rank, tik, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    for k in range(3):
        texts = [f"word{k}{i} other{i}" for i in range(20)]
        assert split(*rank.encode(texts)) == [tik.encode_ordinary(t) for t in texts]


def test_equal_hashes_are_noticed(tik, monkeypatch):
    monkeypatch.setattr(bpe, "word_hashes", lambda data, starts, lens: (lens % 3).astype(np.uint64))
    texts = ["some words that all share a few hashes", "more of these words"]
    assert split(*bpe.RankCodec(P.path("byte_bpe_50k.tiktoken")).encode(texts)) == [tik.encode_ordinary(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(t=st.text(alphabet=st.sampled_from("aAbeshtlrvmd' \n\t.!19éßΣİ日́"), max_size=40))
def test_any_text(rank, tik, word, library, t):
    assert rank.encode([t])[0].tolist() == tik.encode_ordinary(t)
    assert word.encode([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids


def brute(tik, text):
    ids = tik.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tik.decode_bytes(ids)).hexdigest()


def test_query(spark, tik):
    rows = queries.QUERIES["op7_byte_bpe"](spark, "/root/testdata/sf0.001").collect()
    want = {r.doc_id: brute(tik, r.text) for r in documents(spark).collect()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want


def test_edges(spark, tik):
    docs = edge_docs(spark)
    want = sorted(brute(tik, r.text) for r in docs.collect())
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_codec.digests(docs).collect()) == want
    back = bpe_codec.decode(bpe_codec.encode(docs)).collect()
    assert sorted(r.text for r in back) == sorted(r.text or "" for r in docs.collect())
    assert bpe_codec.digests(empty_docs(spark)).count() == 0
