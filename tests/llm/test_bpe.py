import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from engramix.llm import bpe


@pytest.fixture(scope="module")
def both():
    with open(bpe.VOCABULARY, "rb") as f:
        own = bpe.ByteBPE(f.read())
    return own, tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


TEXTS = ["", " ", "Hello world, it's   1234 o'clock\n\n  ok", "éèê ñ 日本語 \U0001f600\U0001f600", "a" * 300, "ab" * 3000, "x\x00y\r\n\t", " ".join("tion" * k for k in range(30))]


def test_equals_the_public_encoder(both):
    own, other = both
    ids, start = own.encode(TEXTS)
    for i, t in enumerate(TEXTS):
        assert ids[start[i] : start[i + 1]].tolist() == other.encode_ordinary(t)
        assert own.decode(ids[start[i] : start[i + 1]].tolist()) == t


def test_long_pieces_take_the_heap(both):
    own, other = both
    rng = random.Random(3)
    t = "".join(rng.choice("abcdethionr") for _ in range(9000))
    ids, start = own.encode([t, "short"])
    assert ids[start[0] : start[1]].tolist() == other.encode_ordinary(t)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_texts(both, texts):
    own, other = both
    ids, start = own.encode(texts)
    for i, t in enumerate(texts):
        assert ids[start[i] : start[i + 1]].tolist() == other.encode_ordinary(t)


def test_unknown_ids_raise(both):
    with pytest.raises(ValueError):
        both[0].decode_bytes(np.array([10**7]), np.array([0, 1]))


def test_documents(spark):
    docs = spark.createDataFrame([(1, "the theme", 5), (1, "the theme", 5), (None, None, 6), (3, "", 7)], "doc_id long, text string, n_tokens int")
    found = bpe.encode_documents(docs)
    rows = sorted(found.collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [(r.doc_id, r.n_tokens, r.round_trip) for r in rows] == [(1, 2, True), (1, 2, True), (3, 0, True), (None, None, None)]
    assert rows[2].token_ids == [] and rows[3].token_ids is None
    back = bpe.decode_documents(found.select("doc_id", "token_ids")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back if r.text is not None) == [(1, "the theme"), (1, "the theme"), (3, "")]
    assert bpe.encode_documents(docs.limit(0)).collect() == []


def test_carried_columns_keep_their_names(spark):
    docs = spark.createDataFrame([(1, "one two", 7)], "doc_id long, text string, n_tokens int")
    found = bpe.encode_documents(docs, carry=("doc_id", "n_tokens", "text"))
    row = found.first()
    assert found.columns == ["doc_id", "n_tokens", "text", "n_tokens_", "token_ids", "round_trip"] and (row.n_tokens, row.n_tokens_, row.text) == (7, 2, "one two")
    back = bpe.decode_documents(found).first()
    assert (back.text, back.text_) == ("one two", "one two")
