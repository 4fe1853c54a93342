"""Encoding against the tokenizers library."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from throng.llm import bpe


@pytest.fixture(scope="module")
def both():
    hf = Tokenizer.from_file(bpe.tokenizer_path())
    hf.encode_special_tokens = True
    return bpe.Encoder(*bpe.read_merges(bpe.tokenizer_path())), hf


texts = st.lists(st.text(st.sampled_from("abcdeABst'lrv  \n\t　 é日本가!?.1２😀"), max_size=60), max_size=8)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_same_ids(both, values):
    encoder, hf = both
    ids, counts = encoder.encode(values)
    assert ids.tolist() == [i for e in hf.encode_batch(values, add_special_tokens=False) for i in e.ids]
    assert counts.tolist() == [len(e.ids) for e in hf.encode_batch(values, add_special_tokens=False)]


def test_long_and_odd_texts(both):
    encoder, hf = both
    for text in ("a" * 50_000, "ab" * 30_000, " \n" * 20_000, "<|endoftext|>", "'s 's\n's 'll'lx", "hahaha" * 500):
        assert encoder.encode([text])[0].tolist() == hf.encode(text, add_special_tokens=False).ids


def test_memory_starts_anew(both, monkeypatch):
    encoder, hf = both
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    for text in ("one two three four five six", "seven eight one two nine ten"):
        assert encoder.encode([text])[0].tolist() == hf.encode(text, add_special_tokens=False).ids


def test_table(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hi there", "x"), (3, "Hi there", "x"), (None, "a", "x")], "doc_id long, text string, ids string")
    rows = [(r.doc_id, list(r.ids)) for r in bpe.encode_corpus(df).collect()]
    assert (1, []) in rows and (2, []) in rows and rows.count((3, [17250, 612])) == 2 and (None, [64]) in rows
    assert bpe.encode_corpus(df.limit(0)).count() == 0
    assert {r.doc_id: r.tokens for r in bpe.token_counts(df).collect()}[1] == 0
