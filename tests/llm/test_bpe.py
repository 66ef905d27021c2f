"""Encoding against a public tokenizer library."""

import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessel.llm import bpe

PATH = f"{bpe.FOLDER}/byte_bpe_50k.tiktoken"
RANKS = bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=80))
def test_any_text(reference, text):
    assert bpe.Encoder(RANKS).encode(text) == reference(text)


@pytest.mark.parametrize("text", ["", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "<|endoftext|>", "  \n\n \t x", "abc" * 9000, "=" * 5000, "東京都" * 50, "a\x00b", "don't we'll"])
def test_texts(reference, text):
    assert bpe.Encoder(RANKS).encode(text) == reference(text)


def test_memory_is_bounded(reference):
    e = bpe.Encoder(RANKS, memory=8)
    text = " ".join(f"word{i}" for i in range(100))
    assert e.encode(text) == reference(text) and len(e.known) <= 4


def test_operator(spark, reference):
    rows = [(1, "Hello there", "x"), (2, "", "x"), (3, None, "x"), (None, "Hello there", "x"), (1, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id or 0, list(r.ids)) for r in bpe.encode_corpus(df, "doc_id", "text").collect())
    assert got == sorted((k or 0, reference(t or "")) for k, t, _ in rows)
    assert bpe.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
    assert [r.tokens for r in bpe.with_token_count(df.where("doc_id > 1").orderBy("doc_id"), "text", ["doc_id"]).collect()] == [0, 0]
