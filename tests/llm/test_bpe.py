import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from docmill.llm import bpe

RANKS = bpe.read_ranks(bpe.DEFAULT_VOCABULARY)
OWN = bpe.PrefixEncoder(RANKS)
REFERENCE = tiktoken.Encoding("own", pat_str=bpe.SPLIT_PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_same_ids_as_the_merges_on_any_text(text):
    assert OWN.encode(text) == REFERENCE.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 5000, " " * 3000 + "x", "=-" * 2000, "<|endoftext|>", "\r\n\t", "é中文的😀́" * 50, "'s'll'"])
def test_hard_texts(text):
    assert OWN.encode(text) == REFERENCE.encode_ordinary(text)


def test_words_glued_together():
    random.seed(3)
    pieces = [t.decode("utf-8", "ignore") for t in random.sample(list(RANKS), 3000)]
    for _ in range(300):
        text = "".join(random.sample(pieces, 6))
        assert OWN.encode(text) == REFERENCE.encode_ordinary(text)


def test_full_memory_is_emptied_without_effect():
    small = bpe.PrefixEncoder(RANKS, cached=3)
    text = "one two three four five six one two three"
    assert small.encode(text) == REFERENCE.encode_ordinary(text)


def test_every_row_is_encoded(spark):
    rows = [(1, "Hello world"), (1, "Hello world"), (2, ""), (3, None), (None, "x"), (4, "long " * 20000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumnRenamed("ids", "ids")
    df = df.selectExpr("*", "'clash' as key", "'clash' as body", "'clash' as ids")
    got = sorted((r["doc_id"] or 0, r["ids"]) for r in bpe.encode_texts(df).collect())
    assert got == sorted((i or 0, REFERENCE.encode_ordinary(t or "")) for i, t in rows)
    counts = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in bpe.count_tokens(df).collect())
    assert counts == sorted((i or 0, len(REFERENCE.encode_ordinary(t or ""))) for i, t in rows)
    assert bpe.encode_texts(df.limit(0)).collect() == []


def test_vocabularies_of_one_size_have_encoders_of_their_own(spark, tmp_path):
    """A reused Python worker never encodes with the vocabulary of another job."""
    import base64

    ids = {}
    for pair in (b"ab", b"cd"):
        path = tmp_path / pair.decode()
        tokens = [bytes([b]) for b in range(256)] + [pair]
        path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens)))
        df = spark.createDataFrame([(1, "abcd")], "doc_id bigint, text string").coalesce(1)
        ids[pair] = bpe.encode_texts(df, vocabulary=str(path)).first()["ids"]
    assert ids == {b"ab": [256, 99, 100], b"cd": [97, 98, 256]}
