import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Reference

from tallymart.llm import bpe
from tallymart.llm.queries import TOKENIZER, op9_bpe, table


@pytest.fixture(scope="module")
def library():
    return Reference.from_file(TOKENIZER)


def ids(data):
    return np.frombuffer(data, dtype="<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(text=st.text())
def test_same_ids_as_the_library(library, text):
    ours = bpe.load(TOKENIZER)
    assert ids(ours.encode(text)) == library.encode(text, add_special_tokens=False).ids
    assert ours.decode(ours.encode(text)) == text


def test_long_words_and_special_tokens(library):
    rng, ours = random.Random(3), bpe.load(TOKENIZER)
    texts = ["".join(rng.choice("abcdetinghoers") for _ in range(n)) for n in (1, 50, 5000)]
    for text in [*texts, "a" * 20000, "<|endoftext|>", "x<|endoftext|> y", " \t\n  x\x1c\x85 ", ""]:
        assert ids(ours.encode(text)) == library.encode(text, add_special_tokens=False).ids
    assert 50256 not in ids(ours.encode("x<|endoftext|>", special=False))


def test_decoding_broken_bytes(library):
    ours = bpe.load(TOKENIZER)
    first = ids(ours.encode("漢"))[:1]
    assert ours.decode(np.array(first, dtype="<u4").tobytes()) == library.decode(first, skip_special_tokens=False)


def test_compatible_pairs_are_those_that_merging_keeps():
    ours, rng = bpe.load(TOKENIZER), random.Random(9)
    for _ in range(4000):
        left, right = rng.randrange(50000), rng.randrange(3000)
        if ours.last_merge(left) is not None and ours.last_merge(right) is not None:
            assert ours.compatible(left, right) == (ours.merged(ours.token_bytes[left] + ours.token_bytes[right]) == [left, right])


def test_one_pass_agrees(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, "the <|endoftext|> cat", "c")], "doc_id long, text string, decoded string")
    out = {r.doc_id: r for r in bpe.transcode(rows, TOKENIZER).collect()}
    assert bytes(out[2].ids) == bpe.load(TOKENIZER).encode("the <|endoftext|> cat") and out[2].decoded == "the <|endoftext|> cat" and out[1].n_tokens == 0
    assert bpe.transcode(rows.limit(0), TOKENIZER, keep=["doc_id"]).columns == ["doc_id", "ids", "decoded", "n_tokens"]


def test_query_against_the_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").collect()}
    out = op9_bpe(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        true = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        back = library.decode(true, skip_special_tokens=False)
        assert r.n_tokens == len(true) and r.ids_sha256 == hashlib.sha256(np.array(true, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_columns(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "the cat", "c"), (3, "the cat", "c")], "doc_id long, text string, ids string")
    out = bpe.decode_documents(bpe.encode_documents(rows, TOKENIZER), TOKENIZER).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.decoded) for r in out] == [(0, ""), (0, ""), (2, "the cat"), (2, "the cat")]
    assert bpe.encode_documents(rows.limit(0), TOKENIZER).count() == 0
