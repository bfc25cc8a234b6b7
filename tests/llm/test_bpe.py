"""Token ids against two public implementations."""

from __future__ import annotations

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nightloom.llm.bpe import Encoder, default_path, default_pattern, encode_corpus

pytestmark = pytest.mark.skipif(not os.path.exists(default_path()), reason="no public vocabulary here")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return Encoder(default_path(), default_pattern())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(encoder, reference, text):
    assert list(encoder.encode([text])[0]) == reference(text)


def test_long_words(encoder, reference):
    rng = random.Random(1)
    texts = ["a" * 20000, "ab" * 5000, " " * 3000, "日本語" * 3000, "<|endoftext|>", "".join(rng.choice("etaoinshrdlu") for _ in range(20000)), "\x00\x01", "🙂" * 500, "é" * 999]
    assert [list(x) for x in encoder.encode(texts)] == [reference(t) for t in texts]


def test_compatible_pairs_decide(encoder):
    v = encoder.vocab
    rng = random.Random(3)
    words = [bytes(rng.choice(b"theandingrations ") for _ in range(rng.randint(2, 14))) for _ in range(3000)]
    got, failing = v.encode_words(words)
    assert got == [v._merge(w) for w in words] and 0 < failing < len(words)


def test_round_trip_and_rows(spark, encoder):
    rows = [(1, "Hello world's end", "x"), (1, "Hello world's end", "x"), (2, None, "x"), (3, "", "x"), (4, " ", "x"), (None, "a", "x")]
    got = sorted((r["doc_id"] or -1, list(r["ids"])) for r in encode_corpus(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect())
    back = {v: k for k, v in encoder.vocab.ranks.items()}
    assert [i for i, _ in got] == [-1, 1, 1, 2, 3, 4] and got[3][1] == [] and got[4][1] == [] and got[5][1]
    assert b"".join(back[t] for t in got[1][1]).decode() == rows[0][1]
    assert encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0
