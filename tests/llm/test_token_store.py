from __future__ import annotations

import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from trailmark.llm import tokens


def brute(encoder, texts):
    return [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def lists(encoder, texts):
    ids, ends = encoder.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


def test_texts_without_spaces_are_not_remembered():
    own, rng = tokens.Encoder(tokens.default_path()), random.Random(4)
    texts = ["".join(rng.choice("abcdefghij日本語") for _ in range(3000)) for _ in range(200)] + ["a b c", "x" * 5000 + " y", None, ""]
    assert lists(own, texts) == brute(own, texts)
    assert len(own.slot) < 20 and own.ends[len(own.slot)] < 100


def test_the_store_is_bounded_by_ids_too(monkeypatch):
    monkeypatch.setattr(tokens, "STORE_IDS", 1000)
    own, rng = tokens.Encoder(tokens.default_path()), random.Random(5)
    for _ in range(6):
        texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(40)) for _ in range(20)) for _ in range(10)]
        assert lists(own, texts) == brute(own, texts)
    assert own.ends[len(own.slot)] < 10_000  # what one batch brought beyond the bound


def test_first_words_are_encoded_once():
    own, texts = tokens.Encoder(tokens.default_path()), [f"first{i} and more" for i in range(50)]
    assert lists(own, texts) == brute(own, texts)
    assert not any(k == f"first{i}" for i in range(50) for k in own.slot) and len(own.slot) == 53


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab .'\n\t1é日", "  ", "word ", "z" * 2100, "<|endoftext|>"]), max_size=20).map("".join), min_size=1, max_size=8))
def test_ids_equal_the_library(texts):
    own = tokens.Encoder(tokens.default_path())
    assert lists(own, texts) == brute(own, texts) and lists(own, texts) == brute(own, texts)
