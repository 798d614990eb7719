"""Operator 3: every prefix count against the library."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ticketsift.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "B", " ", "  ", "\n", "'ll", "'re", "'s", "é", "ü", "日本", "123", "!!", "<|endoftext|>", "<|endof", "hello", "wörld", " the", "\t", "\xa0", "\x1c", "́", "🙂", "İ", " ", "x" * 40, " " * 30, "=" * 70, "'"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_every_prefix_of_random_texts(library):
    rng, c = random.Random(1), tc.counter(PATH)
    for _ in range(250):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 12)))
        counts = np.concatenate([[0], np.cumsum(c.steps(text))])
        want = [len(library.encode(text[:p], add_special_tokens=False).ids) for p in range(len(text) + 1)]
        assert counts.tolist() == want, text


def test_store_answers_truncation_and_budget():
    c = tc.counter(PATH)
    text = "the quick  brown fox\n\n jumps's over" * 30
    store = tc.pack_steps(c.steps(text))
    counts = tc.unpack_counts(store)
    assert tc.tokens_at(store, 17) == counts[17] and tc.tokens_at(store, 10**9) == counts[-1]
    cut = tc.chars_within(store, 50)
    assert counts[cut] <= 50 and (counts[cut + 1 :] > 50).all()


def test_rows(spark, library):
    texts = [None, "", "hello world", "hello world", "de " * 50_000, "a<|endoftext|>b"]
    rows = [(k if k != 3 else None, t, 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = tc.prefix_counts(df, PATH, 1024).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[3 if r["doc_id"] is None else r["doc_id"]] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids))
        assert tc.unpack_counts(r["prefix"])[-1] == r["n_tokens"] and r["cut_chars"] <= len(t)
    assert tc.prefix_counts(df.where("false"), PATH, 10).count() == 0


def test_one_store_answers_every_limit(spark, library):
    texts = ["the quick  brown fox\n\n jumps's over " * k for k in (0, 1, 7, 60)] + ["a" * 3000 + "\n" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    store = tc.count_store(df, PATH)
    assert all(f.endswith(".parquet") for f in store.inputFiles())  # a written table, not a plan over the texts
    for limit in (0, 3, 50, 10**6):
        for r in tc.answers(store, limit).collect():
            t = texts[r["doc_id"]]
            fits = [p for p in range(len(t) + 1) if len(library.encode(t[:p], add_special_tokens=False).ids) <= limit] if limit < 10**6 else [len(t)]
            assert r["cut_chars"] == fits[-1], (limit, t[:20])
            assert r["n_tokens"] == len(library.encode(t, add_special_tokens=False).ids)
