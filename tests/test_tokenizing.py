"""Texts are encoded where they are; queries are placed by packed tokens."""

from __future__ import annotations

import re

import numpy as np

from spanloom.operators import corpus, grams


def test_only_rare_words_are_shuffled(spark, fmt):
    texts = ["a b\va \x1cc", None, "", " d\f", "a b a a", "b e f a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    words = corpus.words(df).drop("text")
    vocab = corpus.vocabulary(words)
    ids = {r.w: r.tok for r in vocab.collect()}
    want = {i: [ids[w] for w in re.split("[ \t\n\r\f]+", t or "") if w] for i, t in enumerate(texts)}
    whole = corpus.encode(words, vocab, fmt)
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
    for rows in (whole, corpus.encode(words, vocab, fmt, head=2), corpus.encode(words, vocab, fmt, head=0)):
        assert {r.doc_id: r.toks for r in rows.collect()} == want


def test_heads_of_suffixes():
    flat, sizes = np.array([0, 255, 256, 7]), np.array([2, 0, 2])
    heads, at, lead = grams._suffix_heads(flat, sizes, np.array([True, True, False]), 2, 16)
    text = bytes([0, 1, 255, 1, 255, 255, 255, 255, 0, 2, 7, 1, 0, 0]) + bytes(16)
    assert [heads[a].tobytes() for a in at] == [text[i : i + 16] for i in (0, 2, 8, 10)]
    assert lead.tolist() == [int.from_bytes(text[i : i + 8], "big") for i in (0, 2, 8, 10)]
