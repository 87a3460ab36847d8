"""Windows, intervals and children against sorted suffixes."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.operators import corpus, grams
from spanloom.operators.ranks import suffix_ranks
from tests.conftest import bytes_of, interval


def expected(tokens, fmt, k):
    return Counter(fmt.encode(d[i : i + k]) for d in tokens for i in range(len(d) - k + 1))


@pytest.mark.parametrize("k", [1, 2, 3])
@pytest.mark.parametrize("partitions", [1, 7])
def test_windows_are_counted(spark, docs, tokens, fmt, k, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = {r.key: r.cnt for r in grams.window_counts(docs, k, fmt).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == expected(tokens, fmt, k)


@pytest.mark.parametrize("rows_per_range", [500_000, 50])
def test_intervals_are_those_of_the_suffix_array(docs, tokens, fmt, suffixes, rows_per_range, monkeypatch):
    monkeypatch.setattr(grams, "running", lambda *a, **k: __import__("spanloom.operators.prefix", fromlist=["running"]).running(*a, **k, rows_per_range=rows_per_range))
    rows = grams.with_intervals(grams.suffix_counts(docs, 3, fmt))
    assert rows.agg(F.sum("cnt")).first()[0] == len(suffixes)
    for depth in (1, 2, 3):
        level = grams.level(rows, depth, fmt, 3).collect()
        assert {r.key: r.cnt for r in level} == expected(tokens, fmt, depth)
        for r in level:
            assert (r.lo, r.hi) == interval(suffixes, bytes_of(r.key))


def test_absent_queries_get_their_insertion_rank(spark, docs, fmt, suffixes):
    keys = ["", *(fmt.encode(q) for q in ([1], [256], [999], [3, 4], [0, 0, 0], [512, 9, 9], [5, 65534, 1], [7]))]
    queries = spark.createDataFrame([(k,) for k in [*keys, keys[1], None, fmt.encode([1, 65535]), fmt.encode([1] * 4)]], "key string")
    got = {r.key: (r.lo, r.hi) for r in grams.locate(docs, queries, 3, fmt).collect()}
    assert set(got) == set(keys)
    for k in keys:
        assert got[k] == interval(suffixes, bytes_of(k)), k


def test_children_come_by_falling_count(docs, fmt, tokens):
    rows = grams.with_intervals(grams.suffix_counts(docs, 2, fmt))
    one, two = grams.level(rows, 1, fmt, 2), grams.level(rows, 2, fmt, 2)
    got = grams.children(one, two, fmt).orderBy("parent_key", "place").collect()
    assert Counter(r.parent_key + r.next_token_key for r in got) == Counter(expected(tokens, fmt, 2).keys())
    for a, b in zip(got, got[1:]):
        if a.parent_key == b.parent_key:
            assert (-a.cnt, a.lo) < (-b.cnt, b.lo)


def test_ranks_are_those_of_the_suffix_array(docs, tokens, fmt, suffixes):
    flat = [t for d in tokens for t in (65535, *d)]
    at = {s: i for i, s in enumerate(suffixes)}
    got = {r.pos: r["rank"] for r in suffix_ranks(docs, fmt).collect()}
    assert got == {i: at[b"".join(t.to_bytes(2, "little") for t in flat[i:])] for i in range(len(flat))}


def test_empty_corpus(spark, fmt):
    none = spark.createDataFrame([], "doc_id bigint, toks array<bigint>")
    assert grams.with_intervals(grams.suffix_counts(none, 2, fmt)).count() == 0
    assert grams.window_counts(none, 2, fmt).count() == 0
    stats = corpus.stream_stats(none, fmt).first()
    assert (stats.documents, stats.num_ranks, stats.ptr_size) == (0, 0, 1)


def test_stream_stops_before_the_document_that_is_too_much(docs, fmt, tokens):
    sizes = [len(t) + 1 for t in tokens]
    limit = sum(sizes[:5])
    assert corpus.stream(docs, fmt, max_tokens=limit).count() == 5
    assert corpus.stream(docs, fmt, max_tokens=limit - 1).count() == 4
    assert corpus.stream(docs, fmt, max_docs=3).count() == 3
    rows = corpus.stream(docs, fmt).orderBy("doc_id").collect()
    assert [r["first"] for r in rows] == [sum(sizes[:i]) for i in range(len(sizes))]


def test_words_and_ids(spark, fmt):
    df = spark.createDataFrame([(1, "b a\tb\r\nc", 9), (2, None, 9), (3, " \n", 9), (4, "a b", 9)], "doc_id bigint, text string, tok int")
    words = corpus.words(df)
    vocab = corpus.vocabulary(words)
    assert [(r.w, r.cnt, r.tok) for r in vocab.orderBy("tok").collect()] == [("b", 3, 0), ("a", 2, 1), ("c", 1, 2)]
    got = {r.doc_id: r.toks for r in corpus.encode(words, vocab, fmt).collect()}
    assert got == {1: [0, 1, 0, 2], 2: [], 3: [], 4: [1, 0]}
    capped = corpus.vocabulary(words, max_words=2)
    assert {r.doc_id: r.toks for r in corpus.encode(words, capped, fmt, unknown=2).collect()}[1] == [0, 1, 0, 2]
