"""Where greedy caches end, against their entries."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanloom.operators import cache, grams, resolve, suffixes
from spanloom.operators.corpus import stream_stats
from spanloom.operators.frontier import Frontier
from tests.test_suffixes import repeats

BUDGETS = [0, 40, 150, 333, 700, 1500, 2600, 5000, 9000, 20_000, 60_000, 10**8]


@pytest.fixture(scope="module")
def corpus(spark, fmt):
    docs = spark.createDataFrame([(i - 5, t) for i, t in enumerate(repeats())], "doc_id bigint, toks array<bigint>").cache()
    levels = grams.levels(grams.with_intervals(grams.suffix_counts(docs, 2, fmt)), [1, 2], fmt, 2)
    ranks = stream_stats(docs, fmt).select("num_ranks")
    nodes = cache.deeper_levels(docs, cache.with_parents(levels, ranks, fmt).cache(), 2, fmt).cache()
    return docs, {f: cache.greedy_cache(nodes, ranks, f, fmt).cache() for f in (0, 2)}


@pytest.fixture(params=[(10**6, BUDGETS), (120, BUDGETS), (40, BUDGETS[:-1]), (120, BUDGETS[:7])])
def frontier(corpus, fmt, monkeypatch, request):
    for name, value in {"BLOCK": 512, "AHEAD": 128, "RANGE_ROWS": request.param[0], "PASS_ROWS": 400}.items():
        monkeypatch.setattr(suffixes, name, value)
    return Frontier(corpus[0], fmt, (0, 2), (1, 2, 3), request.param[1])


def test_limits_are_those_of_the_entries(spark, corpus, frontier):
    for floor, entries in corpus[1].items():
        budgets = spark.createDataFrame([(b,) for b in frontier.budgets], "budget bigint")
        least = entries.where(F.col("depth") <= floor).count()
        want = [tuple(r) for r in cache.limits(entries, budgets).where(f"entries >= {least}").orderBy("budget").collect()]
        assert frontier.limits(floor) == want


def test_hits_are_those_of_the_entries(spark, corpus, frontier, fmt):
    docs, caches = corpus
    keys = {fmt.encode(t[a : a + n]) for t in repeats()[::3] for n in (1, 2, 4, 7, 10) for a in range(0, len(t) - n + 1, 5)} | {fmt.encode(x) for x in ([9], [0, 9, 0], [1, 2, 3, 0], [3, 3, 3, 3, 3, 9])}
    queries = spark.createDataFrame([(len(k) // fmt.width, i, k) for i, k in enumerate(sorted(keys))], "length int, qid int, key string")
    parts = queries.select(F.explode(F.transform(F.sequence(F.lit(1), F.col("length")), lambda d: F.substring("key", F.lit(1), d * fmt.width))).alias("key"))
    got = resolve.ordered_prefixes(queries, grams.locate(docs, parts, 10, fmt), frontier, [], fmt)
    named = [c.where("depth <= 10").withColumns({"policy": F.lit("greedy"), "floor_depth": F.lit(f)}) for f, c in caches.items()]
    configs = spark.createDataFrame([("greedy", f, b, n) for f in (0, 2) for b, n, _ in frontier.limits(f)], "policy string, floor_depth int, budget bigint, entries bigint")
    want = resolve.longest_prefixes(queries, named[0].unionAll(named[1]), configs, fmt)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
