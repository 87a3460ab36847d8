"""Greedy caches, which have no greatest depth, against a heap."""

from __future__ import annotations

import heapq

import pytest

from spanloom.operators import cache, grams
from spanloom.operators.corpus import stream_stats


def heap_order(tokens, floor, budget, fmt):
    """(keys in order, number of entries at the expansion of each key): windows of tokens."""
    counts = {}
    for d in tokens:
        for i in range(len(d)):
            for j in range(i + 1, len(d) + 1):
                k = fmt.encode(d[i:j])
                counts[k] = counts.get(k, 0) + 1
    kids = {}
    for k in sorted(counts, key=lambda k: (-counts[k], k)):
        kids.setdefault(k[: -fmt.width], []).append(k)
    cost = lambda k: fmt.entry_bytes(len(k) // fmt.width)
    low = sorted((k for k in counts if len(k) <= floor * fmt.width), key=lambda k: (len(k), k))
    out, spent, done = ["", *low], sum(map(cost, low)), {}
    for k in out:
        if len(k) < floor * fmt.width:
            done[k] = sum(len(x) <= len(k) + fmt.width for x in out)
    heap = [(-counts.get(k, 10**9), len(k), k) for k in out if len(k) == floor * fmt.width and counts.get(k, 2) >= 2]
    heapq.heapify(heap)
    while heap:
        _, _, k = heapq.heappop(heap)
        for x in kids.get(k, []):
            if budget is not None and spent + cost(x) > budget:
                return out, done
            out.append(x)
            spent += cost(x)
            if counts[x] >= 2:
                heapq.heappush(heap, (-counts[x], len(x), x))
        done[k] = len(out)
    return out, done


@pytest.fixture(scope="module")
def nodes(spark, docs, fmt):
    levels = grams.levels(grams.with_intervals(grams.suffix_counts(docs, 2, fmt)), [1, 2], fmt, 2)
    ranks = stream_stats(docs, fmt).select("num_ranks")
    return cache.with_parents(levels, ranks, fmt).cache(), ranks


@pytest.mark.parametrize(("floor", "budget"), [(0, None), (2, None), (0, 900), (2, 8000), (0, 9000)])
def test_greedy_caches_are_those_of_a_heap(docs, nodes, tokens, fmt, suffixes, floor, budget):
    deep = cache.deeper_levels(docs, nodes[0], 2, fmt, budget)
    rows = cache.greedy_cache(deep, nodes[1], floor, fmt, budget).orderBy("entry_no").collect()
    keys, done = heap_order(tokens, floor, budget, fmt)
    assert [r.key for r in rows] == keys
    assert {r.key: r.expanded_at for r in rows if r.expanded_at is not None} == done
    assert budget is not None or max(r.depth for r in rows) > 8
    for r in rows[1::7]:
        key = bytes.fromhex(r.key)
        lo = sum(s < key for s in suffixes)
        assert (r.lo, r.hi) == (lo, lo + sum(s.startswith(key) for s in suffixes))


def test_a_budget_below_the_floor_is_an_error(nodes, fmt):
    with pytest.raises(ValueError, match="allowed"):
        cache.greedy_cache(nodes[0], nodes[1], 2, fmt, 500)
