"""The invariants of caches and of cached queries."""

from __future__ import annotations

import heapq
import random

import pytest
from pyspark.sql import functions as F

from spanloom.config import Workload
from spanloom.functions.steps import search_steps
from spanloom.operators import cache, corpus, grams, resolve, workload
from tests.conftest import bytes_of, interval

DEPTH = 4


@pytest.fixture(scope="module")
def built(docs, fmt):
    rows = grams.with_intervals(grams.suffix_counts(docs, DEPTH, fmt)).cache()
    levels = grams.levels(rows, [1, 2, 3, 4], fmt, DEPTH).cache()
    ranks = corpus.stream_stats(docs, fmt).select("num_ranks")
    made = {f"fixed{d}": cache.fixed_cache(levels, ranks, d, fmt) for d in (1, 2, 3)}
    nodes = cache.with_parents(levels, ranks, fmt).cache()
    made |= {f"greedy{f}": cache.greedy_cache(nodes, ranks, f, fmt) for f in (0, 2)}
    return {k: v.orderBy("entry_no").cache() for k, v in made.items()}, levels, ranks


def probes(suffixes, query, lo, hi):
    """A search that looks at suffixes, counting the looks."""
    looks = 0

    def side(i):
        nonlocal looks
        looks += 1
        s = suffixes[i][: len(query)]
        return (s > query) - (s < query)

    a, b, hit = lo, hi, None
    while a < b and hit is None:
        m = (a + b - 1) >> 1
        c = side(m)
        a, b, hit = (m + 1, b, None) if c < 0 else (a, m, None) if c > 0 else (a, b, m)
    if hit is None:
        return a, a, looks
    x, y = a - 1, hit
    while y - x > 1:
        m = (x + y) >> 1
        x, y = (m, y) if side(m) < 0 else (x, m)
    left, x, y = y, hit, b
    while y - x > 1:
        m = (x + y) >> 1
        x, y = (m, y) if side(m) <= 0 else (x, m)
    return left, y, looks


def test_steps_are_those_of_a_real_search(spark, suffixes, fmt, tokens):
    draw = random.Random(1)
    flat = [t for d in tokens for t in d]
    cases = []
    for _ in range(150):
        n = draw.choice([1, 2, 3, 4, 6])
        q = b"".join(t.to_bytes(2, "little") for t in ([draw.choice(flat) for _ in range(n)]))
        true = interval(suffixes, q)
        cut = draw.randint(0, n)
        lo, hi = interval(suffixes, q[: 2 * cut])
        cases.append((lo, hi, *true, probes(suffixes, q, lo, hi)))
    df = spark.createDataFrame([(*c[:4], c[4][2]) for c in cases], "lo bigint, hi bigint, l bigint, r bigint, want bigint")
    for c in cases:
        if c[2] < c[3]:
            assert c[4][:2] == c[2:4]
    rows = df.select("want", search_steps(F.col("lo"), F.col("hi"), F.col("l"), F.col("r")).alias("got"), (F.col("hi") - F.col("lo")).alias("n")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]
    assert all(r.got <= 3 * (int(r.n).bit_length() + 1) for r in rows)


def test_parents_precede_children_and_bytes_add_up(built, fmt):
    for name, entries in built[0].items():
        seen, total = set(), 0
        for i, r in enumerate(entries.collect()):
            assert r.entry_no == i
            assert not r.key or r.key[: -fmt.width] in seen, name
            seen.add(r.key)
            total += fmt.entry_bytes(r.depth)
            assert r.cum_bytes == total


def test_expanded_entries_have_all_children(built, fmt):
    levels = built[1].collect()
    for entries in built[0].values():
        rows = entries.collect()
        at = {r.key: r.entry_no for r in rows}
        for r in rows:
            if r.expanded_at is not None:
                kids = [x.key for x in levels if x.depth == r.depth + 1 and x.key.startswith(r.key)]
                assert all(at[k] < r.expanded_at for k in kids)


def test_fixed_holds_every_level(built):
    levels = built[1].collect()
    for d in (1, 2, 3):
        rows = built[0][f"fixed{d}"].collect()
        assert {(r.key, r.lo, r.hi) for r in rows if r.key} == {(x.key, x.lo, x.hi) for x in levels if x.depth <= d}
        assert all((r.expanded_at is not None) == (r.depth < d) for r in rows)


@pytest.mark.parametrize("floor", [0, 2])
def test_greedy_is_what_a_heap_does(built, floor, fmt):
    levels = built[1].collect()
    rows = built[0][f"greedy{floor}"].collect()
    kids = {}
    for x in sorted(levels, key=lambda x: (-x.cnt, x.lo)):
        kids.setdefault(x.key[: -fmt.width], []).append(x)
    order = [rows[0], *sorted((x for x in levels if x.depth <= floor), key=lambda x: (x.depth, x.lo))]
    heap = [(-r.cnt, r.depth, r.lo, r.key) for r in order if r.depth >= floor and r.cnt >= 2]
    heapq.heapify(heap)
    keys = [r.key for r in order]
    while heap:
        _, depth, _, key = heapq.heappop(heap)
        if depth == DEPTH:
            continue
        for x in kids.get(key, []):
            keys.append(x.key)
            if x.cnt >= 2:
                heapq.heappush(heap, (-x.cnt, x.depth, x.lo, x.key))
    assert [r.key for r in rows] == keys


def test_limits_and_snapshots(spark, built):
    entries = built[0]["greedy0"]
    rows = entries.collect()
    top = rows[-1].cum_bytes
    budgets = [0, 11, 12, top // 3, top, 10 * top]
    got = {r.budget: (r.entries, r.bytes) for r in cache.limits(entries, spark.createDataFrame([(b,) for b in [*budgets, None, 12]], "budget bigint")).collect()}
    for b in budgets:
        n = sum(r.cum_bytes <= b for r in rows)
        assert got[b] == (n, rows[n - 1].cum_bytes)
    cut = cache.snapshot(entries, 50).collect()
    assert len(cut) == 50 and all(r.expanded_at is None or r.expanded_at <= 50 for r in cut)


def test_cached_answers_are_the_uncached_ones(spark, built, docs, fmt, suffixes, tokens):
    draw = random.Random(2)
    flat = [t for d in tokens for t in d]
    rows = []
    for n in (1, 2, 3, 4, 6):
        for i in range(12):
            d = draw.choice([d for d in tokens if len(d) >= n])
            at = draw.randint(0, len(d) - n)
            q = d[at : at + n] if i < 8 else [draw.choice([*flat, 999]) for _ in range(n)]
            rows.append((n, i, fmt.encode(q)))
    queries = spark.createDataFrame(rows, "length int, qid int, key string")
    located = grams.locate(docs, queries, 6, fmt)
    steps = {}
    for name, entries in [*built[0].items(), ("none", cache.root_cache(built[2]))]:
        n = entries.count()
        for limit in sorted({n, max(1, n // 3), max(1, n // 7)}):
            named = entries.withColumns({"policy": F.lit(name), "floor_depth": F.lit(0)})
            configs = spark.createDataFrame([(name, 0, 0, limit)], "policy string, floor_depth int, budget int, entries bigint")
            found = resolve.resolve(resolve.longest_prefixes(queries, named, configs, fmt), located).collect()
            assert len(found) == len(rows)
            steps[name, limit == n] = sum(r.steps for r in found)
            for r in found:
                lo, hi = interval(suffixes, bytes_of(r.key))
                assert r.cnt == hi - lo
                assert lo == hi or (r.found_lo, r.found_hi) == (lo, hi)
    assert all(v <= steps["none", True] for v in steps.values())


def test_save_and_load(spark, built, fmt, tmp_path):
    from spanloom.config import TokenFormat

    entries = built[0]["greedy2"]
    cache.save_cache(entries, str(tmp_path / "c"), fmt)
    back = cache.load_cache(spark, str(tmp_path / "c"), fmt)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, entries.collect()))
    with pytest.raises(ValueError):
        cache.load_cache(spark, str(tmp_path / "c"), TokenFormat(token_bytes=4))


def test_sampled_windows(spark, docs, fmt, tokens, tmp_path):
    work = Workload(lengths=(1, 4, 31), per_length=50, seed=3)
    got = workload.sample_windows(docs, work, fmt)
    rows = got.collect()
    assert sorted((r.length, r.qid) for r in rows) == [(n, i) for n in (1, 4) for i in range(50)]
    have = {fmt.encode(d[i : i + 4]) for d in tokens for i in range(len(d) - 3)}
    assert all(r.key in have for r in rows if r.length == 4)
    workload.write_query_sets(got, str(tmp_path / "q"))
    assert sorted(map(tuple, workload.read_query_sets(spark, str(tmp_path / "q")).collect())) == sorted(map(tuple, rows))
    none = spark.createDataFrame([], docs.schema)
    assert workload.sample_windows(none, work, fmt).count() == 0


def test_summary_interpolates(spark):
    df = spark.createDataFrame([("x", 0, 1, 4, i) for i in range(10)], "policy string, floor_depth int, budget bigint, length int, steps bigint")
    r = resolve.summarize(df).first()
    assert (r.mean, r.p50, r.p99) == (4.5, 4.5, pytest.approx(8.91))
