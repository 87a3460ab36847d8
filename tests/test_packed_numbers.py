"""Suffixes are sorted and searched by numbers that hold their tokens."""

from __future__ import annotations

import numpy as np
import pytest

from spanloom.operators import grams, suffixes
from spanloom.operators.frontier import Frontier
from tests.test_frontier import BUDGETS
from tests.test_frontier_passes import repeated  # noqa: F401
from tests.test_suffixes import repeats


@pytest.mark.parametrize(("bits", "n", "kinds"), [(5, 20, 3), (19, 9, 2), (32, 5, 2), (40, 5, 2), (64, 3, 2)])
def test_order_and_common_tokens(bits, n, kinds):
    draw = np.random.default_rng(0)
    tokens = draw.integers(0, kinds, (3000, n)).astype(np.uint64) * np.uint64(((1 << bits) - 1) // (kinds - 1))
    groups = np.sort(draw.integers(0, 40, len(tokens)))
    per = 64 // bits
    padded = np.zeros((len(tokens), -(-n // per) * per), dtype=np.uint64)
    padded[:, :n] = tokens
    words = [suffixes._words(padded[:, k : k + per].ravel(), bits)[::per] for k in range(0, n, per)]
    by, same = suffixes._sorted(words, n, bits, groups)
    assert by.tolist() == np.lexsort((*tokens.T[::-1], groups)).tolist()
    common = np.cumprod(tokens[by][1:] == tokens[by][:-1], axis=1).sum(axis=1)
    assert same[1:].tolist() == np.where(groups[1:] == groups[:-1], common, 0).tolist()
    # rows that too few agree in may stay together, others are told apart all the same
    by, some = suffixes._sorted(words, n, bits, groups, 3)
    assert (some <= same).all()
    for d in range(n):
        of = lambda x: np.diff(np.append(np.flatnonzero(np.append(True, (x[1:] < d) | (groups[1:] != groups[:-1]))), len(x)))  # noqa: E731, B023
        assert sorted(x for x in of(some) if x > 2) == sorted(x for x in of(same) if x > 2)


def test_queries_are_placed_by_blocks(spark, repeated, fmt):  # noqa: F811
    some = [t[a : a + n] for t in repeats()[::3] for n in (1, 2, 5, 10) for a in range(0, len(t) - n + 1, 7)]
    keys = {fmt.encode(x) for x in [*some, [], [9], [0, 9, 0], [65530], [0, 65534], [2**15]]}
    queries = spark.createDataFrame([(k,) for k in keys], "key string")
    text = suffixes.document_blocks(repeated.where("not exists(toks, t -> t > 255)"), fmt)
    for docs, blocks in ((repeated, suffixes.document_blocks(repeated, fmt)), (repeated.where("not exists(toks, t -> t > 255)"), text)):
        want = sorted(map(tuple, grams.locate(docs, queries, 10, fmt).collect()))
        assert sorted(map(tuple, grams.locate(docs, queries, 10, fmt, blocks).collect())) == want
    stream = [b for t in repeats() for b in (fmt.separator_key, *(fmt.token_key(x) for x in t))]
    ranks = sorted("".join(stream[i : i + 12]) for i in range(len(stream)))
    got = {r.key: (r.lo, r.hi) for r in grams.locate(repeated, queries, 10, fmt, suffixes.document_blocks(repeated, fmt)).collect()}
    assert got == {k: ((lo := sum(r < k for r in ranks)), lo + sum(r.startswith(k) for r in ranks)) for k in keys}


def test_ends_are_looked_for_in_ranges_that_hold_them(repeated, fmt, monkeypatch):  # noqa: F811
    frontier, read = Frontier(repeated, fmt, (0, 2), (1, 2, 3), BUDGETS), []
    frontier.rounds = [(a, b, type("Rows", (), {"where": lambda self, x, rows=rows: read.append(x) or rows.where(x)})()) for a, b, rows in frontier.rounds]
    assert any(c for floor in (0, 2) for *_, c in frontier.cuts(floor, 10)) and read
