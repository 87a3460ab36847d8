"""Where greedy caches end is found without a shuffle of the texts or a pass for each budget."""

from __future__ import annotations

import random

import numpy as np
import pytest

from spanloom.operators import suffixes
from spanloom.operators.frontier import Frontier
from tests.test_frontier import BUDGETS
from tests.test_suffixes import repeats


@pytest.fixture
def repeated(spark, monkeypatch):
    for name, value in {"BLOCK": 512, "AHEAD": 128, "RANGE_ROWS": 120, "PASS_ROWS": 120}.items():
        monkeypatch.setattr(suffixes, name, value)
    return spark.createDataFrame([(i - 5, t) for i, t in enumerate(repeats())], "doc_id bigint, toks array<bigint>")


def test_documents_need_no_order(repeated, fmt, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("the stream")

    monkeypatch.setattr(suffixes, "stream", refuse)
    assert Frontier(repeated, fmt, (0,), (1,), [40]).ranks == sum(len(t) + 1 for t in repeats())


def test_all_budgets_are_looked_for_in_one_pass_over_each_round(repeated, fmt, monkeypatch):
    frontier, calls, keep = Frontier(repeated, fmt, (0, 2), (1, 2, 3), BUDGETS), [], Frontier._cuts
    monkeypatch.setattr(Frontier, "_cuts", lambda self, *a: calls.append(a) or keep(self, *a))
    assert sum(c is not None for floor in (0, 2) for *_, c in frontier.cuts(floor, 10)) > len(frontier.rounds)
    assert 0 < len(calls) <= len(frontier.rounds)


def test_number_of_passes_is_bounded(repeated, fmt, monkeypatch):
    text, passes, keep = suffixes.document_blocks(repeated, fmt), [], suffixes.materialize
    monkeypatch.setattr(suffixes, "materialize", lambda df: passes.append(df) or keep(df))
    monkeypatch.setattr(suffixes, "PASSES", 3)
    rows = suffixes.ranges(text)
    assert rows.count() > 3 >= len(passes)


def test_order_of_words():
    draw = random.Random(0)
    rows = np.array([[draw.randint(0, 3), draw.randint(0, 1), draw.randint(0, 2**63)] for _ in range(500)], dtype=np.uint64)
    for some in (rows, rows[:1], rows[:0], rows[:, :1]):
        assert suffixes._order(some).tolist() == np.lexsort(some.T[::-1]).tolist()
