"""Containers: nothing lost, nothing split without need, no container too full, little unused."""

from __future__ import annotations

import random

import numpy as np
import pytest

from spanloom.llm import packing


@pytest.mark.parametrize("k", [1, 2, 5, 40])
def test_differencing_keeps_all_items(k):
    sizes = np.random.default_rng(k).integers(1, 1000, 60)
    window, sums = packing.differencing(sizes, k)
    assert list(np.bincount(window, weights=sizes, minlength=k).astype(int)) == sums.tolist()
    if k <= 5:
        assert sums.max() - sums.min() <= 40


def test_windows_keep_to_the_capacity():
    rng = np.random.default_rng(0)
    for sizes, capacity in ((rng.integers(1, 100, 300), 100), (np.full(30, 51), 100), (np.full(31, 50), 100), (np.array([100, 1]), 100)):
        window, k = packing.windows_for(sizes, capacity)
        assert np.bincount(window, weights=sizes, minlength=k).max() <= capacity
    assert packing.windows_for(np.full(31, 50), 100)[1] == 16
    assert packing.windows_for(np.zeros(0, dtype=np.int64), 100)[1] == 0


def test_fill_containers(spark):
    draw = random.Random(0)
    rows = [(i, draw.choice([0, 1, 40, 90, 99, 100, 101, 200, 350, 1000]), "x", 1) for i in range(400)] + [(500, None, "x", 1), (None, 5, "x", 1), (7, 3, "x", 1)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, container string, capacity int")
    caps = spark.createDataFrame([(1, 100), (2, 1000), (2, 1000), (3, None), (4, 0)], "capacity_id int, capacity bigint")
    got = packing.fill_containers(sizes, caps).collect()
    want = {}
    for i, n, *_ in rows:
        if i is not None:
            want[i] = max(want.get(i, 0), n or 0)
    for cap_id, cap in ((1, 100), (2, 1000)):
        own = [r for r in got if r.capacity_id == cap_id]
        load = {}
        for r in own:
            load[r.container] = load.get(r.container, 0) + r.n
        assert max(load.values()) <= cap
        for i, n in want.items():
            parts = sorted((r.piece, r.first, r.n) for r in own if r.doc_id == i)
            assert sum(p[2] for p in parts) == n and len(parts) == max(1, -(-n // cap))
            assert [p[1] for p in parts] == [k * cap for k in range(len(parts))]
        assert sum(want.values()) / (len(load) * cap) > 0.9
    assert {r.capacity_id for r in got} == {1, 2}
    assert packing.fill_containers(sizes.limit(0), caps).count() == 0
