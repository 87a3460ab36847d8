"""Queries on greedy caches don't build the caches' entries."""

from __future__ import annotations

import pytest

import __spark_entry__
from spanloom.plans.experiment import Experiment

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["latency_set", "steps_summary_greedy", "fixed_vs_greedy_ratio", "longest_prefix_hit", "steps_by_length", "greedy_snapshots", "pareto_points"])
def test_no_entries_are_built(spark, monkeypatch, name):
    def refuse(*_):
        raise AssertionError("entries of a greedy cache")

    monkeypatch.setattr(Experiment, "greedy", refuse)
    monkeypatch.setattr(Experiment, "greedy_nodes", property(refuse))
    assert __spark_entry__.queries()[name](spark, SF).count() > 0
