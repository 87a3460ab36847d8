"""The order of suffixes by packed arrays."""

from __future__ import annotations

import random

import pytest

from spanloom.operators import ranks, suffixes


def expected(tokens):
    flat = [t for d in tokens for t in (65535, *d)]
    texts = [b"".join(t.to_bytes(2, "little") for t in flat[i:]) for i in range(len(flat))]
    return {i: n for n, i in enumerate(sorted(range(len(flat)), key=texts.__getitem__))}


def repeats():
    """Long repeats, some across documents, and tokens whose bytes are 0 or 255."""
    draw = random.Random(3)
    long = [draw.choice([0, 1, 255, 256, 65280]) for _ in range(90)]
    docs = [long[draw.randint(0, 40) :] for _ in range(12)] + [[0] * 40, [], [], [5], [0] * 60]
    docs += [[draw.randint(0, 3) for _ in range(draw.randint(1, 30))] for _ in range(30)]
    draw.shuffle(docs)
    return [*docs, long, [7, 0, 0], long, [7, 0, 0]]


@pytest.mark.parametrize(("first", "deepest"), [(8, 500), (3, 500), (2, 2), (5, 24)])
def test_order_of_small_blocks_and_ranges(spark, fmt, monkeypatch, first, deepest):
    for name, value in {"BLOCK": 128, "AHEAD": 64, "RANGE_ROWS": 150, "PASS_ROWS": 450}.items():
        monkeypatch.setattr(suffixes, name, value)
    tokens = repeats()
    docs = spark.createDataFrame([(i - 5, t) for i, t in enumerate(tokens)], "doc_id bigint, toks array<bigint>")
    rows = ranks.suffix_ranks(docs, fmt, first, deepest).collect()
    assert len(rows) == sum(len(t) + 1 for t in tokens)
    assert {r.pos: r["rank"] for r in rows} == expected(tokens)


def test_no_table_has_a_row_for_each_suffix(spark, docs, tokens, fmt, monkeypatch):
    written = []
    for module in (ranks, suffixes):
        keep = getattr(module, "materialize", None)
        monkeypatch.setattr(module, "materialize", lambda df, keep=keep: written.append(keep(df)) or written[-1])
    assert ranks.suffix_ranks(docs, fmt).count() == sum(len(t) + 1 for t in tokens)
    assert written and max(t.count() for t in written) < len(tokens)


def test_no_documents_have_no_suffixes(spark, fmt):
    none = spark.createDataFrame([], "doc_id bigint, toks array<bigint>")
    assert ranks.suffix_ranks(none, fmt).count() == 0
