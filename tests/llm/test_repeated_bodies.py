"""Cross-split pairs that sampled or thinned indexes lose: repeated bodies and phrases, boilerplate."""

from __future__ import annotations

import random

import pytest

from spanloom.llm import overlap, similar


@pytest.fixture(scope="module")
def rows():
    """Pairs of a training and a held-out text: a body and its repetitions, repeated phrases of
    unequal length, and pages that are to various shares the boilerplate of their site."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    texts = []
    for times in (3, 5, 60):
        body = [word() for _ in range(200)]
        near = [*body[:100], word(), *body[100:]]
        texts += [body, near * times]
    for short, long in ((100, 300), (260, 300), (25, 400)):
        for _ in range(8):
            phrase = [word() for _ in range(draw.randint(1, 6))]
            texts += [(phrase * long)[:n] for n in (short, long)]
    for share in (0.3, 0.5, 0.6, 0.7, 0.8, 1.0):
        template = [word() for _ in range(200)]
        for _ in range(20):
            head = template[: 200 - draw.randint(0, 2)]
            own = [word() for _ in range(int(200 / share - 200) + draw.randint(0, 12))]
            kept = own[: int(len(own) * draw.uniform(0.2, 1))]
            texts += [head + own, head + kept + [word() for _ in own[len(kept) :]]]
    return [(i, " ".join(t), ("train", "test")[i % 2]) for i, t in enumerate(texts)]


def test_pairs_are_those_of_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(similar, "FREQUENT_LEAST", 5)
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, w in ((i, t.split()) for i, t, _ in rows)}
    want = sorted((a, b) for a in sets for b in sets if a < b and (a + b) % 2 and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, split string")
    got = overlap.cross_split_pairs(docs, ["test"], cover=False).collect()
    assert len(want) > 400 and sorted((r.doc_a, r.doc_b) for r in got) == want
