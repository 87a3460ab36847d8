"""What the operators on similar texts keep off the disk: rows near no candidate, suffixes that can't be of a pair."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from spanloom.llm import overlap, versions
from spanloom.llm.similar import about, first_of_copies, parities
from spanloom.session import materialize


def test_rows_near_no_id_are_held_back_however_many_ids_there_are(spark):
    ids = spark.range(0, 600_000, 2).toDF("id")
    near, far = about(spark.range(0, 600_000).toDF("id"), ids, both=True)
    got = near.groupBy((F.col("id") % 2).alias("odd")).count().collect()
    counts = {r.odd: r["count"] for r in got}
    assert counts[0] == 300_000 and counts.get(1, 0) <= 300_000 / 12
    assert far.count() == 600_000 - sum(counts.values())
    empty = about(ids, spark.createDataFrame([], "id bigint"), both=True)
    assert (empty[0].count(), empty[1].count()) == (0, 300_000)


def test_first_of_copies_are_the_first_ones_and_what_is_no_copy(spark):
    rows = spark.createDataFrame([(1, "a", False), (2, "a", True), (2, "a", True), (3, "b", False), (4, "c", True), (5, "c", True), (6, "d", True)], "id bigint, text string, held boolean")
    members = spark.createDataFrame([(1, 1, False, True), (2, 1, True, True), (4, 4, True, True), (5, 4, True, True)], "id bigint, rep bigint, held boolean, any_held boolean")
    got = sorted(tuple(r) for r in first_of_copies(rows, members, "held").collect())
    assert got == [(1, "a", True), (3, "b", False), (4, "c", True), (6, "d", True)]


def test_suffixes_meet_only_where_their_texts_may_be_similar(spark):
    draw = np.random.default_rng(1)
    one = draw.integers(0, 1 << 62, 100).astype(np.uint64)
    other = draw.integers(0, 1 << 62, 100).astype(np.uint64)
    near = np.concatenate([one[:90], draw.integers(0, 1 << 62, 10).astype(np.uint64)])
    bits = parities(np.repeat([0, 1, 2], 100), np.concatenate([one, other, near]), 3, overlap.BITS)
    head, n = np.zeros(3, dtype=np.int64), np.full(3, 100)
    found = overlap.sharing(head, np.array([7, 8, 9]), n, n, np.zeros(3, dtype=np.int64), np.array([2, 1, 1]), 0.6, bits)
    assert [tuple(p[:2]) for part in found for p in part.T] == [(7, 9)]


def test_groups_of_ranges_find_what_one_array_finds(spark):
    draw = np.random.default_rng(2)
    texts = []
    for _ in range(30):
        t = [f"w{x}" for x in draw.integers(0, 400, 60)]
        texts += [t, [*t[:25], "x", *t[25:]]]
    docs = spark.createDataFrame([(i, i % 2 == 1, i % 2 == 0, " ".join(t)) for i, t in enumerate(texts)], "id bigint, held boolean, taught boolean, text string")
    nothing = overlap.Frequent(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    kind = (F.col("held").cast("int") + F.col("taught").cast("int") * 2).alias("kind")
    rows = materialize(overlap.suffixes(docs, nothing, rare=True).select("id", kind, "n", F.col("r").alias("known"), "places", "bits"))
    one, five = (sorted(tuple(r) for r in overlap.array_pairs(rows, 0.6, g).collect()) for g in (1, 5))
    assert one == five and {(i, i + 1) for i in range(0, 60, 2)} <= set(one)


def test_pairs_get_their_sketches_in_passes_and_groups_stay_the_same(spark, monkeypatch):
    draw = np.random.default_rng(3)
    rows = []
    for g in range(12):
        t = [f"w{x}" for x in draw.integers(0, 10_000, 80)]
        for _ in range(4):
            at = int(draw.integers(0, 80))
            rows.append((len(rows), g, " ".join([*t[:at], f"x{len(rows)}", *t[at:]])))
    docs = spark.createDataFrame(rows, "doc_id bigint, g int, text string")
    whole, sizes = versions.allowed, []

    def counted(pairs, sketches, least):
        sizes.append(pairs.count())
        return whole(pairs, sketches, least)

    monkeypatch.setattr(versions, "allowed", counted)
    cut = versions.in_passes
    monkeypatch.setattr(versions, "in_passes", lambda rows, by, pairs, at_once: cut(rows, by, pairs, 40))
    found = sorted(tuple(r) for r in versions.version_groups(docs.select("doc_id", "text")).collect())
    assert found == [(4 * g, i) for i, g, _ in rows]
    assert sum(sizes) > len(rows) and max(sizes) < sum(sizes) and len(sizes) > 2
