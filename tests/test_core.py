"""Running sums, components, keys, settings, shards and hot keys."""

from __future__ import annotations

import gzip
import json
import random
from dataclasses import asdict

import pytest
from pyspark.sql import functions as F

from spanloom import config
from spanloom.functions import keys, labels
from spanloom.operators import hotkeys
from spanloom.operators.components import connected_components
from spanloom.operators.prefix import numbered, running
from spanloom.sources import shards


@pytest.mark.parametrize("rows_per_range", [1_000_000, 45, 1])
def test_running_sums(spark, rows_per_range):
    draw = random.Random(0)
    rows = [(f"{i:04d}", draw.choice([None, 0, 1, 5])) for i in range(300)]
    df = spark.createDataFrame(draw.sample(rows, len(rows)), "k string, v bigint")
    got = running(df, "k", {"upto": F.col("v")}, rows_per_range=rows_per_range).orderBy("k").collect()
    total = 0
    for r in got:
        total += r.v or 0
        assert r.upto == total
    assert [r.n for r in numbered(df, "k", "n", rows_per_range).orderBy("k").collect()] == list(range(300))
    assert numbered(df.limit(0), "k", "n").count() == 0


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randint(0, 80), draw.randint(0, 80)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    rows = [(a, b, 0) for a, b in edges] + [(3, None, 1), (5, 5, 1), edges[0] + (7,)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(rows, "a bigint, b bigint, u int")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_keys(spark):
    fmt = config.TokenFormat(token_bytes=2)
    df = spark.createDataFrame([([1, 256, 257],), ([],)], "t array<bigint>")
    assert [r[0] for r in df.select(keys.encode(F.col("t"), fmt)).collect()] == ["010000010101", ""]
    assert fmt.encode([1, 256, 257]) == "010000010101"
    assert sorted([fmt.encode([1]), fmt.encode([256]), fmt.encode([257])]) == [fmt.encode([256]), fmt.encode([1]), fmt.encode([257])]
    sizes = {200: 1, 256: 1, 257: 2, 2**32: 4, 2**32 + 1: 5, 1: 1}
    rows = spark.createDataFrame([(s,) for s in sizes], "s bigint").select("s", keys.pointer_size(F.col("s")).alias("p")).collect()
    assert {r.s: r.p for r in rows} == sizes
    with pytest.raises(ValueError):
        fmt.token_key(65536)
    page = spark.createDataFrame([(0, 0), (0, 1), (4095, 2), (4096, 4096)], "a bigint, n bigint")
    assert [r[0] for r in page.select(keys.pages_touched(F.col("a"), F.col("n"), fmt)).collect()] == [0, 1, 2, 1]


def test_labels(spark):
    assert [labels.format_bytes(v) for v in (0, 999, 1500, 24_887_018, 1e9, 5e15)] == ["0 B", "999 B", "1.5 KB", "24.9 MB", "1 GB", "5e+03 TB"]
    ranges = spark.createDataFrame([(1.0, 25.0), (5.0, 1.0), (0.0, 3.0), (0.03, 0.3)], "a double, b double")
    ticks = [[round(t, 9) for t in r[0]] for r in ranges.select(labels.log_ticks(F.col("a"), F.col("b"))).collect()]
    assert ticks == [[1, 2, 5, 10, 20], [], [], [0.05, 0.1, 0.2]]
    assert [r[0] for r in spark.createDataFrame([(0.004,), (0.005,)], "ms double").select(labels.served_from_memory(F.col("ms"))).collect()] == [True, False]
    names = spark.range(1, 5).select(keys.depth_name(F.col("id")), keys.greedy_label(F.col("id") - 1)).collect()
    assert [r[0] for r in names] == ["unigram", "bigram", "trigram", "4-gram"]
    assert names[0][1] == "greedy" and names[2][1] == "greedy, all up to bigram"


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps(asdict(config.Settings())))
    assert config.load(str(path)) == config.Settings()
    raw = asdict(config.Settings())
    raw["caches"]["more"] = 1
    path.write_text(json.dumps(raw))
    with pytest.raises(ValueError):
        config.load(str(path))
    del raw["caches"]
    path.write_text(json.dumps(raw))
    with pytest.raises(ValueError):
        config.load(str(path))


def test_shards_come_back_in_order(spark, tmp_path):
    named = config.Shards(totals={"train": 12})
    rows = [(i, f"text {i}" if i % 5 else None, i % 3) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard int")
    shards.write_shards(df.repartition(5), str(tmp_path), "train", named)
    assert sorted(p.name for p in (tmp_path / "en").iterdir()) == [f"web-train.0000{i}-of-00012.json.gz" for i in range(3)]
    got = shards.read_shards(spark, str(tmp_path), "train", [2, 0], named).orderBy("doc_id").collect()
    assert [r.text for r in got] == [t for s in (2, 0) for _, t, k in rows if k == s]
    assert [r.doc_id for r in got] == list(range(20))
    assert shards.read_shards(spark, str(tmp_path), "train", [], named).count() == 0
    with pytest.raises(ValueError):
        named.file_name("train", 12)
    with pytest.raises(ValueError):
        named.file_name("test", 0)
    flat = tmp_path / "flat" / named.file_name("train", 7)
    flat.parent.mkdir(parents=True)
    flat.write_bytes(gzip.compress(b'{"text": "one"}\n{"text": "two"}\n'))
    assert [r.text for r in shards.read_shards(spark, str(tmp_path / "flat"), "train", [7], named).orderBy("doc_id").collect()] == ["one", "two"]


HITS = "lookup_id bigint, key string, lo bigint, hi bigint, arrived_at timestamp, weight int"


def test_canonical_keys(spark):
    given = {"536E": "536E", "0x536e": "536E", "0X53 6e": "536E", " 53:6E ": "536E", "": "", "c951 773a": "C951773A", "0x": ""}
    rows = spark.createDataFrame([(k,) for k in given], "k string").select("k", hotkeys.canonical_key(F.col("k")).alias("c")).collect()
    assert {r.k: r.c for r in rows} == given


def test_hot_keys_and_totals(spark):
    rows = [(i, "0xab" if i % 2 else "AB", 5, 15, None, 0) for i in range(30)]
    rows += [(i, "AB", 15, 5, None, 0) for i in range(30)]  # delivered twice, ends exchanged
    rows += [(100 + i, None if i % 2 else "", 0, 9, None, 0) for i in range(60)]
    rows += [(200, "CD", None, 4, None, 0), (201, "CD", 1, 4, None, 0), (None, "EE", 1, 2, None, 0)]
    hits = spark.createDataFrame(rows, HITS)
    assert [r.key for r in hotkeys.hot_keys(hits, 0.1).collect()] == ["AB"]
    assert sorted(r.key for r in hotkeys.hot_keys(hits, 0.02).collect()) == ["AB", "CD"]
    assert {r.key: (r.lookups, r.intervals, r.missing) for r in hotkeys.key_totals(hits).collect()} == {"AB": (30, 300, 0), None: (30, 270, 0), "": (30, 270, 0), "CD": (2, 3, 1)}
    none = spark.createDataFrame([], HITS)
    assert hotkeys.hot_keys(none).count() == 0 and hotkeys.key_totals(none).count() == 0


def test_key_statistics_against_counting(spark):
    draw = random.Random(5)
    rows = [("hot", draw.randint(-3, 9)) for _ in range(400)] + [(draw.choice(["a", "b", None]), draw.choice([None, 1, 2, 2])) for _ in range(60)] + [("empty", None)]
    got = {r.key: r for r in hotkeys.key_statistics(spark.createDataFrame(rows, "key string, v bigint"), "key", "v").collect()}
    for key in {k for k, _ in rows}:
        v = sorted(x for k, x in rows if k == key and x is not None)
        r = got[key]
        assert (r.n, r.n_distinct) == (len(v), len(set(v)))
        if v:
            assert (r.least, r.greatest) == (v[0], v[-1])
            assert r.mode == min(set(v), key=lambda x: (-v.count(x), x))
            assert r.p50 == v[-(-len(v) // 2) - 1] and r.p99 == v[-(-len(v) * 99 // 100) - 1]
        else:
            assert r.mode is None and r.p50 is None
