"""A sweep from a settings file."""

from __future__ import annotations

import json
from dataclasses import asdict

from spanloom import config
from spanloom.plans import sweep


def test_a_sweep_writes_a_table_and_a_document(spark, tmp_path):
    texts = ["a b c d e f g", "a b c d e f h", "a b c d x", "q a b", "a b c d e f g"]
    rows = [(i, t, "train" if i else " Test", 0) for i, t in enumerate([*texts, None, ""])]
    at = str(tmp_path)
    spark.createDataFrame(rows, "doc_id bigint, text string, split string, shard int").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(60,), (200,), (10**6,), (None,)], "budget bigint").write.parquet(f"{at}/budgets.parquet")
    spark.createDataFrame([("test",)], "split string").write.parquet(f"{at}/heldout_config.parquet")
    path = tmp_path / "s.json"
    path.write_text(json.dumps(asdict(config.Settings(workload=config.Workload(lengths=(1, 4), per_length=20)))))
    table = sweep.run(spark, at, config.load(str(path)), f"{at}/out")
    document = json.loads("".join(r.value for r in spark.read.text(f"{at}/out/results.json").collect()))
    assert document["query_lengths"] == [1, 4] and [f["name"] for f in document["fixed"]] == ["unigram", "bigram", "trigram"]
    assert [g["floor_depth"] for g in document["greedy"]] == [0, 2]
    assert all(p["bytes"] <= p["budget"] for g in document["greedy"] for p in g["points"])
    most = document["greedy"][0]["points"][-1]
    assert most["budget"] == 10**6 and most["steps"]["4"]["mean"] <= document["none"]["steps"]["4"]["mean"]
    assert table.count() == 2 * (1 + len(document["fixed"]) + sum(len(g["points"]) for g in document["greedy"]))
