"""A whole sweep from a settings file: all caches and budgets over all query lengths, to one table
and one JSON document."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import config
from spanloom.operators import corpus
from spanloom.plans.experiment import Experiment


def nested(x: Experiment) -> dict:
    """The results as one document: the corpus, then a record for the search without a cache, for
    each fixed cache and for each floor and budget of the greedy one, with steps by length."""
    rows = [r.asDict() for r in x.results().orderBy("policy", "floor_depth", "budget", "length").collect()]  # configurations x lengths
    size = corpus.stream_stats(x.train, x.fmt).first()

    def record(policy: str, floor: int, budget: int) -> dict:
        own = [r for r in rows if (r["policy"], r["floor_depth"], r["budget"]) == (policy, floor, budget)]
        return {"entries": own[0]["entries"], "bytes": own[0]["bytes"], "steps": {str(r["length"]): {k: r[k] for k in ("mean", "p50", "p99")} for r in own}}

    fixed = [{"name": name, "depth": d} | record(name, d, b) for d, name in x.fixed_names.items() for b in {r["budget"] for r in rows if r["policy"] == name}]
    greedy = []
    for floor in x.settings.caches.greedy_floors:
        budgets = sorted({r["budget"] for r in rows if (r["policy"], r["floor_depth"]) == ("greedy", floor)})
        greedy.append({"floor_depth": floor, "points": [{"budget": b} | record("greedy", floor, b) for b in budgets]})
    return {"num_ranks": size.num_ranks, "index_bytes": size.index_bytes, "query_lengths": list(x.settings.workload.lengths), "none": record("none", 0, 0), "fixed": fixed, "greedy": greedy}


def run(spark: SparkSession, sf_dir: str, settings: config.Settings, out: str) -> DataFrame:
    """Write the long table of results to out/results.parquet and the document, as one line of
    JSON, to out/results.json; both in any file system. Returns the table."""
    x = Experiment(spark, sf_dir, settings)
    x.results().write.mode("overwrite").parquet(f"{out}/results.parquet")
    document = spark.createDataFrame([(json.dumps(nested(x)),)], "value string")
    document.coalesce(1).write.mode("overwrite").text(f"{out}/results.json")
    return spark.read.parquet(f"{out}/results.parquet").orderBy("policy", F.col("floor_depth"), "budget", "length")


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("tables", help="folder of the input tables")
    args.add_argument("out", help="folder of the results")
    args.add_argument("--settings", help="a settings file; without it the defaults hold")
    given = args.parse_args()
    spark = SparkSession.builder.appName("spanloom-sweep").getOrCreate()
    run(spark, given.tables, config.load(given.settings) if given.settings else config.Settings(), given.out).show(1000, truncate=False)


if __name__ == "__main__":
    main()
