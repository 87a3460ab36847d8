"""One query for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.config import Shards
from spanloom.functions import keys
from spanloom.operators import corpus, grams, resolve
from spanloom.operators.ranks import suffix_ranks
from spanloom.plans.experiment import Experiment
from spanloom.sources.tables import split_name, table


def tokenize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Experiment(spark, sf_dir)
    return x.docs.select("doc_id", F.size("toks").cast("bigint").alias("n_tokens"), keys.encode(F.col("toks"), x.fmt).alias("key"))


def vocab_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Experiment(spark, sf_dir)
    return x.vocab.select("w", "tok", "cnt", keys.token_key(F.col("tok"), x.fmt).alias("key"))


def corpus_prefix_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Experiment(spark, sf_dir)
    return corpus.stream(x.docs, x.fmt, max_tokens=100_000, max_docs=500).select("doc_id", "doc_no", "n_tokens")


def doc_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Experiment(spark, sf_dir)
    pages = keys.pages_touched(F.col("byte_offset"), F.col("n_tokens") * x.fmt.token_bytes, x.fmt)
    return corpus.stream(x.docs, x.fmt).select("doc_id", "n_tokens", F.col("first").alias("first_rank"), "byte_offset", pages.alias("pages"))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Experiment(spark, sf_dir)
    return corpus.stream_stats(x.train, x.fmt)


def shard_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each shard holds, by name: tokens with one separator per document. A split has as many
    shards as its greatest number says."""
    x = Experiment(spark, sf_dir)
    at = table(spark, sf_dir, "documents").select("doc_id", "shard", split_name("split").alias("split"))
    rows = x.docs.select("doc_id", "toks").join(at.where("split is not null and shard is not null"), "doc_id")
    sums = rows.groupBy("split", "shard").agg(F.sum(F.size("toks") + 1).alias("tokens"), F.count("*").alias("documents"))
    totals = {r.split: r.total for r in sums.groupBy("split").agg((F.max("shard") + 1).alias("total")).collect()}  # a row for each split
    return sums.select(keys.shard_file(F.col("split"), F.col("shard"), Shards(totals=totals)).alias("file_name"), "tokens", "documents")


def _counts(k: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = Experiment(spark, sf_dir)
        return grams.window_counts(x.docs, k, x.fmt).select("key", "cnt")

    return query


def distinct_grams_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Experiment(spark, sf_dir)
    rows = x.levels.groupBy("depth").agg(F.count("*").alias("grams"), F.sum("cnt").alias("occurrences"), F.max("cnt").alias("top"))
    return rows.withColumn("name", keys.depth_name(F.col("depth")))


def next_tokens_of_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Experiment(spark, sf_dir)
    return grams.children(x.levels.where("depth = 1"), x.levels.where("depth = 2"), x.fmt)


def _intervals(depth: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = Experiment(spark, sf_dir)
        return x.levels.where(F.col("depth") == depth).select("key", "lo", "hi", "cnt")

    return query


def query_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Experiment(spark, sf_dir).queries


def query_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Experiment(spark, sf_dir)
    return x.queries.join(x.located, "key").select("length", "qid", (F.col("hi") - F.col("lo")).alias("cnt"))


def query_intervals_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Experiment(spark, sf_dir)
    return x.queries.join(x.located, "key").select("length", "qid", "key", "lo", "hi")


def uncached_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Experiment(spark, sf_dir)
    return x.resolved_fixed().where("policy = 'none'").select("length", "qid", "found_lo", "found_hi", "steps")


def _fixed(depth: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Experiment(spark, sf_dir).fixed(depth)

    return query


def fixed_cache_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.operators.cache import limits

    x = Experiment(spark, sf_dir)
    return limits(x.fixed(3), table(spark, sf_dir, "budgets"))


def _greedy(floor: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The cache of the largest budget; keys of hundreds of tokens are told by their md5."""
        rows = Experiment(spark, sf_dir).greedy(floor)
        return rows.select("entry_no", F.md5("key").alias("key_md5"), "depth", "lo", "hi", "cnt", "expanded_at", "cum_bytes")

    return query


def greedy_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Experiment(spark, sf_dir)
    parts = [x.limits(f).select(F.lit(f).alias("floor_depth"), "budget", "entries", "bytes") for f in x.settings.caches.greedy_floors]
    return parts[0].unionAll(parts[1])


def longest_prefix_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Experiment(spark, sf_dir)
    return x.resolved().where("policy = 'greedy'").select("floor_depth", "budget", "length", "qid", "depth", "lo", "hi", "exact", "expanded")


def cached_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Experiment(spark, sf_dir)
    return x.resolved_fixed().select("policy", "length", "qid", "cnt", "steps")


def steps_summary_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Experiment(spark, sf_dir).summary_fixed().drop("floor_depth")


def steps_summary_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Experiment(spark, sf_dir).summary().where("policy = 'greedy'").drop("policy")


def steps_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean steps by length without a cache, with each fixed cache and with each greedy cache at
    the size of the largest fixed cache."""
    x = Experiment(spark, sf_dir)
    _, largest = x.frontier.whole(max(x.settings.caches.fixed_depths))
    rows = x.summary().where((F.col("policy") != "greedy") | (F.col("budget") == largest))
    name = F.when(F.col("policy") == "greedy", F.concat(F.lit("greedy"), F.col("floor_depth").cast("string"))).otherwise(F.col("policy"))
    wide = rows.select("length", name.alias("name"), "mean").groupBy("length").pivot("name", ["none", "unigram", "bigram", "trigram", "greedy0", "greedy2"]).agg(F.first("mean"))
    return wide.withColumnRenamed("none", "no_cache")


def pareto_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean steps of queries of four tokens against bytes, and the factor saved over no cache."""
    x = Experiment(spark, sf_dir)
    at = x.results().where(F.col("length") == x.settings.workload.latency_length)
    base = at.where("policy = 'none'").select(F.col("mean").alias("base"))
    rows = at.crossJoin(F.broadcast(base))
    return rows.select("policy", "floor_depth", "budget", "entries", "bytes", "mean", keys.speedup(F.col("base"), F.col("mean")).alias("speedup"))


def fixed_vs_greedy_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each fixed cache and length the steps of the greedy cache with the lowest floor at the
    same budget, and how many times fewer they are."""
    x = Experiment(spark, sf_dir)
    steps = x.summary()
    fixed = steps.where("policy not in ('none', 'greedy')").select("policy", "budget", "length", F.col("mean").alias("fixed_steps"))
    low = min(x.settings.caches.greedy_floors)
    greedy = steps.where((F.col("policy") == "greedy") & (F.col("floor_depth") == low)).select("budget", "length", F.col("mean").alias("greedy_steps"))
    return fixed.join(greedy, ["budget", "length"]).withColumn("ratio", keys.speedup(F.col("fixed_steps"), F.col("greedy_steps")))


def latency_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of the first queries of four tokens, in all configurations, with the number of
    pages that their two reads per step touch at most."""
    x = Experiment(spark, sf_dir)
    work = x.settings.workload
    rows = x.resolved().where((F.col("length") == work.latency_length) & (F.col("qid") < work.latency_queries))
    return rows.groupBy("policy", "floor_depth", "budget").agg(F.count("*").alias("queries"), F.sum("steps").alias("steps"), F.greatest(F.sum("steps"), F.lit(1)).alias("divisor"))


def exact_suffix_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Experiment(spark, sf_dir)
    return suffix_ranks(x.train, x.fmt)
