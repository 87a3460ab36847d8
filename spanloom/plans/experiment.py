"""The corpora and workload that the queries share, and the whole experiment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.config import Settings
from spanloom.operators import cache, corpus, grams, resolve, workload
from spanloom.operators.frontier import Frontier
from spanloom.session import materialize
from spanloom.sources.tables import kept, once, split_name, table

SETTINGS = Settings()


@dataclass
class Experiment:
    """All tables of one input folder. Each shared table is written once for each session and
    state of the input, and read by the queries after that."""

    spark: SparkSession
    sf_dir: str
    settings: Settings = SETTINGS

    @property
    def fmt(self):
        return self.settings.tokens

    def _once(self, name: str, build) -> DataFrame:
        return once(self.spark, self.sf_dir, f"{name}-{self.settings.digest()}", "documents", build)

    @property
    def words(self) -> DataFrame:
        docs = table(self.spark, self.sf_dir, "documents").select("doc_id", "text", split_name("split").alias("split"))
        return corpus.words(docs).drop("text")

    @property
    def vocab(self) -> DataFrame:
        return self._once("vocab", lambda: corpus.vocabulary(self.words))

    @property
    def docs(self) -> DataFrame:
        """(doc_id, split, toks) of all documents."""
        return self._once("docs", lambda: corpus.encode(self.words, self.vocab, self.fmt))

    @property
    def train(self) -> DataFrame:
        return self.docs.where("split = 'train'")

    @property
    def heldout(self) -> DataFrame:
        splits = table(self.spark, self.sf_dir, "heldout_config").select(split_name("split").alias("split")).distinct()
        return self.docs.join(F.broadcast(splits), "split", "left_semi")

    @property
    def depth(self) -> int:
        return max(*self.settings.caches.fixed_depths, *self.settings.caches.greedy_floors, self.settings.caches.whole_levels)

    @property
    def intervals(self) -> DataFrame:
        """Ranks of the training corpus, cut after the caches' greatest depth."""

        def build() -> DataFrame:
            counts = self._once("counts", lambda: grams.suffix_counts(self.train, self.depth, self.fmt))
            return grams.with_intervals(counts)

        return self._once("intervals", build)

    @property
    def levels(self) -> DataFrame:
        return self._once("levels", lambda: grams.levels(self.intervals, list(range(1, self.depth + 1)), self.fmt, self.depth))

    @property
    def num_ranks(self) -> DataFrame:
        return corpus.stream_stats(self.train, self.fmt).select("num_ranks")

    def fixed(self, depth: int) -> DataFrame:
        return self._once(f"fixed{depth}", lambda: cache.fixed_cache(self.levels, self.num_ranks, depth, self.fmt))

    @property
    def largest_budget(self) -> int:
        return self.budgets.agg(F.max("budget")).first()[0]

    @property
    def frontier(self) -> Frontier:
        """Where the greedy caches of all budgets end."""
        caches = self.settings.caches
        wanted = sorted(r.budget for r in table(self.spark, self.sf_dir, "budgets").select("budget").where("budget is not null").distinct().collect())
        name = f"frontier-{self.settings.digest()}-{wanted}"
        return kept(self.spark, self.sf_dir, name, "documents", lambda: Frontier(self.train, self.fmt, caches.greedy_floors, caches.fixed_depths, wanted))

    @property
    def greedy_nodes(self) -> DataFrame:
        """What a greedy cache of the largest budget may hold."""

        def build() -> DataFrame:
            nodes = cache.with_parents(self.levels, self.num_ranks, self.fmt)
            return cache.deeper_levels(self.train, materialize(nodes), self.depth, self.fmt, self.largest_budget)

        return self._once("greedy_nodes", build)

    def greedy(self, floor: int) -> DataFrame:
        return self._once(f"greedy{floor}", lambda: cache.greedy_cache(self.greedy_nodes, self.num_ranks, floor, self.fmt, self.largest_budget))

    @property
    def queries(self) -> DataFrame:
        return self._once("queries", lambda: workload.sample_windows(self.heldout, self.settings.workload, self.fmt))

    @property
    def located(self) -> DataFrame:
        depth = max(self.settings.workload.lengths)
        return self._once("located", lambda: grams.locate(self.train, self.queries, depth, self.fmt))

    @property
    def root_cache(self) -> DataFrame:
        return cache.root_cache(self.num_ranks)

    @property
    def fixed_names(self) -> dict[int, str]:
        return {d: {1: "unigram", 2: "bigram", 3: "trigram"}.get(d, f"{d}-gram") for d in self.settings.caches.fixed_depths}

    @property
    def budgets(self) -> DataFrame:
        """The configured budgets and the sizes of the fixed caches."""
        rows = table(self.spark, self.sf_dir, "budgets").select("budget").where("budget is not null")
        for d in self.settings.caches.fixed_depths:
            rows = rows.unionAll(self.fixed(d).agg(F.max("cum_bytes").alias("budget")))
        return rows.distinct()

    def limits(self, floor: int) -> DataFrame:
        """(budget, entries, bytes) of the greedy cache; budgets below the floor are skipped."""
        return self.spark.createDataFrame(self.frontier.limits(floor), "budget bigint, entries bigint, bytes bigint")

    def _fixed_parts(self) -> list[tuple[DataFrame, str, int]]:
        """(entries, policy, floor_depth) of the caches that aren't greedy."""
        return [(self.root_cache, "none", 0), *((self.fixed(d), name, d) for d, name in self.fixed_names.items())]

    @property
    def sizes(self) -> DataFrame:
        """(policy, floor_depth, budget, entries, bytes) of all configurations."""
        rows = [(p, d, size, n, size) for p, d in [("none", 0), *((name, d) for d, name in self.fixed_names.items())] for n, size in [self.frontier.whole(d)]]
        rows += [("greedy", f, *x) for f in self.settings.caches.greedy_floors for x in self.frontier.limits(f)]
        return self.spark.createDataFrame(rows, "policy string, floor_depth int, budget bigint, entries bigint, bytes bigint")

    def resolved_fixed(self) -> DataFrame:
        """The answers of the caches that aren't greedy, from their entries."""

        def build() -> DataFrame:
            deepest = max(self.settings.workload.lengths)
            parts = [e.where(F.col("depth") <= deepest).withColumns({"policy": F.lit(p), "floor_depth": F.lit(f)}) for e, p, f in self._fixed_parts()]
            sizes = [e.agg(F.max("cum_bytes").alias("budget"), F.count("*").alias("entries")).select(F.lit(p).alias("policy"), F.lit(f).alias("floor_depth"), "budget", "entries") for e, p, f in self._fixed_parts()]
            return resolve.resolve(resolve.longest_prefixes(self.queries, workload.union_all(parts), workload.union_all(sizes), self.fmt), self.located)

        return self._once("resolved_fixed", build)

    def resolved(self) -> DataFrame:
        """The answers of all configurations, from where the caches end."""

        def build() -> DataFrame:
            parts = self.queries.where(F.col("key").isNotNull()).select(F.explode(F.transform(F.sequence(F.lit(1), F.col("length")), lambda d: F.substring("key", F.lit(1), d * self.fmt.width))).alias("key"))
            located = materialize(grams.locate(self.train, parts, max(self.settings.workload.lengths), self.fmt, self.frontier.text))
            fixed = [("none", 0), *((name, d) for d, name in self.fixed_names.items())]
            return resolve.resolve(resolve.ordered_prefixes(self.queries, located, self.frontier, fixed, self.fmt), located)

        wanted = self.frontier.budgets
        return self._once(f"resolved-{wanted}", build)

    def summary_fixed(self) -> DataFrame:
        return resolve.summarize(self.resolved_fixed())

    def summary(self) -> DataFrame:
        return resolve.summarize(self.resolved())

    def results(self) -> DataFrame:
        """The long result table: one row for each configuration and query length."""
        return self.summary().join(F.broadcast(self.sizes), ["policy", "floor_depth", "budget"])
