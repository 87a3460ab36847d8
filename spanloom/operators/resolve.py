"""Answering many count queries at once from caches and searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.config import TokenFormat
from spanloom.functions.steps import search_steps
from spanloom.operators.frontier import Frontier


def longest_prefixes(queries: DataFrame, caches: DataFrame, configs: DataFrame, fmt: TokenFormat) -> DataFrame:
    """(length, qid, key, policy, floor_depth, budget, depth, lo, hi, exact, expanded): for each
    query and each configuration the longest cached prefix. caches: the entries of each cache, with
    policy and floor_depth; configs: (policy, floor_depth, budget, entries), a few rows, where
    entries is how many leading ones of the cache count. Every cache holds its root, so each query
    has a hit. Null keys have none, repeated queries one each. A query meets each cache once,
    whatever the number of its budgets, and the roots, which all queries share, aren't joined."""
    each = queries.where(F.col("key").isNotNull()).select("length", "qid", "key").distinct()
    entry = F.struct("depth", "entry_no", "lo", "hi", "expanded_at")
    tries = each.select("length", "qid", F.col("key").alias("query"), F.explode(F.sequence(F.lit(1), F.col("length"))).alias("d"))
    tries = tries.select("length", "qid", "query", F.expr(f"substring(query, 1, d * {fmt.width})").alias("key"))
    met = tries.join(caches.where("depth > 0"), "key").groupBy("length", "qid", F.col("query").alias("key"), "policy", "floor_depth").agg(F.collect_list(entry).alias("met"))
    roots = caches.where("depth = 0").select("policy", "floor_depth", entry.alias("root"))
    rows = each.crossJoin(F.broadcast(configs.select("policy", "floor_depth", "budget", "entries").join(roots, ["policy", "floor_depth"])))
    rows = rows.join(met, ["length", "qid", "key", "policy", "floor_depth"], "left")
    best = F.coalesce(F.array_max(F.filter("met", lambda e: e.entry_no < F.col("entries"))), F.col("root"))
    rows = rows.withColumn("h", best)
    return rows.select("length", "qid", "key", "policy", "floor_depth", "budget", "h.depth", "h.lo", "h.hi", (F.col("h.depth") == F.col("length")).alias("exact"), F.coalesce(F.col("h.expanded_at") <= F.col("entries"), F.lit(False)).alias("expanded"))


#: An end before the windows of any class.
NOTHING = (-(1 << 62), 0, 0, 0, 0)


def ordered_prefixes(queries: DataFrame, located: DataFrame, frontier: Frontier, fixed: list[tuple[str, int]], fmt: TokenFormat) -> DataFrame:
    """As longest_prefixes, for the greedy caches of a frontier and the fixed ones of (policy, depth):
    whether a cache holds a prefix, and all its children, follows from where its order ends.
    located: (key, lo, hi) of all prefixes of the queries among all ranks."""
    deepest = queries.agg(F.max("length")).first()[0] or 0
    deep = sum(n > 0 for n in frontier.levels[1:])
    rows = [(policy, depth, size, NOTHING) for policy, depth in fixed for _, size in [frontier.whole(depth)]]
    for floor in frontier.floors:
        for budget, _, c in frontier.cuts(floor, deepest):
            rows.append(("greedy", floor, budget, None if c is None else (-c.count, c.depth - 1, c.up, -c.cnt, c.lo)))
    end = "struct<a:bigint,b:bigint,c:bigint,d:bigint,e:bigint>"
    configs = queries.sparkSession.createDataFrame(rows, f"policy string, floor_depth int, budget bigint, end {end}")
    each = queries.where(F.col("key").isNotNull()).select("length", "qid", "key").distinct()
    tries = each.select("length", "qid", F.col("key").alias("query"), F.explode(F.sequence(F.lit(1), F.col("length"))).alias("d")).select("length", "qid", "query", "d", F.expr(f"substring(query, 1, d * {fmt.width})").alias("key"))
    met = tries.join(located, "key").groupBy("length", "qid", F.col("query").alias("key")).agg(F.sort_array(F.collect_list(F.struct("d", "lo", "hi"))).alias("met"))
    top = F.struct(F.lit(0).alias("d"), F.lit(0).cast("bigint").alias("lo"), F.lit(frontier.ranks).cast("bigint").alias("hi"))
    path = met.withColumn("path", F.concat(F.array(top), "met")).drop("met")
    at = lambda *v: F.struct(*(x.cast("bigint").alias(n) for x, n in zip(v, "abcde")))
    size = lambda e: e.hi - e.lo
    everything, floor = F.col("end").isNull(), F.col("floor_depth")

    def held(e: Column) -> Column:
        up = F.get("path", e.d - 1)
        here = at(-size(up), e.d - 1, up.lo, -size(e), e.lo)
        return (e.d == 0) | ((size(e) > 0) & ((e.d <= floor) | ((size(up) >= 2) & (everything | (here < F.col("end"))))))

    whole = F.struct(F.col("end.a").alias("a"), F.col("end.b").alias("b"), F.col("end.c").alias("c"))
    below = F.struct(*(x.cast("bigint").alias(n) for x, n in ((-size(F.col("h")), "a"), (F.col("h.d"), "b"), (F.col("h.lo"), "c"))))
    expanded = F.when(F.col("h.d") < floor, F.col("h.d") < F.lit(deep)).otherwise((size(F.col("h")) >= 2) & (everything | (below < whole)))
    hits = path.crossJoin(F.broadcast(configs)).withColumn("h", F.array_max(F.filter("path", held)))
    return hits.select("length", "qid", "key", "policy", "floor_depth", "budget", F.col("h.d").alias("depth"), "h.lo", "h.hi", (F.col("h.d") == F.col("length")).alias("exact"), F.coalesce(expanded, F.lit(False)).alias("expanded"))


def resolve(hits: DataFrame, located: DataFrame) -> DataFrame:
    """hits with found_lo, found_hi, cnt and steps: a cached query is answered as it stands, one
    whose longest prefix is expanded is absent, and any other is searched in the prefix's ranks.
    located: (key, lo, hi) of the queries among all ranks."""
    true = located.select("key", F.col("lo").alias("true_lo"), F.col("hi").alias("true_hi"))
    rows = hits.join(true, "key")
    known = F.col("exact") | F.col("expanded")
    lo = F.when(F.col("exact"), F.col("lo")).when(F.col("expanded"), F.col("lo")).otherwise(F.col("true_lo"))
    hi = F.when(F.col("exact"), F.col("hi")).when(F.col("expanded"), F.col("lo")).otherwise(F.col("true_hi"))
    steps = F.when(known, F.lit(0).cast("bigint")).otherwise(search_steps(F.col("lo"), F.col("hi"), F.col("true_lo"), F.col("true_hi")))
    return rows.select(*hits.columns, lo.alias("found_lo"), hi.alias("found_hi"), (hi - lo).alias("cnt"), steps.alias("steps"))


def summarize(resolved: DataFrame) -> DataFrame:
    """(policy, floor_depth, budget, length, queries, mean, p50, p99): exact percentiles with
    linear interpolation."""
    return resolved.groupBy("policy", "floor_depth", "budget", "length").agg(
        F.count("*").alias("queries"),
        (F.sum("steps") / F.count("*")).alias("mean"),
        F.percentile("steps", F.lit(0.5)).alias("p50"),
        F.percentile("steps", F.lit(0.99)).alias("p99"),
    )
