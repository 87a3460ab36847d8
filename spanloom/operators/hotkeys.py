"""Statistics for each key although a few keys hold most rows, by value-frequency compression.

Rows are first grouped by key and value together. Such groups are spread over all executors even
where one key holds a third of the rows, and what is left are distinct values with weights, which
are then grouped by key: the number of values is the exact distinct count, the largest weight the
mode, and the running weight gives percentiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.prefix import running
from spanloom.session import materialize
from spanloom.sources.tables import table

#: Share of all lookups that makes a key hot.
HOT_SHARE = 0.015
#: Parts in which the values of one key are joined with the key's totals.
SALTS = 32


def compressed(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(*keys, value, weight): df grouped by keys and value; null is a key and a value like others."""
    return df.groupBy(*keys, value).agg(F.count("*").alias("weight"))


def key_statistics(df: DataFrame, key: str, value: str, percentiles: tuple[float, ...] = (0.5, 0.99)) -> DataFrame:
    """For each key: n (rows with a value), n_distinct, mode (the least of the most frequent
    values), least, greatest, and p50, p99, ... of a bigint value between -2**61 and 2**61, each
    the least value that at least that share of the rows doesn't exceed. A null key is a key like
    others; null values count nowhere, and a key without others has n = 0 and nulls. The running
    weights are summed in one global order of key and value, so that not even the distinct values
    of one key must fit into a task."""
    weights = compressed(df.select(F.col(key).alias("k"), F.col(value).cast("bigint").alias("v")), ["k"], "v")
    named = F.coalesce(F.concat(F.lit("1"), F.hex(F.encode(F.col("k").cast("string"), "utf-8"))), F.lit("0"))
    at = F.concat(named, F.lit("!"), F.lpad(F.hex(F.col("v") + F.lit(1 << 62)), 16, "0"))
    known = materialize(weights.where("v is not null").withColumn("at", at).withColumn("name", named))
    ran = running(known, "at", {"upto": F.col("weight")})
    mode = F.max_by("v", F.struct("weight", (-F.col("v")).alias("low")))
    sums = known.groupBy("name").agg(F.sum("weight").alias("n"), F.count("v").alias("n_distinct"), mode.alias("mode"), F.min("v").alias("least"), F.max("v").alias("greatest"))
    base = ran.groupBy("name").agg(F.min(F.col("upto") - F.col("weight")).alias("base")).join(sums.select("name", "n"), "name")
    pick = [(p, f"p{p * 100:g}".replace(".", "_")) for p in percentiles]
    # a key with very many values meets its totals in SALTS places
    salted = base.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    ran = ran.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    reached = ran.join(salted, ["name", "salt"]).groupBy("name").agg(*(F.min(F.when(F.col("upto") - F.col("base") >= F.col("n") * p, F.col("v"))).alias(c) for p, c in pick))
    keys = weights.select("k", named.alias("name")).distinct()
    out = keys.join(sums.join(reached, "name"), "name", "left")
    numbers = ["n_distinct", "mode", "least", "greatest", *(c for _, c in pick)]
    return out.select(F.col("k").alias(key), F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) if c == "n_distinct" else c for c in numbers))


def canonical_key(key: Column) -> Column:
    """The hex digits alone, in upper case: without the prefix 0x and without what stands
    between them. A key without digits is the empty one; null stays null."""
    bare = F.regexp_replace(F.upper(key), "^[^0-9A-F]*0X", "")
    return F.regexp_replace(bare, "[^0-9A-F]", "")


def hot_keys(hits: DataFrame, share: float = HOT_SHARE) -> DataFrame:
    """(key): the canonical keys, the empty one left out, that at least share of all distinct
    lookups have. Lookups without a key count in the total."""
    pairs = compressed(hits.where("lookup_id is not null").select("lookup_id", canonical_key(F.col("key")).alias("key")), ["key"], "lookup_id")
    total = hits.select("lookup_id").where("lookup_id is not null").distinct().agg(F.count("*").alias("total"))
    per_key = pairs.where("key is not null and key != ''").groupBy("key").agg(F.count("*").alias("n"))
    return per_key.crossJoin(F.broadcast(total)).where(F.col("n") >= F.col("total") * F.lit(share)).select("key")


def key_totals(hits: DataFrame) -> DataFrame:
    """(key, lookups, intervals, missing): for each canonical key, null included, its distinct
    lookups, the sum of their intervals from the lesser to the greater end, and how many have no
    interval. Of a lookup that was delivered several times, the delivery with the least arrival,
    then the least interval counts (one without a time or an interval only if there is no other).
    Deliveries are reduced to lookups by id before they meet under their key, where lookups of one
    key with equal intervals are compressed to one row with a weight."""
    size = (F.greatest("lo", "hi") - F.least("lo", "hi")).alias("size")
    both = F.col("lo").isNotNull() & F.col("hi").isNotNull()
    rows = hits.where("lookup_id is not null").select("lookup_id", canonical_key(F.col("key")).alias("key"), F.when(both, size).alias("size"), "arrived_at")
    late = F.lit("9999-12-31").cast("timestamp_ntz")
    first = F.struct(F.col("size").isNull(), F.coalesce(F.col("arrived_at").cast("timestamp_ntz"), late), F.col("size"))
    one = rows.groupBy("key", "lookup_id").agg(F.min_by("size", first).alias("size"))
    weights = compressed(one, ["key"], "size")
    return weights.groupBy("key").agg(
        F.sum("weight").alias("lookups"),
        F.coalesce(F.sum(F.col("size") * F.col("weight")), F.lit(0)).cast("bigint").alias("intervals"),
        F.coalesce(F.sum(F.when(F.col("size").isNull(), F.col("weight"))), F.lit(0)).cast("bigint").alias("missing"),
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot_keys(table(spark, sf_dir, "hits"))


def p1_key_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_totals(table(spark, sf_dir, "hits"))


def p1_key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distribution of interval sizes for each canonical key, over all deliveries."""
    hits = table(spark, sf_dir, "hits").select(canonical_key(F.col("key")).alias("key"), (F.greatest("lo", "hi") - F.least("lo", "hi")).alias("size"), "lo", "hi")
    return key_statistics(hits.withColumn("size", F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), F.col("size"))), "key", "size")
