"""Prefix caches as ordered tables.

A cache is a table of entries in the order in which its policy takes them; entry 0 is the root
(the empty key, all ranks, free). cum_bytes is the running cost, so a smaller budget is a prefix
of the table, and expanded_at is the number of entries from which on all children of the entry
are cached (null: never). The greedy policy takes the prefix with the largest interval next. As a
child's interval is no larger than its parent's, that order is a static sort by (-count, depth,
lo) of the parents: ties go to the shallower and then to the lesser prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.config import TokenFormat
from spanloom.functions.keys import entry_bytes, token_key
from spanloom.operators.prefix import running
from spanloom.session import materialize

#: A window with its ranks, and the least rank and the count of the window without its last token.
NODE = ["depth", "key", "lo", "hi", "cnt", "up", "up_cnt"]
COLUMNS = ["entry_no", "key", "depth", "lo", "hi", "cnt", "expanded_at", "cum_bytes"]


def _up(c: Column) -> Column:
    return F.lpad(F.hex(c.cast("bigint")), 16, "0")


def _down(c: Column) -> Column:
    return F.lpad(F.hex(F.lit(1 << 62) - c.cast("bigint")), 16, "0")


def root(num_ranks: DataFrame) -> DataFrame:
    """The root's row; num_ranks: one row with the column num_ranks."""
    n = F.col("num_ranks").cast("bigint")
    return num_ranks.select(F.lit(0).alias("depth"), F.lit("").alias("key"), F.lit(0).cast("bigint").alias("lo"), n.alias("hi"), n.alias("cnt"))


def root_cache(num_ranks: DataFrame) -> DataFrame:
    """The cache that holds nothing but the root."""
    zero = F.lit(0).cast("bigint")
    return root(num_ranks).select(zero.alias("entry_no"), "key", "depth", "lo", "hi", "cnt", F.lit(None).cast("bigint").alias("expanded_at"), zero.alias("cum_bytes"))


def fixed_cache(grams: DataFrame, num_ranks: DataFrame, depth: int, fmt: TokenFormat) -> DataFrame:
    """All windows of 1 to depth tokens, level by level in rank order; whatever lies above the
    last level is expanded once the next level is complete. grams: the levels 1 to depth."""
    rows = root(num_ranks).unionAll(grams.where(F.col("depth") <= depth).select("depth", "key", "lo", "hi", "cnt"))
    ordered = running(rows.withColumn("at", F.concat(_up(F.col("depth")), _up(F.col("lo")))), "at", {"number": F.lit(1), "cum_bytes": entry_bytes(F.col("depth"), fmt)})
    ends = rows.groupBy("depth").agg(F.count("*").alias("n"))
    upto = ends.alias("a").crossJoin(F.broadcast(ends.alias("b"))).where(F.expr("b.depth <= a.depth")).groupBy(F.col("a.depth")).agg(F.sum("b.n").alias("expanded_at"))
    upto = upto.select((F.col("depth") - 1).alias("depth"), "expanded_at")
    return ordered.join(F.broadcast(upto), "depth", "left").withColumn("entry_no", F.col("number") - 1).select(*COLUMNS)


def with_parents(grams: DataFrame, num_ranks: DataFrame, fmt: TokenFormat) -> DataFrame:
    """grams(depth, key, lo, hi, cnt) with up and up_cnt: the least rank and the count of the window
    without the last token. grams: whole levels from 1 on."""
    above = root(num_ranks).unionAll(grams.select("depth", "key", "lo", "hi", "cnt"))
    above = above.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("p"), F.col("lo").alias("up"), F.col("cnt").alias("up_cnt"))
    rows = grams.withColumn("p", F.expr(f"substring(key, 1, length(key) - {fmt.width})"))
    return rows.join(above, ["depth", "p"]).select(*NODE)


def deeper_levels(docs: DataFrame, nodes: DataFrame, depth: int, fmt: TokenFormat, max_bytes: int | None = None) -> DataFrame:
    """The windows of more than depth tokens whose parent occurs at least twice, with the columns
    of nodes, which has the levels up to depth; and nodes. A pass goes down as many levels as there
    are by then, so their number grows with the logarithm of the longest repeat. What is carried
    along are the places where repeated windows occur, not the whole corpus. Parents that a greedy
    cache of max_bytes can't come to, as more frequent ones fill it, aren't followed."""
    last = F.broadcast(docs.agg(F.max("doc_id").alias("last")))
    keys = F.transform("toks", lambda t: token_key(t, fmt))
    ended = F.when(F.col("doc_id") == F.col("last"), keys).otherwise(F.concat(keys, F.array(F.lit(fmt.separator_key))))
    texts = docs.crossJoin(last).select("doc_id", F.size("toks").alias("n"), ended.alias("keys"))
    starts = F.sequence(F.lit(0), F.col("n") - depth)
    at = texts.where(F.col("n") >= depth).select("doc_id", F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice("keys", i + 1, depth), ""))).alias("at", "key"))
    parents = nodes.where((F.col("depth") == depth) & (F.col("cnt") >= 2)).select("key", F.col("lo").alias("plo"), F.col("cnt").alias("pcnt"))
    places = materialize(at.join(parents, "key").select("doc_id", "at", "plo", "pcnt"))
    done = nodes
    while True:
        least = least_followed(done, max_bytes, fmt)
        places = places.where(F.col("pcnt") >= least)
        if places.isEmpty():
            return done
        step = depth
        beyond = F.array_join(F.slice("keys", F.col("at") + depth + 1, step), "")
        ahead = materialize(places.join(texts, "doc_id").select("doc_id", "at", "plo", "pcnt", beyond.alias("beyond")))
        counts = ahead.groupBy("plo", "beyond").agg(F.count("*").alias("cnt"), F.first("pcnt").alias("pcnt"))
        placed = running(counts.withColumn("order", F.concat(_up(F.col("plo")), "beyond")), "order", {"before": F.col("cnt")}, before=True)
        base = placed.groupBy("plo").agg(F.min("before").alias("base"))
        placed = materialize(placed.join(base, "plo").withColumn("lo", F.col("plo") + F.col("before") - F.col("base")).select("plo", "pcnt", "beyond", "cnt", "lo"))
        whole = F.floor(F.length("beyond") / fmt.width) - F.when(F.substring("beyond", -fmt.width, fmt.width) == fmt.separator_key, 1).otherwise(0)
        each = placed.where(whole > 0).withColumn("j", F.explode(F.sequence(F.lit(1), whole.cast("int")))).withColumn("part", F.expr(f"substring(beyond, 1, j * {fmt.width})"))
        below = materialize(each.groupBy("plo", "j", "part").agg(F.min("lo").alias("lo"), F.sum("cnt").alias("cnt"), F.first("pcnt").alias("pcnt")))
        above = below.where("cnt >= 2").select("plo", (F.col("j") + 1).alias("j"), F.col("part").alias("above"), F.col("lo").alias("up"), F.col("cnt").alias("up_cnt"))
        deep = below.where("j > 1").withColumn("above", F.expr(f"substring(part, 1, (j - 1) * {fmt.width})")).join(above, ["plo", "j", "above"])
        found = below.where("j = 1").select("plo", "j", "part", "lo", "cnt", F.col("plo").alias("up"), F.col("pcnt").alias("up_cnt")).unionAll(deep.select("plo", "j", "part", "lo", "cnt", "up", "up_cnt"))
        names = done.where(F.col("depth") == depth).select(F.col("lo").alias("plo"), F.col("key").alias("head"))
        level = found.join(names, "plo").select((F.col("j") + depth).alias("depth"), F.concat("head", "part").alias("key"), "lo", (F.col("lo") + F.col("cnt")).alias("hi"), "cnt", "up", "up_cnt")
        level = materialize(level)
        on = placed.where((whole == step) & (F.col("cnt") >= 2)).select("plo", "beyond", "lo", "cnt")
        places = materialize(ahead.drop("pcnt").join(on, ["plo", "beyond"]).select("doc_id", "at", F.col("lo").alias("plo"), F.col("cnt").alias("pcnt")))
        done = done.unionAll(level)
        depth += step


#: Counts below this are told apart one by one where the least count is looked for that a budget
#: reaches; greater ones by their power of two.
SMALL_COUNTS = 1024


def least_followed(nodes: DataFrame, max_bytes: int | None, fmt: TokenFormat) -> int:
    """The least count of a window whose children beyond the last level a cache of max_bytes may
    come to: the children of more frequent windows come first, and shallow ones among equals."""
    if max_bytes is None:
        return 2
    low = F.when(F.col("up_cnt") < SMALL_COUNTS, F.col("up_cnt")).otherwise(F.expr("bigint(pow(2, floor(log2(up_cnt))))"))
    costs = nodes.where("up_cnt >= 2").groupBy(low.alias("count")).agg(F.sum(entry_bytes(F.col("depth"), fmt)).alias("bytes")).orderBy(F.desc("count")).collect()
    spent = 0
    for row in costs:  # at most SMALL_COUNTS + 64 rows
        spent += row.bytes
        if spent > max_bytes:
            return max(2, row["count"] + (row["count"] < SMALL_COUNTS))
    return 2


def greedy_cache(nodes: DataFrame, num_ranks: DataFrame, floor: int, fmt: TokenFormat, max_bytes: int | None = None) -> DataFrame:
    """All windows of up to floor tokens, then the children of the cached prefix with the largest
    interval, most frequent first; prefixes that occur once are left as they are. nodes: from
    with_parents and deeper_levels. With max_bytes the cache ends with the last entry that fits, and
    a prefix not all of whose children fit isn't expanded; less than what the floor needs is an
    error. limit() cuts it to lesser budgets."""
    up = nodes.select("depth", "key", "lo", "hi", "cnt", "up", "up_cnt")
    order = lambda cnt, depth, lo: F.concat(F.lit("1"), _down(F.col(cnt)), _up(depth), _up(F.col(lo)))
    none = lambda t: F.lit(None).cast(t)
    shallow = root(num_ranks).unionAll(nodes.where(F.col("depth") <= floor).select("depth", "key", "lo", "hi", "cnt"))
    low = shallow.withColumn("at", F.concat(F.lit("0"), _up(F.col("depth")), _up(F.col("lo"))))
    deep = up.where((F.col("depth") > floor) & (F.col("up_cnt") >= 2)).withColumn("at", F.concat(order("up_cnt", F.col("depth") - 1, "up"), F.lit("0"), _down(F.col("cnt")), _up(F.col("lo"))))
    # a mark behind the last child of each parent says how many entries there are by then
    parents = root(num_ranks).unionAll(nodes.select("depth", "key", "lo", "hi", "cnt")).where((F.col("depth") >= floor) & (F.col("cnt") >= 2))
    marks = parents.select("depth", none("string").alias("key"), "lo", none("bigint").alias("hi"), none("bigint").alias("cnt"), F.concat(order("cnt", F.col("depth"), "lo"), F.lit("1")).alias("at"))
    rows = low.select("depth", "key", "lo", "hi", "cnt", "at").unionAll(deep.select("depth", "key", "lo", "hi", "cnt", "at")).unionAll(marks)
    rows = materialize(rows)  # it is gone through several times
    is_entry = F.col("key").isNotNull()
    ordered = running(rows, "at", {"number": is_entry.cast("int"), "cum_bytes": F.when(is_entry, entry_bytes(F.col("depth"), fmt))})
    full = shallow.groupBy("depth").agg(F.count("*").alias("n"))
    upto = full.alias("a").crossJoin(F.broadcast(full.alias("b"))).where(F.expr("b.depth <= a.depth")).groupBy(F.col("a.depth")).agg(F.sum("b.n").alias("by_level"))
    upto = upto.select((F.col("depth") - 1).alias("depth"), "by_level")
    marked = ordered.where(~is_entry).select("depth", "lo", F.col("number").alias("by_mark"))
    entries = ordered.where(is_entry)
    if max_bytes is not None:
        need = entries.where(F.col("depth") <= floor).agg(F.max("cum_bytes")).first()[0]
        if need > max_bytes:
            raise ValueError(f"all windows of up to {floor} tokens need {need} bytes, {max_bytes} are allowed")
        entries = entries.where(F.col("cum_bytes") <= max_bytes)
        # what doesn't fit whole, or was never followed, isn't expanded
        size = F.broadcast(entries.agg(F.count("*").alias("size"), F.max("cum_bytes").alias("spent")))
        marked = marked.crossJoin(size).where("by_mark <= size").drop("size", "spent")
    entries = entries.join(marked, ["depth", "lo"], "left").join(F.broadcast(upto), "depth", "left")
    return entries.withColumn("expanded_at", F.coalesce("by_level", "by_mark")).withColumn("entry_no", F.col("number") - 1).select(*COLUMNS)


def limits(cache: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget, entries, bytes): for each budget the number of leading entries that fit."""
    wanted = F.broadcast(budgets.select("budget").where("budget is not null").distinct())
    return cache.crossJoin(wanted).where("cum_bytes <= budget").groupBy("budget").agg(F.count("*").alias("entries"), F.max("cum_bytes").alias("bytes"))


def snapshot(cache: DataFrame, entries: int) -> DataFrame:
    """The cache as a build to a smaller budget leaves it; later expansions are undone."""
    return cache.where(F.col("entry_no") < entries).withColumn("expanded_at", F.when(F.col("expanded_at") <= entries, F.col("expanded_at")))


def save_cache(cache: DataFrame, path: str, fmt: TokenFormat) -> None:
    cache.withColumn("token_bytes", F.lit(fmt.token_bytes)).write.mode("overwrite").parquet(path)


def load_cache(spark, path: str, fmt: TokenFormat) -> DataFrame:
    rows = spark.read.parquet(path)
    widths = [r[0] for r in rows.select("token_bytes").distinct().limit(2).collect()]
    if any(w != fmt.token_bytes for w in widths):
        raise ValueError(f"{path} was built for tokens of {widths} bytes")
    return rows.drop("token_bytes")
