"""Filling containers of fixed capacity with texts, by multiway differencing (Karmarkar and Karp).

Items are dealt into groups of about GROUP_WINDOWS containers' worth each, by a hash of their id.
In a group every item starts as a partial partition of its own into k windows. The two partial
partitions with the largest differences between their windows are merged again and again, the
fullest windows of the one with the emptiest of the other, so that their imbalances cancel; at the
end one partition with nearly equal windows is left. Where windows exceed the capacity, one or two
of their items change places with up to two lesser ones of another window, as long as the total
excess falls. Where some is left, the window count rises and the items are differenced anew; the
first count is the least possible one. So every item lies where differencing and its exchanges
put it. An item longer than the capacity is cut into full pieces, each a container of its own, and a
rest, which is an item like others.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.tables import table
from spanloom.llm.tokenize import TOKENIZERS, count_tokens
from spanloom.session import materialize

#: Containers that a group of items would fill; a larger group leaves less unused space at its end.
GROUP_WINDOWS = 256
#: Windows' worth of excess for which the number of windows rises by one.
RISE = 4
#: Windows' worth of excess up to which pairs of items are tried.
NEARLY = 0.25
#: Windows, those with the most room, whose pairs of items are tried.
WIDEST = 24
#: Above this many pairs of items of one window only single items change places.
MOST_PAIRS = 400_000
#: Items of a group at most, on average.
GROUP_ITEMS = 20_000


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(window of each item, sum of each window): items in k windows of nearly equal sums."""
    n = len(sizes)
    left, right = [], []  # nodes from n on: the items of two nodes together
    heap = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        heap.append((-int(sizes[i]), len(heap), sizes[i : i + 1].astype(np.int64), np.array([i])))
    number = n
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        both = len(a) + len(b) - k  # windows that hold something of both
        if both <= 0:
            sums, nodes = np.concatenate([a, b]), np.concatenate([x, y])
        else:
            # a and b fall: the least `both` windows of a meet the least of b, crosswise
            pa, pb = a[len(a) - both :], b[len(b) - both :][::-1]
            new = np.arange(n + len(left), n + len(left) + both)
            left += x[len(a) - both :].tolist()
            right += y[len(b) - both :][::-1].tolist()
            sums = np.concatenate([a[: len(a) - both], pa + pb, b[: len(b) - both]])
            nodes = np.concatenate([x[: len(a) - both], new, y[: len(b) - both]])
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        spread = int(sums[0] - (sums[-1] if len(sums) == k else 0))
        heapq.heappush(heap, (-spread, number, sums, nodes))
        number += 1
    window = np.zeros(n, dtype=np.int64)
    sums = np.zeros(k, dtype=np.int64)
    if heap:
        _, _, got, nodes = heap[0]
        sums[: len(got)] = got
        for w, node in enumerate(nodes.tolist()):
            stack = [node]
            while stack:
                at = stack.pop()
                if at < n:
                    window[at] = w
                else:
                    stack += (left[at - n], right[at - n])
    return window, sums


def windows_for(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(window of each item, number of windows) with no window above capacity. No item may be."""
    if not len(sizes):
        return np.zeros(0, dtype=np.int64), 0
    k = max(1, -(-int(sizes.sum()) // capacity), int((2 * sizes > capacity).sum()))
    while True:
        window, sums = differencing(sizes, k)
        excess = _evened(sizes, window, sums, capacity, False)
        if 0 < excess <= NEARLY * capacity:
            excess = _evened(sizes, window, sums, capacity, True)
        if not excess:
            return window, k
        k = min(len(sizes), k + -(-excess // (RISE * capacity)))


def _takes(rows: np.ndarray, sizes: np.ndarray, window: np.ndarray, two: bool) -> tuple[np.ndarray, ...]:
    """(window, size, item, item or -1): the items of rows, with two also the pairs of one window."""
    order = rows[np.argsort(window[rows], kind="stable")]
    at = window[order]
    found = [(at, sizes[order], order, np.full(len(order), -1))]
    apart = 1
    while two and apart < len(at):
        i = np.flatnonzero(at[apart:] == at[:-apart])
        if not len(i):
            break
        x, y = order[i], order[i + apart]
        found.append((at[i], sizes[x] + sizes[y], x, y))
        apart += 1
    return tuple(np.concatenate(c) for c in zip(*found))


def _evened(sizes: np.ndarray, window: np.ndarray, sums: np.ndarray, capacity: int, pairs: bool) -> int:
    """Level out what differencing left above the capacity: an item of the fullest window (with
    pairs: one or two) changes places with none or one (or two) of a window with room, in the way
    that leaves the least total excess. The excess falls with each exchange, so it ends; what is left of it is returned.
    Changes window and sums."""
    stuck: set[int] = set()
    while True:
        over = [w for w in np.flatnonzero(sums > capacity).tolist() if w not in stuck]
        if not over:
            return int(np.maximum(sums - capacity, 0).sum())
        w = max(over, key=lambda x: sums[x])
        excess, room, best = int(sums[w] - capacity), capacity - sums, None
        open_ = np.flatnonzero(room > 0)
        for two in (False, True) if pairs else (False,):
            if two and (np.bincount(window).astype(np.int64) ** 2).sum() > MOST_PAIRS:
                break  # among so many items single ones fit
            wide = room > (np.partition(room, -WIDEST)[-WIDEST] - 1 if two and len(room) > WIDEST else 0)
            at, size, x, y = _takes(np.flatnonzero((wide & (room > 0))[window]), sizes, window, two)
            # what can be taken in exchange may also be nothing
            at, size = np.concatenate([at, open_]), np.concatenate([size, np.zeros(len(open_), dtype=size.dtype)])
            x, y = (np.concatenate([c, np.full(len(open_), -1)]) for c in (x, y))
            _, own, u, v = _takes(np.flatnonzero(window == w), sizes, window, two)
            for i in range(len(own)):
                less = own[i] - size
                left = np.where(less > 0, np.maximum(excess - less, 0) + np.maximum(less - room[at], 0), excess)
                c = int(left.argmin()) if len(left) else -1
                if c >= 0 and left[c] < (best[0] if best else excess):
                    best = (int(left[c]), int(at[c]), int(less[c]), (int(u[i]), int(v[i])), (int(x[c]), int(y[c])))
            if best and best[0] == 0:
                break
        if best is None:
            stuck.add(w)
            continue
        _, to, less, gone, back = best
        window[[i for i in gone if i >= 0]] = to
        window[[i for i in back if i >= 0]] = w
        sums[w] -= less
        sums[to] += less


def fill_containers(sizes: DataFrame, capacities: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """(capacity_id, container, id, piece, first, n): where each item, or each piece of an item
    longer than the capacity, lies. sizes: (id, size); capacities: (capacity_id, capacity), a few
    rows. Items of size 0, or of null size, lie in a container too and take no room; rows without
    an id are left out, and of repeated ids the largest size counts. Capacities below 1 and null
    ones are left out. Containers are named w-<group>-<window>, or f-<id>-<piece> for full pieces."""
    items = materialize(sizes.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.coalesce(F.max(size_col), F.lit(0)).cast("bigint").alias("size")))
    total = items.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("tokens"), F.count("*").alias("rows")).first()
    caps = capacities.select("capacity_id", F.col("capacity").cast("bigint").alias("capacity")).where("capacity >= 1").distinct()
    groups = F.greatest(F.ceil(F.lit(int(total.tokens)) / (F.col("capacity") * GROUP_WINDOWS)), F.lit(-(-total.rows // GROUP_ITEMS)), F.lit(1))
    rows = items.crossJoin(F.broadcast(caps)).withColumn("full", F.expr("size div capacity")).withColumn("rest", F.expr("size % capacity"))
    full = rows.where("full > 0").select("capacity_id", "capacity", "id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("piece"))
    full = full.select("capacity_id", F.format_string("f-%d-%d", "id", "piece").alias("container"), "id", "piece", (F.col("piece") * F.col("capacity")).alias("first"), F.col("capacity").alias("n"))
    loose = rows.where("rest > 0 or full = 0").select("capacity_id", "capacity", "id", "full", "rest", F.pmod(F.xxhash64("id"), groups).alias("group"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["rest", "id"], ascending=[False, True])
        rest, capacity = group["rest"].to_numpy(), int(group["capacity"].iloc[0])
        some = rest > 0
        window = np.zeros(len(rest), dtype=np.int64)
        window[some] = windows_for(rest[some], capacity)[0]
        name = [f"w-{group['group'].iloc[0]}-{w}" for w in window.tolist()]
        return pd.DataFrame({"capacity_id": group["capacity_id"], "container": name, "id": group["id"], "piece": group["full"], "first": group["full"] * capacity, "n": rest})

    packed = loose.groupBy("capacity_id", "group").applyInPandas(pack, "capacity_id int, container string, id bigint, piece bigint, first bigint, n bigint")
    return packed.unionAll(full.withColumn("capacity_id", F.col("capacity_id").cast("int"))).withColumnRenamed("id", id_col)


def _containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    caps = table(spark, sf_dir, "capacities")
    parts = None
    for (name,) in caps.select("tokenizer").where("tokenizer is not null").distinct().orderBy("tokenizer").collect():
        part = fill_containers(count_tokens(docs, tokenizer=name, path=TOKENIZERS), caps.where(F.col("tokenizer") == name))
        parts = part if parts is None else parts.unionAll(part)
    if parts is None:
        raise ValueError("no capacity names a tokenizer")
    return parts.withColumnsRenamed({"first": "first_token", "n": "n_tokens"})


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _containers(spark, sf_dir)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each capacity its containers, the tokens in them, the least number of containers that
    could hold these tokens, and the share of the room that is used."""
    caps = F.broadcast(table(spark, sf_dir, "capacities").select("capacity_id", "capacity").distinct())
    each = _containers(spark, sf_dir).groupBy("capacity_id", "container").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("items"))
    sums = each.groupBy("capacity_id").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"))
    return sums.join(caps, "capacity_id").withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity"))).withColumn("used", F.col("tokens") / (F.col("containers") * F.col("capacity")))
