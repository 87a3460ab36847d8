"""Token windows, their counts, and their rank intervals in the order of all suffixes.

No suffix array is built: if every suffix is cut after its first `depth` tokens and after its
first separator, the number of suffixes before a key is the sum of the counts of the lesser cut
keys, so intervals are running sums over distinct keys. Every document but the last is followed
by the separator of the next one; the last ends the stream, and its shortened suffixes sort
before their continuations.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.config import TokenFormat
from spanloom.functions.keys import prefix, token_key
from spanloom.operators import suffixes
from spanloom.operators.prefix import numbered, running
from spanloom.session import materialize

#: Documents whose suffixes are put into one array; only memory depends on it.
DOCS_AT_A_TIME = 1000


def window_counts(docs: DataFrame, k: int, fmt: TokenFormat) -> DataFrame:
    """(key, cnt): the distinct windows of k tokens inside documents. Documents of fewer tokens
    have none."""
    keys = F.transform("toks", lambda t: token_key(t, fmt))
    long_enough = docs.where(F.size("toks") >= k).select(keys.alias("keys"))
    starts = F.sequence(F.lit(1), F.size("keys") - (k - 1))
    at = long_enough.select(F.explode(F.transform(starts, lambda i: F.array_join(F.slice("keys", i, k), ""))).alias("key"))
    return at.groupBy("key").agg(F.count("*").alias("cnt"))


def suffix_counts(docs: DataFrame, depth: int, fmt: TokenFormat) -> DataFrame:
    """(key, cnt) of all suffixes of the stream, cut after depth tokens and after the first
    separator. The counts sum up to the number of ranks."""
    last = F.broadcast(docs.agg(F.max("doc_id").alias("last")))
    keys = F.transform("toks", lambda t: token_key(t, fmt))
    ended = F.when(F.col("doc_id") == F.col("last"), keys).otherwise(F.concat(keys, F.array(F.lit(fmt.separator_key))))
    rows = docs.crossJoin(last).select(F.size("toks").alias("n"), ended.alias("keys"))
    starts = F.sequence(F.lit(1), F.col("n"))
    inner = rows.where("n > 0").select(F.explode(F.transform(starts, lambda i: F.array_join(F.slice("keys", i, depth), ""))).alias("key"))
    separators = docs.select(F.lit(fmt.separator_key).alias("key"))
    return inner.unionAll(separators).groupBy("key").agg(F.count("*").alias("cnt"))


def with_intervals(counts: DataFrame) -> DataFrame:
    """(key, cnt, lo, hi): [lo, hi) are the ranks of the suffixes that begin with the key."""
    return running(counts, "key", {"lo": F.col("cnt")}, before=True).withColumn("hi", F.col("lo") + F.col("cnt")).select("key", "cnt", "lo", "hi")


def _whole(key: Column, depth: int, fmt: TokenFormat) -> Column:
    """Whether the first depth tokens of a cut key are there, and none is the separator."""
    last = F.substring(key, (depth - 1) * fmt.width + 1, fmt.width)
    return (F.length(key) >= depth * fmt.width) & (last != fmt.separator_key)


def level(intervals: DataFrame, depth: int, fmt: TokenFormat, cut: int) -> DataFrame:
    """(depth, key, lo, hi, cnt) of the windows of depth <= cut tokens without separator, from the
    intervals of suffixes cut after `cut` tokens."""
    rows = intervals.where(_whole(F.col("key"), depth, fmt))
    if depth < cut:
        rows = rows.groupBy(prefix(F.col("key"), depth, fmt).alias("key")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("cnt").alias("cnt"))
    return rows.select(F.lit(depth).alias("depth"), "key", "lo", "hi", "cnt")


def levels(intervals: DataFrame, depths: list[int], fmt: TokenFormat, cut: int) -> DataFrame:
    return reduce(DataFrame.unionAll, (level(intervals, d, fmt, cut) for d in depths))


def children(parents: DataFrame, deeper: DataFrame, fmt: TokenFormat) -> DataFrame:
    """(parent_key, next_token_key, lo, hi, cnt, place): the next tokens of each prefix, the most
    frequent first, ties in rank order. deeper: the level below the parents. Places are differences
    of one global numbering, so that a frequent prefix needs no task of its own."""
    rows = deeper.withColumn("parent_key", F.expr(f"substring(key, 1, length(key) - {fmt.width})"))
    found = rows.join(parents.select(F.col("key").alias("parent_key")), "parent_key", "left_semi")
    order = F.concat("parent_key", F.lit("!"), F.lpad(F.hex(F.lit(1 << 62) - F.col("cnt")), 16, "0"), F.lpad(F.hex("lo"), 16, "0"))
    placed = numbered(materialize(found.withColumn("order", order)), "order", "number")
    first = placed.groupBy("parent_key").agg(F.min("number").alias("first"))
    place = (F.col("number") - F.col("first") + 1).cast("int")
    return placed.join(first, "parent_key").select("parent_key", F.substring("key", -fmt.width, fmt.width).alias("next_token_key"), "lo", "hi", "cnt", place.alias("place"))


def _token_bytes(toks: np.ndarray, width: int) -> np.ndarray:
    """The ids' bytes, least first, the last of them greater by one: zeros are no token, and come first."""
    raw = toks.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].copy()
    raw[:, -1] += 1
    return raw


def _suffix_heads(flat: np.ndarray, sizes: np.ndarray, ended: np.ndarray, width: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes from each byte on, `size` of them, as a view; where the tokens are; and the first eight of
    these bytes from each token on, as a number. Separators,
    which have only set bits, follow the documents but the last of all: what lies behind is of no account,
    as no query holds any."""
    text = np.full((len(flat) + len(sizes), width), 255, dtype=np.uint8)
    at = np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)
    text[at] = _token_bytes(flat, width)
    text[(np.cumsum(sizes + 1) - 1)[~ended]] = 0
    room = np.append(text.ravel(), np.zeros(size, dtype=np.uint8))
    lead = np.ndarray((len(text) * width,), dtype=">u8", buffer=room, strides=(1,))
    return np.lib.stride_tricks.sliding_window_view(room, size), at * width, lead[at * width].astype(np.uint64)


def _steps(marks: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For the search of a row among sorted rows of numbers, one column after another: the numbers of
    each column; the pairs of what comes before and the number there, as numbers; the first row of each."""
    node, out = np.zeros(len(marks), dtype=np.int64), []
    for column in marks.T:
        values, at = np.unique(column, return_inverse=True)
        pairs = node * (2 * len(values) + 1) + 2 * at + 1
        known, first = np.unique(pairs, return_index=True)
        node = np.searchsorted(known, pairs)
        out.append((values, known, np.append(first, len(marks))))
    return out


def _count_gaps(steps: list, leads: np.ndarray, rows: np.ndarray, per: int, upto: np.ndarray, below: np.ndarray) -> None:
    """Adds how many of the suffixes at rows have as many marks before them, to upto; to below those
    before or equal to them. Only suffixes that begin as a mark does are compared any further."""
    node = np.zeros(len(rows), dtype=np.int64)
    for k, (values, known, first) in enumerate(steps):
        words = leads[rows + k * per]
        at = np.searchsorted(values, words)
        there = values[np.minimum(at, len(values) - 1)] == words
        pairs = node * (2 * len(values) + 1) + 2 * at + there
        at = np.searchsorted(known, pairs) if k else at
        alike = known[np.minimum(at, len(known) - 1)] == pairs
        gaps = np.bincount(first[at[~alike]], minlength=len(upto))
        upto += gaps
        below += gaps
        rows, node = rows[alike], at[alike]
    upto += np.bincount(steps[-1][2][node], minlength=len(upto))
    below += np.bincount(steps[-1][2][node] + 1, minlength=len(upto))


def locate(docs: DataFrame, queries: DataFrame, depth: int, fmt: TokenFormat, text: suffixes.Blocks | None = None) -> DataFrame:
    """(key, lo, hi) for each distinct key of queries, of up to depth tokens without separator: its
    rank interval; for an absent key lo = hi is the rank where it would be inserted, and the empty
    key has all ranks. Null, longer and separator-holding keys have no row. The sorted keys, a
    workload of bounded size, are sent to all; each task counts its suffixes in the gaps between
    them, so what is shuffled are at most two numbers for each query and task. text: blocks of docs,
    which are read instead where they are there already."""
    wanted = queries.select("key").where(F.col("key").isNotNull() & (F.length("key") <= depth * fmt.width)).distinct()
    wanted = wanted.where(~F.exists(F.transform(F.sequence(F.lit(0), F.greatest(F.length("key") / fmt.width - 1, F.lit(0)).cast("int")), lambda i: F.substring("key", i * fmt.width + 1, F.lit(fmt.width))), lambda t: t == fmt.separator_key))
    spark = docs.sparkSession
    keys = sorted(r.key for r in wanted.collect())
    if not keys:
        return spark.createDataFrame([], "key string, lo bigint, hi bigint")
    ids = [np.frombuffer(bytes.fromhex(k), dtype=np.uint8).reshape(-1, fmt.token_bytes).astype(np.uint64) @ (np.uint64(1) << np.arange(0, 8 * fmt.token_bytes, 8, dtype=np.uint64)) for k in keys]
    top = max([suffixes._top(docs) if text is None else text.top, *(int(x.max()) for x in ids if len(x))])
    width = suffixes.token_bytes(top)
    bits = suffixes.token_bits(top, width)
    per = 64 // bits
    many = -(-depth // per)
    # what begins with a key lies between the key and the key with all bits set behind it
    codes = [suffixes._codes(_token_bytes(x, width).tobytes(), width, bits) for x in ids]
    lows, highs = (np.full((len(codes), many * per), fill, dtype=np.uint64) for fill in (0, (1 << bits) - 1))
    for i, c in enumerate(codes):
        lows[i, : len(c)] = highs[i, : len(c)] = c
    shifts = np.uint64(bits) * np.arange(per - 1, -1, -1, dtype=np.uint64)
    lows, highs = ((x.reshape(len(codes), many, per) << shifts).sum(axis=2, dtype=np.uint64).astype(">u8").view(f"S{8 * many}").ravel() for x in (lows, highs))
    marks = np.unique(np.concatenate([lows, highs]))
    shared = spark.sparkContext.broadcast(np.array([m.ljust(8 * many, b"\0") for m in marks.tolist()]).view(f"V{8 * many}").view(">u8").reshape(-1, many).astype(np.uint64))

    def whole(lists: pa.Array, ended: pa.Array) -> tuple[bytes, np.ndarray]:
        """The text of documents, and where its tokens are."""
        heads, at, _ = _suffix_heads(lists.flatten().to_numpy(), lists.value_lengths().to_numpy(), ended.to_numpy(zero_copy_only=False), width, 8)
        return heads[:-1:width, :width].tobytes(), at // width

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = _steps(shared.value)
        upto, below = np.zeros(len(marks) + 1, dtype=np.int64), np.zeros(len(marks) + 1, dtype=np.int64)
        for batch in batches:
            if "text" in batch.schema.names:
                texts = ((data, np.arange(n)) for data, n in zip(suffixes.column(batch, "text"), suffixes.column(batch, "n")))
            else:
                lists, ended = (batch.column(batch.schema.get_field_index(c)) for c in ("toks", "ended"))
                texts = (whole(lists.slice(a, DOCS_AT_A_TIME), ended.slice(a, DOCS_AT_A_TIME)) for a in range(0, len(lists), DOCS_AT_A_TIME))
            for data, starts in texts:
                # blocks have the tokens of the corpus alone, keys may have greater ones
                raw = np.frombuffer(data, dtype=np.uint8).reshape(-1, held)
                if held < width:
                    wide = np.zeros((len(raw), width), dtype=np.uint8)
                    wide[:, :held], wide[:, held - 1], wide[:, -1] = raw, raw[:, -1] - 1, 1
                    wide[raw[:, -1] == 0], wide[raw[:, -1] == 255] = 0, 255
                    raw = wide
                codes = suffixes._codes(raw.tobytes(), width, bits)
                leads = suffixes._words(np.append(codes, np.zeros(many * per, dtype=np.uint64)), bits)
                _count_gaps(steps, leads, starts, per, upto, below)
        gaps = np.flatnonzero(upto + below)
        yield pa.RecordBatch.from_arrays([pa.array(gaps), pa.array(upto[gaps]), pa.array(below[gaps])], names=["gap", "upto", "below"])

    if text is None:
        held, last = width, F.broadcast(docs.agg(F.max("doc_id").alias("last")))
        rows = docs.crossJoin(last).select((F.col("doc_id") != F.col("last")).alias("ended"), "toks")
    else:
        held, rows = text.width, text.table.select("n", "text")
    counts = rows.mapInArrow(count, "gap bigint, upto bigint, below bigint").groupBy("gap").agg(F.sum("upto").alias("upto"), F.sum("below").alias("below"))
    upto, below = np.zeros(len(marks) + 1, dtype=np.int64), np.zeros(len(marks) + 1, dtype=np.int64)
    for r in counts.collect():  # as many rows as there are marks
        upto[r.gap], below[r.gap] = r.upto, r.below
    lo, hi = np.cumsum(below)[np.searchsorted(marks, lows)], np.cumsum(upto)[np.searchsorted(marks, highs)]
    if keys and not keys[0]:
        lo[0], hi[0] = 0, docs.agg(F.coalesce(F.sum(F.size("toks") + 1), F.lit(0))).first()[0]
    return spark.createDataFrame(pa.table({"key": pa.array(keys, pa.string()), "lo": pa.array(lo, pa.int64()), "hi": pa.array(hi, pa.int64())}))
