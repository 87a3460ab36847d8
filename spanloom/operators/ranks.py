"""The exact order of all suffixes: by packed tokens, then by prefix doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.config import TokenFormat
from spanloom.operators import suffixes
from spanloom.operators.prefix import running
from spanloom.session import materialize

#: Tokens that are compared one by one; suffixes that agree in more are told apart by doubling.
DEEPEST = 500


def suffix_ranks(docs: DataFrame, fmt: TokenFormat, first: int = suffixes.HEAD, deepest: int = DEEPEST) -> DataFrame:
    """(pos, rank): the rank of the suffix that starts at each token of the stream, separators
    included. The suffixes are sorted by their first `first` tokens in ranges of the order; those
    that agree in these are sorted by further tokens, each round by twice as many as before, to a
    depth of `deepest` or more. From there on a round joins each name with that of the suffix as
    many tokens further on, which doubles what a name stands for, until all names differ. Suffixes
    that differ already stay as they are. The end of the stream sorts before everything."""
    text = suffixes.blocks(docs, fmt, first)
    rows = suffixes.ranges(text)
    totals = sorted((r.part, r.n) for r in rows.select("part", "n").collect())  # one for each range
    before = dict(zip((p for p, _ in totals), np.cumsum([0, *(n for _, n in totals)]).tolist()))
    shared = rows.sparkSession.sparkContext.broadcast(before)

    def named(rows: DataFrame, full: int, known: bool) -> DataFrame:
        """(pos, rank, n) of the rows that differ from all others (known), or of the other ones."""
        ranged = "lo" not in rows.columns

        def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, part in enumerate(suffixes.column(batch, "part")):
                    get = lambda c, k: suffixes.unpacked(batch.column(batch.schema.get_field_index(c))[i].as_py(), k)  # noqa: E731, B023
                    pos, same = get("pos", "<i8"), get("same", "<i2")
                    at, lo = (np.arange(len(pos)), np.zeros(len(pos), dtype=np.int64)) if ranged else (get("at", "<i8"), get("lo", "<i8"))
                    which, group = suffixes.members(lo, same, full, 2)
                    rank = at[group]
                    if known:
                        which = np.setdiff1d(np.arange(len(pos)), which, assume_unique=True)
                        rank = at[which]
                    yield pa.RecordBatch.from_arrays([pa.array(pos[which]), pa.array(rank + shared.value[part]), pa.array(np.full(len(which), 1 if known else 2))], names=["pos", "rank", "n"])

        return rows.mapInArrow(give, "pos bigint, rank bigint, n bigint")

    done, full, depth = named(rows, first, True), first, first
    while (left := _tied(rows)) and depth < deepest:
        step = min(suffixes.AHEAD, suffixes.STEP if depth == first else 2 * full)
        rows = suffixes.further(text, rows, depth, full, step)
        full, depth = step, depth + step
        done = done.unionAll(named(rows, full, True))
    if left:
        done = _doubled(materialize(done.unionAll(named(rows, full, False))), depth)
    return done.select("pos", "rank")


def _tied(rows: DataFrame) -> int:
    return rows.agg(F.coalesce(F.sum("tied"), F.lit(0))).first()[0]


def _doubled(named: DataFrame, span: int) -> DataFrame:
    """named(pos, rank, n), whose names stand for span tokens, with names that all differ."""
    while not named.where("n > 1").isEmpty():
        later = named.select((F.col("pos") - span).alias("pos"), F.col("rank").alias("next"))
        unsure = named.where("n > 1").join(later, "pos", "left")
        digits = F.concat(F.lpad(F.hex("rank"), 16, "0"), F.lpad(F.hex(F.coalesce("next", F.lit(-1)) + 1), 16, "0"))
        again = _named(unsure.select("pos", digits.alias("name")))
        named = materialize(named.where("n = 1").unionAll(again))
        span *= 2
    return named


def _named(rows: DataFrame) -> DataFrame:
    """(pos, rank, n): the rank of each name among all rows, and how many rows have the name. A
    name starts with an earlier rank and keeps to the ranks of that one."""
    counts = materialize(rows.groupBy("name").agg(F.count("*").alias("n")))
    placed = running(counts, "name", {"before": F.col("n")}, before=True)
    placed = placed.withColumn("old", F.conv(F.substring("name", 1, 16), 16, 10).cast("bigint"))
    base = placed.groupBy("old").agg(F.min("before").alias("base"))
    placed = placed.join(base, "old").withColumn("before", F.col("old") + F.col("before") - F.col("base"))
    return materialize(rows.join(placed.select("name", F.col("before").alias("rank"), "n"), "name").select("pos", "rank", "n"))
