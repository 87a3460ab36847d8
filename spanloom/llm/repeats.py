"""Long exact spans that texts share, by recompression.

A text is its sequence of pieces. ROUNDS times, pairs whose first symbol is of the left and whose
second is of the right half of the alphabet are named as one symbol. A name is a hash of what it
names and of the round, so a round names alike on all executors without a shuffle, and equal
substrings get the same symbols but for the two ends: a round can change one symbol more at either
end, and a symbol holds at most 2**ROUNDS pieces, so 2**ROUNDS - 1 pieces of either end at most.
Runs of one symbol are left as they are, as equal symbols are of one half and never pair: a name
for a run would hold more pieces, and change with what stands beyond the ends. Whatever is left of
a shared span of SPAN pieces consists of at least WINNOW symbols; of each WINNOW symbols in a row
the first with the least hash is an anchor, so every shared span has an anchor in common, and the
pieces around it, up to the bound on what the ends change, lie in the span. Anchors with equal
surroundings in two texts reveal candidates; for these the spans of SPAN pieces about the anchor
are hashed whole (96 bits), and those that stand in two texts are merged into stretches. Of a run
every symbol may be an anchor; those of one text with equal surroundings whose spans overlap or
touch are joined to one.

No pairs of texts are formed: occurrences are grouped by hash, and a group only has to hold two
different texts, of which the least and the greatest id are kept, before the shuffle already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.similar import about, representatives, text_names
from spanloom.llm.tables import table
from spanloom.llm.text import U64, chunks, mix, pieces, windows
from spanloom.session import materialize

SPAN = 40
ROUNDS = 3
WINNOW = 4


def recompress(names: np.ndarray, bounds: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, first pieces, texts) after the rounds."""
    symbol, start = names.copy(), np.arange(len(names))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for r in range(rounds):
        seed = mix(np.array([0xC0DE + r], dtype=U64))[0]
        if len(symbol) < 2:
            break
        right = (mix(symbol ^ seed) & U64(1)).astype(bool)
        pair = ~right[:-1] & right[1:] & (text[1:] == text[:-1])
        at = np.flatnonzero(pair)
        symbol[at] = mix(mix(symbol[at] + seed) * U64(0x9E3779B97F4A7C15) + symbol[at + 1])
        keep = np.ones(len(symbol), dtype=bool)
        keep[at + 1] = False
        symbol, start, text = symbol[keep], start[keep], text[keep]
    return symbol, start, text


def anchors(names: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, least start, greatest start): each anchor with the piece numbers, from the
    text's first, at which spans of SPAN pieces start that may be revealed by it."""
    edge = 2**ROUNDS - 1
    symbol, start, text = recompress(names, bounds)
    rank = mix(symbol ^ U64(0xA11C))
    chosen = np.zeros(0, dtype=np.int64)
    if len(symbol) >= WINNOW:
        n = len(symbol) - WINNOW + 1
        least = np.stack([rank[j : j + n] for j in range(WINNOW)]).argmin(axis=0) + np.arange(n)
        chosen = np.unique(least[text[:n] == text[WINNOW - 1 :]])
    at, of = start[chosen], text[chosen]
    ok = (at - edge >= bounds[of]) & (at + edge <= bounds[of + 1])
    at, of = at[ok], of[ok]
    around = windows(names, 2 * edge)
    key = around[at - edge] if len(at) else names[:0]
    lo = np.maximum(at + edge - SPAN - bounds[of], 0)
    hi = np.minimum(at - edge - bounds[of], np.diff(bounds)[of] - SPAN)
    ok = lo <= hi
    of, key, lo, hi = of[ok], key[ok], lo[ok], hi[ok]
    # anchors of one text with one key whose spans overlap or touch are one; both ends rise with lo
    order = np.lexsort((lo, key, of))
    of, key, lo, hi = of[order], key[order], lo[order], hi[order]
    new = np.ones(len(of), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (key[1:] != key[:-1]) | (lo[1:] > hi[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(of)][: len(first)] - 1
    return of[first], key[first], lo[first], hi[last]


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """(id, h1, h2, n, keys, lo, hi) for each text of SPAN pieces or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches, ["id", "text"]):
            kept = [i for i, t in enumerate(texts) if t and ids[i] is not None]
            names, bounds = pieces([texts[i] for i in kept])
            h1, h2 = text_names(names, bounds)
            sizes = np.diff(bounds)
            of, key, lo, hi = anchors(names, bounds)
            order = np.argsort(of, kind="stable")
            of, key, lo, hi = of[order], key[order].view(np.int64), lo[order].astype(np.int32), hi[order].astype(np.int32)
            rows = np.flatnonzero(sizes >= SPAN)
            counts = np.bincount(of, minlength=len(kept))[rows]
            ends = np.zeros(len(rows) + 1, dtype=np.int32)
            np.cumsum(counts, out=ends[1:])
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (key, lo, hi)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[kept[i]] for i in rows], pa.int64()), pa.array(h1[rows].view(np.int64)), pa.array(h2[rows].view(np.int64)), pa.array(sizes[rows].astype(np.int32)), *lists],
                names=["id", "h1", "h2", "n", "keys", "lo", "hi"],
            )

    return docs.mapInArrow(run, "id bigint, h1 bigint, h2 bigint, n int, keys array<bigint>, lo array<int>, hi array<int>")


def _spans(docs: DataFrame) -> DataFrame:
    """(id, run, extra, at) of the spans about the shared anchors. docs: id, text, lo, hi."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, los, his, texts in chunks(batches, ["id", "lo", "hi", "text"]):
            names, bounds = pieces(texts)
            step = np.zeros(len(names) + 1, dtype=np.int64)
            of = np.repeat(np.arange(len(ids)), [len(x) for x in los])
            np.add.at(step, np.concatenate([np.asarray(x, dtype=np.int64) for x in los]) + bounds[of], 1)
            np.add.at(step, np.concatenate([np.asarray(x, dtype=np.int64) for x in his]) + bounds[of] + 1, -1)
            at = np.flatnonzero(np.cumsum(step) > 0)
            of = np.searchsorted(bounds, at, side="right") - 1
            run_, extra = windows(names, SPAN)[at], windows(mix(names ^ U64(0xE27A)), SPAN)[at]
            own = np.asarray(ids, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own[of]), pa.array(run_.view(np.int64)), pa.array((extra >> U64(32)).astype(np.uint32).view(np.int32)), pa.array((at - bounds[of]).astype(np.int32))], names=["id", "run", "extra", "at"])

    return docs.mapInArrow(run, "id bigint, run bigint, extra int, at int")


def _in_two(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that two different ids hold."""
    return rows.groupBy(*keys).agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x != y").select(*keys)


def shared_stretches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, first_word, n_words): every maximal stretch of pieces that is covered by runs of 40
    pieces which another row's text has too; overlapping and touching runs make one stretch.
    Null and short texts and null ids have none; ids are unique, repeated rows of one id count
    as one text. Texts of equal pieces form a class of which one is searched; all members of a
    class of two or more are one stretch whole. Other columns are ignored."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = materialize(_anchor_rows(docs))
    reps, members = representatives(rows)
    whole = rows.select("id", "n").join(members, "id").select("id", F.lit(0).cast("bigint").alias("first_word"), F.col("n").cast("bigint").alias("n_words")).distinct()
    found = reps.select("id", F.explode(F.arrays_zip("keys", "lo", "hi")).alias("k")).select("id", "k.keys", "k.lo", "k.hi")
    met = found.join(_in_two(found, ["keys"]), "keys")
    where = materialize(met.groupBy("id").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi")))
    spans = materialize(_spans(about(docs.where("text is not null"), where.select("id")).join(where, "id").select("id", "lo", "hi", "text")))
    shared = spans.join(_in_two(spans, ["run", "extra"]), ["run", "extra"]).select("id", "at")
    order = Window.partitionBy("id").orderBy("at")
    begins = F.coalesce((F.col("at") - F.lag("at").over(order) > SPAN).cast("int"), F.lit(1))
    islands = shared.withColumn("new", begins).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = islands.groupBy("id", "island").agg(F.min("at").cast("bigint").alias("first_word"), (F.max("at") - F.min("at") + SPAN).cast("bigint").alias("n_words")).drop("island")
    parts = parts.join(whole.select("id"), "id", "left_anti")
    return parts.unionAll(whole).withColumnRenamed("id", id_col)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_stretches(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p5_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document, null and short ones included: its pieces, those that occur elsewhere in
    spans of 40, and their share (0 for a text without pieces)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sizes = docs.select("doc_id", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\r]+"), lambda p: p != "")).cast("bigint").alias("n_pieces"))
    shared = shared_stretches(docs).groupBy("doc_id").agg(F.sum("n_words").alias("shared_pieces"))
    out = sizes.join(shared, "doc_id", "left").select("doc_id", "n_pieces", F.coalesce("shared_pieces", F.lit(0).cast("bigint")).alias("shared_pieces"))
    return out.withColumn("share", F.when(F.col("n_pieces") > 0, F.col("shared_pieces") / F.col("n_pieces")).otherwise(F.lit(0.0)))
