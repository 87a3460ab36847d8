"""Test passages in a training corpus, by binary search in suffix arrays of the corpus.

Every Arrow batch of the corpus is a shard. Its suffix array holds, in prefix order, the
suffixes that begin with two words which also stand together in a test passage; no other
suffix can share two words with one. A suffix is named by the hashes of its first 1, 2, 4 and
8 words, the names of prefix doubling, and the array is sorted by these in turn, so that the
suffixes with a common beginning lie together. Every suffix of every test passage is then
searched in all levels at once: its interval is narrowed by binary search to those that share
1, 2, 4 and 8 words, and what is left is extended word by word to the longest match. Only the
test passages, in blocks of bounded size, are sent to the executors; the corpus isn't shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.tables import heldout_splits, split_name, table
from spanloom.llm.text import U64, chunks, mix, plain_words, windows
from spanloom.session import materialize

#: Consecutive plain words of a passage that make a leak.
MIN_WORDS = 12
LEVELS = (1, 2, 4, 8)
#: Characters of test passages in a block; each block is a broadcast and a pass over the corpus.
BLOCK_CHARS = 8_000_000


def _levels(names: np.ndarray, bounds: np.ndarray) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """The names of the first 1, 2, 4 and 8 words of each suffix, 0 where the text is shorter,
    and the words left at each suffix."""
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(names))
    out = {}
    for k in LEVELS:
        w = np.zeros(len(names), dtype=U64)
        full = windows(names, k)
        w[: len(full)] = full
        w[left < k] = 0
        out[k] = w
    return out, left


@dataclass
class Passages:
    """The suffixes to search, sorted by item; need is how many words a match must have."""

    item: np.ndarray
    names: np.ndarray
    start: np.ndarray  # of the suffix in names
    offset: np.ndarray  # of the suffix in its item
    left: np.ndarray
    need: np.ndarray
    keys: dict[int, np.ndarray]
    pairs: np.ndarray  # bitmap of the names of two words
    ones: np.ndarray  # names of the items of one word


def prepare(ids: list[int], texts: list[str], min_words: int) -> Passages:
    names, bounds = plain_words(texts)
    levels, left = _levels(names, bounds)
    sizes = np.diff(bounds)
    item = np.repeat(np.arange(len(texts)), sizes)
    need = np.minimum(min_words, sizes)[item]
    start = np.flatnonzero(left >= need)
    pairs = np.zeros(1 << 22, dtype=bool)
    pairs[(levels[2][start] >> U64(42)).astype(np.int64)] = True
    single = start[need[start] == 1]
    return Passages(np.asarray(ids, dtype=np.int64)[item[start]], names, start, start - bounds[:-1][item[start]], left[start], need[start], {k: w[start] for k, w in levels.items()}, pairs, np.unique(levels[1][single]))


def _narrow(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query the part of its interval [lo, hi) of the sorted keys that equals q."""
    found = []
    for right in (False, True):
        a, b = lo.copy(), hi.copy()
        while (open_ := a < b).any():
            mid = (a + b) >> 1
            at = keys[np.minimum(mid, len(keys) - 1)]
            up = open_ & ((at <= q) if right else (at < q))
            a = np.where(up, mid + 1, a)
            b = np.where(open_ & ~up, mid, b)
        found.append(a)
    return found[0], found[1]


def search(names: np.ndarray, bounds: np.ndarray, p: Passages) -> list[np.ndarray]:
    """Maximal matches in one shard: number of the suffix in p, position in names, words."""
    none = [np.zeros(0, dtype=np.int64)] * 3
    if not len(names) or not len(p.start):
        return none
    levels, left = _levels(names, bounds)
    begins = p.pairs[(levels[2] >> U64(42)).astype(np.int64)] & (left > 1)
    if len(p.ones):
        begins |= np.isin(levels[1], p.ones)
    rows = np.flatnonzero(begins)
    if not len(rows):
        return none
    first = np.repeat(bounds[:-1], np.diff(bounds))  # where the text of each word starts
    ahead = np.zeros(len(names), dtype=U64)  # the word before each one in its text
    ahead[1:] = names[:-1]
    ahead[np.arange(len(names)) == first] = 0
    rows = rows[np.lexsort([ahead[rows], *(levels[k][rows] for k in reversed(LEVELS))])]  # the suffix array
    q = np.arange(len(p.start))
    lo, hi = np.zeros(len(q), dtype=np.int64), np.full(len(q), len(rows), dtype=np.int64)
    done = []
    depth = 0
    for k in (*LEVELS, None):
        stop = p.need[q] < k if k else np.ones(len(q), dtype=bool)
        if stop.any():
            begin, end, own = lo[stop], hi[stop], q[stop]
            if k is None:
                # what stands behind the same word as the suffix belongs to a longer match: left out
                # here already, as passages of one repeated word have very many such pairs
                inner = np.flatnonzero(p.offset[own] > 0)
                same, after = end.copy(), end.copy()
                same[inner], after[inner] = _narrow(ahead[rows], begin[inner], end[inner], p.names[p.start[own[inner]] - 1])
                begin, end, own = np.concatenate([begin, after]), np.concatenate([same, end]), np.concatenate([own, own])
            size = end - begin
            mine = np.repeat(own, size)
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
            at = rows[at]
            need = p.need[mine]
            ok = left[at] >= need
            mine, at, need = mine[ok], at[ok], need[ok]
            tail = need - depth  # the last depth words of the first need ones
            last = _levels_at(p, mine, tail, depth)
            ok = levels[depth][at + tail] == last
            done.append((mine[ok], at[ok]))
            q, lo, hi = q[~stop], lo[~stop], hi[~stop]
        if k is None or not len(q):
            break
        lo, hi = _narrow(levels[k][rows], lo, hi, p.keys[k][q])
        q, lo, hi, depth = *(x[lo < hi] for x in (q, lo, hi)), k
        if not len(q):
            break
    if not done:
        return none
    mine, at = (np.concatenate(x) for x in zip(*done))
    before = (p.offset[mine] > 0) & (at > first[at]) if len(at) else np.zeros(0, dtype=bool)
    before[before] = p.names[p.start[mine[before]] - 1] == names[at[before] - 1]
    mine, at = mine[~before], at[~before]
    words = p.need[mine].copy()
    most = np.minimum(p.left[mine], left[at])
    go = np.flatnonzero(words < most)
    while len(go):
        same = p.names[p.start[mine[go]] + words[go]] == names[at[go] + words[go]]
        go = go[same]
        words[go] += 1
        go = go[words[go] < most[go]]
    return [mine, at, words]


def _levels_at(p: Passages, mine: np.ndarray, tail: np.ndarray, depth: int) -> np.ndarray:
    """The names of depth words at tail words into the suffixes."""
    out = np.zeros(len(mine), dtype=U64)
    at = p.start[mine] + tail
    for j in range(depth):
        out *= U64(0x9E3779B97F4A7C15)
        out += p.names[np.minimum(at + j, len(p.names) - 1)]
    return mix(out)


def find_leaks(corpus: DataFrame, items: DataFrame, corpus_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item_id, doc_id, item_word, doc_word, n_words): every longest run of at least min_words
    plain words that an item and a document share; for a shorter item all its words. Null and
    wordless items and documents match nothing; repeated rows give repeated matches. The items
    are searched in blocks of block_chars characters, one after the other; the matches of a block
    are written before the next one is fetched."""
    spark = corpus.sparkSession
    known = items.select(F.col(item_id).cast("bigint").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    total = known.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = -(-total // block_chars) or 1
    rows = corpus.select(F.col(corpus_id).cast("bigint").alias("doc"), F.col(text_col).alias("text")).where("text is not null")
    found = []
    for b in range(n_blocks):
        block = known.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == b).collect()
        shared = spark.sparkContext.broadcast(prepare([r.item for r in block], [r.text for r in block], min_words))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            p = shared.value
            docs, names, sizes = [], [], []

            def flush() -> pa.RecordBatch:
                bounds = np.zeros(len(docs) + 1, dtype=np.int64)
                np.cumsum(np.concatenate(sizes) if sizes else [], out=bounds[1:])
                all_names = np.concatenate(names) if names else np.zeros(0, dtype=U64)
                mine, at, words = search(all_names, bounds, p)
                doc = np.searchsorted(bounds, at, side="right") - 1
                ids = np.asarray(docs, dtype=object)
                return pa.RecordBatch.from_arrays([pa.array(p.item[mine]), pa.array(list(ids[doc]), pa.int64()), pa.array(p.offset[mine], pa.int64()), pa.array(at - bounds[doc], pa.int64()), pa.array(words.astype(np.int64))], names=["item", "doc", "item_word", "doc_word", "n_words"])

            held = 0
            for ids, texts in chunks(batches, ["doc", "text"]):
                w, bounds = plain_words(texts)
                docs += ids
                names.append(w)
                sizes.append(np.diff(bounds))
                held += len(w)
                if held > 2_000_000:
                    yield flush()
                    docs, names, sizes, held = [], [], [], 0
            yield flush()

        found.append(materialize(rows.mapInArrow(run, "item bigint, doc bigint, item_word bigint, doc_word bigint, n_words bigint")))
        shared.destroy()
    return reduce(DataFrame.unionAll, found).withColumnsRenamed({"item": item_id, "doc": corpus_id})


def without_leaks(corpus: DataFrame, leaks: DataFrame, corpus_id: str = "doc_id") -> DataFrame:
    """The corpus without the documents that a match lies in; rows with a null id stay."""
    return corpus.join(leaks.select(corpus_id).distinct(), corpus_id, "left_anti")


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf_dir, "heldout_items").where(split_name("split").isin(heldout_splits(spark, sf_dir)))
    train = table(spark, sf_dir, "documents").where(split_name("split") == "train")
    return train, find_leaks(train.select("doc_id", "text"), items.select("item_id", "text"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir)[1].select("item_id", "doc_id").distinct()


def p4_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each longest match with its place in the item and in the document."""
    return _spans(spark, sf_dir)[1]


def p4_clean_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the split train, by source, without the affected documents."""
    train, spans = _spans(spark, sf_dir)
    left = without_leaks(train.select("doc_id", "source"), spans).groupBy("source").agg(F.count("*").alias("kept"))
    return left
