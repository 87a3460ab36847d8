"""What the operators on similar texts share: classes of equal texts, frequent word runs, and
the exact similarity of candidate pairs.

The similarity of two texts is that of their sets of runs of three plain words: common runs
over all runs. Texts of fewer than 20 plain words, null texts among them, are similar to nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.text import U64, chunks, mix, plain_words, positions_in, windows
from spanloom.session import materialize

SHINGLE = 3
MIN_PLAIN_WORDS = 20
MIN_SIMILARITY = 0.6
#: In fewer documents than this no run is frequent.
FREQUENT_LEAST = 50
#: A run of words that at least this share of all documents holds is frequent.
FREQUENT_SHARE = 0.002
#: Bits for each id by which rows that belong to no id are held back (see about), and the powers of
#: two of the least and the greatest number of these bits.
BITS_PER_ID, LEAST_BITS, MOST_BITS = 16, 16, 28
#: Documents after which a task reports what runs are frequent among them.
COUNTED = 20_000


def first_runs(names: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, run name, position) of the distinct runs of width words of each text, sorted;
    positions are those of the first occurrences."""
    at = positions_in(bounds, width)
    text = np.searchsorted(bounds, at, side="right") - 1
    runs = windows(names, width)[at]
    order = np.lexsort((runs, text))
    text, runs, at = text[order], runs[order], at[order]
    new = np.ones(len(runs), dtype=bool)
    new[1:] = (runs[1:] != runs[:-1]) | (text[1:] != text[:-1])
    return text[new], runs[new], at[new]


def word_runs(names: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, run name) of the distinct runs of width words of each text, sorted."""
    return first_runs(names, bounds, width)[:2]


def text_names(names: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each text's sequence of plain words."""
    out = []
    for seed in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
        at = np.arange(len(names)) - np.repeat(bounds[:-1], np.diff(bounds))
        sums = np.zeros(len(names) + 1, dtype=U64)
        np.cumsum(mix(names ^ mix(at.astype(U64) + U64(seed))), out=sums[1:])
        out.append(mix((sums[bounds[1:]] - sums[bounds[:-1]]) ^ np.diff(bounds).astype(U64)))
    return out[0], out[1]


def parities(text: np.ndarray, runs: np.ndarray, n_texts: int, bits: int) -> np.ndarray:
    """Bits for each text, as 64-bit numbers, of which one is the parity of the runs that hash to it."""
    bit = (mix(runs ^ U64(0xB175)) % U64(bits)).astype(np.int64)
    odd = (np.bincount(text * bits + bit, minlength=n_texts * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n_texts, bits), axis=1).view(U64)


class Frequent:
    """Names of frequent runs, sorted, with the number of documents that hold each."""

    def __init__(self, names: np.ndarray, counts: np.ndarray):
        order = np.argsort(names)
        self.names, self.counts = names[order], counts[order]

    def count(self, runs: np.ndarray) -> np.ndarray:
        """The number of documents of each of runs; 0 for one that isn't frequent."""
        if not len(self.names):
            return np.zeros(len(runs), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.names, runs), len(self.names) - 1)
        return np.where(self.names[at] == runs, self.counts[at], 0)


def frequent_runs(df: DataFrame, width: int, share: float = FREQUENT_SHARE, text_col: str = "text") -> Frequent:
    """The word runs that stand in at least share of all documents, counted over all of them. A
    task reports, for each COUNTED documents it goes through, the runs that at least half that
    share of these hold, so a count is low by half the share at most, and every run that one and a
    half times the share hold is found however unevenly it is spread. What is in the list only
    moves work, as the order of runs is the same for all texts. At most (mean text length / share)
    names, however large df is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, docs = [], 0

        def report() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate(own) if own else np.zeros(0, dtype=U64), return_counts=True)
            keep = c >= max(2.0, share / 2 * docs)
            return pa.RecordBatch.from_arrays([pa.array(np.append(u[keep].view(np.int64), 0)), pa.array(np.append(c[keep], 0)), pa.array(np.append(np.zeros(keep.sum(), dtype=np.int64), docs))], names=["run", "n", "docs"])

        for (texts,) in chunks(batches, ["text"]):
            names, bounds = plain_words([t or "" for t in texts])
            own.append(word_runs(names, bounds, width)[1])
            docs += len(texts)
            if docs >= COUNTED:
                yield report()
                own, docs = [], 0
        yield report()

    counts = df.select(F.col(text_col).alias("text")).mapInArrow(run, "run bigint, n bigint, docs bigint").groupBy("run").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = materialize(counts)
    total = F.broadcast(counts.where("docs > 0").select(F.sum("docs").alias("total")))
    rows = counts.crossJoin(total).where(F.expr(f"n > 0 and n >= greatest({FREQUENT_LEAST}, {share} * total)")).select("run", "n").toPandas()
    return Frequent(rows["run"].to_numpy(dtype=np.int64).view(U64), rows["n"].to_numpy(dtype=np.int64))


def rarest_runs(text: np.ndarray, runs: np.ndarray, counts: np.ndarray, n_texts: int, least: float = MIN_SIMILARITY, more: float = 0.0, all_runs: bool = False) -> np.ndarray:
    """Numbers of the runs that a text must be found by, in order. All runs are in one order, the
    rare ones (count 0) by their names, then the frequent ones by count. Sets that have at least
    `least` of their union in common share one of the first n - ceil(least * n) + 1 runs of each,
    and if they share any rare run then also a rare one among these. Returned are the rare ones
    (with all_runs the others too) of these and of `more * n` further ones. text and runs as
    word_runs gives them."""
    order = np.lexsort((counts, text))  # stable, so runs of one count stay in order of their names
    size = np.bincount(text, minlength=n_texts)
    first = np.cumsum(size) - size
    of = text[order]
    place = np.arange(len(order)) - first[of]
    head = size - np.ceil(least * size - 1e-9).astype(np.int64) + 1 + (more * size).astype(np.int64)
    return order[(place < head[of]) & (all_runs | (counts[order] == 0))]


def copies(rows: DataFrame, *flags: str) -> DataFrame:
    """(id, rep, *flags, any_*): the members of each class of several of rows with id, h1 and h2,
    where texts of equal words share h1 and h2; rep is the least id of the class. flags: boolean
    columns; any_<flag> says whether any member of the class has it."""
    keys = ["h1", "h2"]
    small = rows.select("id", *keys, *flags)
    several = small.groupBy(*keys).agg(F.min("id").alias("rep"), F.max("id").alias("last"), *(F.bool_or(f).alias(f"any_{f}") for f in flags)).where("rep != last").drop("last")
    return materialize(small.join(several, keys).select("id", "rep", *flags, *(f"any_{f}" for f in flags)).distinct())


def first_of_copies(rows: DataFrame, members: DataFrame, *flags: str) -> DataFrame:
    """The rows (with id and flags) that are no copies, and the first one of each class of members,
    whose flags are true where any member's are. Which rows near a class of several (see about)
    these are is found from their ids; only they are shuffled whole, not the copies. Repeated rows
    of such an id count once."""
    near, far = about(rows, members.select("id"), both=True)
    of = members.where("id = rep").select("id", *(f"any_{f}" for f in flags)).distinct()
    others = near.select("id").join(members.select("id"), "id", "left_anti").distinct()
    wanted = materialize(of.unionAll(others.select("id", *(F.lit(None).cast("boolean") for _ in flags))))
    kept = about(near, wanted.select("id")).join(wanted, "id").dropDuplicates(["id"])
    kept = kept.withColumns({f: F.coalesce(f"any_{f}", f) for f in flags}).select(*rows.columns)
    return far.select(*rows.columns).unionAll(kept)


def representatives(rows: DataFrame, *flags: str) -> tuple[DataFrame, DataFrame]:
    """The first row of each class of texts of equal words, and the members of classes of several
    as (id, rep, *flags); see first_of_copies and copies."""
    members = copies(rows, *flags)
    return first_of_copies(rows, members, *flags), members.select("id", "rep", *flags)


def about(texts: DataFrame, ids: DataFrame, both: bool = False):
    """The rows of texts that may belong to ids (one column, cheap to read): those whose id hashes
    to a bit that one of ids hashes to. There are BITS_PER_ID bits or more for each of ids, so at
    most one of that many other rows is let through; they are broadcast, MOST_BITS (32 MB) at most.
    With more ids fewer rows are held back, and the join that follows is right in any case. With
    both, a second table has the other rows."""
    bits = 1 << max(LEAST_BITS, min(MOST_BITS, (BITS_PER_ID * ids.count()).bit_length()))
    bit = f"pmod(xxhash64({{}}), {bits}L)"
    own = ids.select(F.expr(bit.format(ids.columns[0])).alias("at"))
    words = own.groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("bits"))
    held = words.groupBy(F.expr("shiftright(word, 6)").alias("__chunk")).agg(F.map_from_entries(F.collect_list(F.struct(F.expr("word & 63"), "bits"))).alias("of"))
    held = held.select("__chunk", F.expr("transform(sequence(0L, 63L), i -> coalesce(of[i], 0L))").alias("__bits"))
    marked = texts.join(F.broadcast(held), F.expr(f"shiftright({bit.format('id')}, 12)") == F.col("__chunk"), "left")
    hit = F.expr(f"coalesce(getbit(__bits[int(shiftright({bit.format('id')}, 6) & 63)], int({bit.format('id')} & 63)), 0) = 1")
    near = marked.where(hit).select(*texts.columns)
    return (near, marked.where(~hit).select(*texts.columns)) if both else near


def verified_pairs(pairs: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = MIN_SIMILARITY, cover: bool = False) -> DataFrame:
    """(a, b, similarity, cover_a, cover_b) of the pairs (a, b) whose texts are similar by
    least or more; cover is the share of a text's words that lie in runs of eight words which
    the other text has too (null unless asked for). Each pair's two texts are brought together by joins on the id."""

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = about(texts, pairs.select("a").unionAll(pairs.select("b")))
    left = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a")
    both = left.join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, ta, b, tb in chunks([batch.select(["a", "text_a", "b", "text_b"])], ["a", "text_a", "b", "text_b"]):
                distinct = {t: i for i, t in enumerate(dict.fromkeys([*ta, *tb]))}
                names, bounds = plain_words(list(distinct))
                text, runs = word_runs(names, bounds, SHINGLE)
                cut = np.searchsorted(text, np.arange(len(distinct) + 1))
                eights = windows(names, 8)
                for k in range(len(a)):
                    i, j = distinct[ta[k]], distinct[tb[k]]
                    if min(bounds[i + 1] - bounds[i], bounds[j + 1] - bounds[j]) < MIN_PLAIN_WORDS:
                        continue
                    x, y = runs[cut[i] : cut[i + 1]], runs[cut[j] : cut[j + 1]]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if common >= least * (len(x) + len(y) - common) - 1e-9:
                        shares = (None, None)
                        if cover:
                            u, v = (eights[bounds[t] : max(bounds[t], bounds[t + 1] - 7)] for t in (i, j))
                            shares = (_covered(u, v), _covered(v, u))
                        out.append((a[k], b[k], common / (len(x) + len(y) - common), *shares))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 2 + [pa.float64()] * 3)], names=["a", "b", "similarity", "cover_a", "cover_b"])

    return both.mapInArrow(run, "a bigint, b bigint, similarity double, cover_a double, cover_b double")


def _covered(u: np.ndarray, v: np.ndarray) -> float:
    if not len(u):
        return 0.0
    step = np.zeros(len(u) + 8, dtype=np.int64)
    hit = np.flatnonzero(np.isin(u, v))
    np.add.at(step, hit, 1)
    np.add.at(step, hit + 8, -1)
    return float((np.cumsum(step)[: len(u) + 7] > 0).mean())
