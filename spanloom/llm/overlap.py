"""The same or almost the same text in the training and the held-out splits, by a partitioned
suffix array.

The texts are concatenated and their suffixes put in order of the names of their first words: of
the first three, then of six, then of twelve. The array is cut into ranges of that order, one for
each task, and in each range adjacent suffixes with a common prefix are compared: where both kinds
of split stand in a stretch of suffixes with equal first words, their texts share a span there.

Not every suffix is needed. Texts of a similarity of 0.6 have so many runs of three words in common
that they share one of the rarest 40 % of the runs of each (all runs being in one order, the rare
ones by name, then those that many documents hold, by count). So the array holds the suffixes that
begin with one of the rarest 43 % of its text's distinct runs, and no others; this loses no pair.
Suffixes meet only if the parities of their texts' runs don't rule the similarity out, as a run in
one text alone changes one parity at most: what else shares a span, a number that grows with the
square of the collection, is dropped where it is met and goes nowhere. By their places in that order
it is known how many spans a pair must share within what the array holds, which excludes nearly all
others before their texts are fetched; of the rest the exact similarity is computed from the whole
texts, and the coverage by their shared spans. The ranges of the array are gone through in groups,
one after the other, so that only a group of them is on disk at a time.

Runs that very many documents hold don't stand in the array. Texts without a rare run in common can
only be similar if the frequent runs are most of both: these texts are classed by their set of
frequent runs, the classes are searched by the rarest of these runs in the same way, and members of
two classes are paired only where they have so few other runs that they can be similar.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.similar import MIN_PLAIN_WORDS, MIN_SIMILARITY, SHINGLE, Frequent, copies, first_of_copies, first_runs, frequent_runs, parities, rarest_runs, text_names, verified_pairs
from spanloom.llm.tables import heldout_splits, split_name, table
from spanloom.llm.text import U64, chunks, mix, plain_words, windows
from spanloom.session import materialize

#: Share of the documents from which on a run is frequent, so that a stretch of the array that
#: begins with one run has at most that share of the texts.
FREQUENT = 0.0005
#: Bits of a suffix's place in the order: those of its first 3, 6 and 12 words.
PLACE_BITS = ((3, 44), (6, 10), (12, 10))
#: Share of the smaller of two sets that must be in common among the leading suffixes, and by which
#: these are more than the least number.
SLACK = 0.05
#: Bits of the parity sketch that suffixes carry.
BITS = 512
#: Groups of ranges that the array is gone through in, at most, and texts for each of these.
GROUPS, GROUP_TEXTS = 8, 1_000
#: Levels of the number of rare runs by which members of classes are brought together.
LEVELS = 16


def places(names: np.ndarray, bounds: np.ndarray, at: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The place of each suffix in the order; words beyond the text's end count as none."""
    out = np.zeros(len(at), dtype=U64)
    for words, bits in PLACE_BITS:
        level = np.zeros(len(at), dtype=U64)
        inside = at + words <= bounds[text + 1]
        level[inside] = windows(names, words)[at[inside]] >> U64(64 - bits)
        out = (out << U64(bits)) | level
    return out


def suffixes(docs: DataFrame, frequent: Frequent, rare: bool) -> DataFrame:
    """A row for each text of docs (id, held, taught, text) of 20 plain words or more: id, held,
    taught, h1, h2, n (distinct runs), r (rare ones among them), places (of its suffixes in the
    array, in order of their runs) and bits (parities of its runs). Without rare, places are those of
    the frequent runs for texts that these alone could make similar to another, common is the name
    of the set of these, and there are no bits."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, held, taught, texts in chunks(batches, ["id", "held", "taught", "text"]):
            kept = [i for i, t in enumerate(texts) if t and ids[i] is not None]
            names, bounds = plain_words([texts[i] for i in kept])
            h1, h2 = text_names(names, bounds)
            text, runs, at = first_runs(names, bounds, SHINGLE)
            counts = shared.value.count(runs)
            often = counts > 0
            n = np.bincount(text, minlength=len(kept))
            r = n - np.bincount(text[often], minlength=len(kept))
            alone = ((n - r) >= MIN_SIMILARITY * n)[text] & often
            some = np.ones(len(text), dtype=bool) if rare else alone
            t, a = text[some], at[some]
            first = rarest_runs(t, runs[some], counts[some], len(kept), more=SLACK * MIN_SIMILARITY, all_runs=not rare)
            ends = np.searchsorted(t[first], np.arange(len(kept) + 1))
            place = places(names, bounds, a[first], t[first]).view(np.int64)
            sums = np.zeros(len(kept), dtype=U64)
            np.add.at(sums, text[alone], mix(runs[alone] ^ U64(0xC1A55)))
            rows = np.flatnonzero(np.diff(bounds) >= MIN_PLAIN_WORDS)
            common = pa.array(mix(sums)[rows].view(np.int64), mask=np.bincount(text[alone], minlength=len(kept))[rows] == 0)
            bits = parities(text, runs, len(kept), BITS)[rows].tobytes() if rare else b""
            bits = pa.array([bits[i * BITS // 8 : (i + 1) * BITS // 8] if rare else None for i in range(len(rows))], pa.binary())
            own = lambda x, kind: pa.array([x[kept[i]] for i in rows], kind)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [own(ids, pa.int64()), own(held, pa.bool_()), own(taught, pa.bool_()), *(pa.array(x[rows].view(np.int64)) for x in (h1, h2)), *(pa.array(x[rows].astype(np.int32)) for x in (n, r)), common, pa.array([place[ends[i] : ends[i + 1]] for i in rows], pa.list_(pa.int64())), bits],
                names=["id", "held", "taught", "h1", "h2", "n", "r", "common", "places", "bits"],
            )

    return docs.select("id", "held", "taught", "text").mapInArrow(run, "id bigint, held boolean, taught boolean, h1 bigint, h2 bigint, n int, r int, common bigint, places array<bigint>, bits binary")


def sharing(head: np.ndarray, ids: np.ndarray, n: np.ndarray, known: np.ndarray, rank: np.ndarray, kind: np.ndarray, least: float, bits: np.ndarray | None = None) -> list[np.ndarray]:
    """(a, b, need) of the suffixes, in order of head, that share their first words and stand in
    texts of both kinds that may be similar by their parities (bits). n: size of the text's set, known: how many of its runs the array may
    hold, rank: the run's place among them. Two sets need o runs in common; all but the first
    n - o + s of a set hold o - s of these at most, so s or more are among the first ones."""
    out = []
    i, apart = np.arange(len(head)), 1
    while True:
        i = i[i + apart < len(head)]
        i = i[head[i] == head[i + apart]]
        if not len(i):
            break
        j = i + apart
        ok = (((kind[i] & 1) & (kind[j] >> 1)) | ((kind[i] >> 1) & (kind[j] & 1))).astype(bool) & (n[i] >= least * n[j] - 1e-9) & (n[j] >= least * n[i] - 1e-9) & (ids[i] != ids[j])
        x, y = i[ok], j[ok]
        both = np.ceil(least / (1 + least) * (n[x] + n[y]) - 1e-9).astype(np.int64)
        more = 1 + (SLACK * np.minimum(n[x], n[y])).astype(np.int64)
        room_x, room_y = n[x] - both, n[y] - both
        ok = (rank[x] < room_x + more) & (rank[y] < room_y + more)
        if bits is not None:  # two sets with both in common differ in n[x] + n[y] - 2 * both runs
            ok[ok] = np.bitwise_count(bits[x[ok]] ^ bits[y[ok]]).sum(axis=1) <= (room_x + room_y)[ok]
        need = np.maximum(1, np.minimum(more, np.minimum(known[x] - room_x, known[y] - room_y)))
        x, y, need = ids[x[ok]], ids[y[ok]], need[ok]
        out.append(np.stack([np.minimum(x, y), np.maximum(x, y), need]))
        apart += 1
    return out


def array_pairs(rows: DataFrame, least: float, groups: int = 1) -> DataFrame:
    """(a, b): the pairs of rows (id, kind, n, known, places, bits) that share enough suffixes of the
    array. kind: 1 held-out, 2 training, 3 both. Without groups of ranges the array is built once,
    with them once for each, of the suffixes that fall into it; the pairs' spans are summed up."""
    rest = sum(bits for _, bits in PLACE_BITS[1:])
    meta = ((F.col("n").cast("bigint") * (1 << 32) + F.col("known")) * 4 + F.col("kind")).alias("meta")
    found = [_spans(rows.select("id", meta, "bits", F.posexplode("places").alias("rank", "place")).where(f"pmod(shiftright(place, {rest}), {groups}) = {g}"), least, rest) for g in range(groups)]
    met = reduce(DataFrame.unionAll, map(materialize, found)) if groups > 1 else found[0]
    return met.groupBy("a", "b").agg(F.sum("spans").alias("spans"), F.max("need").alias("need")).where("spans >= need").select("a", "b")


def _matrix(column: pa.Array) -> np.ndarray | None:
    """A row of 64-bit numbers for each binary value; None where there are none."""
    if column.null_count:
        return None
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]].view(U64).reshape(len(column), -1)


def _spans(flat: DataFrame, least: float, rest: int) -> DataFrame:
    """(a, b, spans, need) of the suffixes (id, meta, bits, rank, place)."""
    array = flat.repartition(F.shiftright("place", rest)).sortWithinPartitions("place", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # suffixes of a stretch that may go on in the next batch

        def pairs(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            meta, rank, place, ids, *bits = cols
            found = sharing(place >> rest, ids, meta >> 34, (meta >> 2) & 0xFFFFFFFF, rank, meta & 3, least, *bits)
            if found:
                a, b, need = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(need.astype(np.int32))], names=["a", "b", "need"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("meta", "rank", "place", "id")]
            bits = _matrix(batch.column(batch.schema.get_field_index("bits")))
            cols += [] if bits is None else [bits]
            if held is not None:
                cols = [np.concatenate(c) for c in zip(held, cols)]
            heads = cols[2] >> rest
            cut = int(np.searchsorted(heads, heads[-1]))
            held = [c[cut:] for c in cols]
            if cut:
                yield from pairs([c[:cut] for c in cols])
        if held is not None and len(held[0]):
            yield from pairs(held)

    met = array.mapInArrow(run, "a bigint, b bigint, need int")
    return met.groupBy("a", "b").agg(F.count("*").alias("spans"), F.max("need").alias("need"))


def common_pairs(reps: DataFrame, least: float) -> DataFrame:
    """(a, b): the pairs of reps that may be similar without a rare run in common."""
    texts = materialize(reps.where("common is not null").select("id", "kind", "r", (F.col("n") - F.col("r")).alias("f"), "common", "places"))
    kinds = F.max(F.col("kind").bitwiseAND(1)) + F.max(F.col("kind").bitwiseAND(2))
    classes = materialize(texts.groupBy("common").agg(kinds.alias("kind"), F.first("f").alias("n"), F.first("places").alias("places")))
    none = F.lit(None).cast("binary").alias("bits")  # a class stands for texts of different runs
    near = array_pairs(classes.select(F.col("common").alias("id"), "kind", "n", F.col("n").alias("known"), "places", none), least)
    near = near.unionAll(classes.where("kind = 3").select(F.col("common").alias("a"), F.col("common").alias("b")))
    sizes = lambda x: classes.select(F.col("common").alias(x), F.col("n").alias(f"f{x}"))
    both = near.join(sizes("a"), "a").join(sizes("b"), "b").select("a", "b", F.greatest("fa", "fb").alias("most"), F.least("fa", "fb").alias("few"))
    both = both.unionAll(both.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"), "most", "few"))
    # a similar pair has few / least - most rare runs at most, both together
    level = F.floor(F.col("r") * LEVELS / F.col("most")).cast("int")
    top = int(LEVELS * (1 / least - 1)) + 1
    side = lambda bit, x, kept: texts.where(F.col("kind").bitwiseAND(bit) > 0).select(F.col("common").alias(kept), F.col("id").alias(x), "r")
    one = both.select("a", "b", "most", "few").join(side(1, "h", "a"), "a").withColumn("level", level).withColumnRenamed("r", "rh").where(f"level <= {top}")
    two = both.select("a", "b", "most").join(side(2, "t", "b"), "b").withColumn("level", level).where(f"level <= {top}").withColumn("level", F.explode(F.sequence(F.lit(0), top - F.col("level"))))
    met = one.join(two.select("a", "b", "t", F.col("r").alias("rt"), "level"), ["a", "b", "level"]).where(F.expr(f"h != t and few >= {least} * (most + rh + rt) - 1e-6"))
    return met.select(F.least("h", "t").alias("a"), F.greatest("h", "t").alias("b"))


def cross_split_pairs(docs: DataFrame, heldout: list[str], train: str = "train", id_col: str = "doc_id", text_col: str = "text", split_col: str = "split", least: float = MIN_SIMILARITY, cover: bool = True) -> DataFrame:
    """(doc_a, doc_b, similarity, cover_a, cover_b), doc_a < doc_b: all pairs of a training and a
    held-out text that are similar by least or more, with the share of each one's words that lies
    in spans of eight words or more which the other has too (without cover: null). Rows of other splits, of a null split
    or id and null or short texts are in no pair; repeated rows of one id count once. Texts of
    equal words form a class that is searched once, and its pairs are written out at the end."""
    name = split_name(split_col)
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), name.isin(heldout).alias("held"), name.alias("s")).where(F.col("held") | (F.col("s") == train))
    docs = docs.withColumn("taught", ~F.col("held")).drop("s")
    frequent = frequent_runs(docs, SHINGLE, FREQUENT)
    rows = materialize(suffixes(docs, frequent, rare=False))
    of_class = copies(rows, "held", "taught")
    members = of_class.select("id", "rep", "held", "taught")
    kind = F.col("held").cast("int") + F.col("taught").cast("int") * 2
    groups = min(GROUPS, 1 + rows.count() // GROUP_TEXTS)
    named = suffixes(first_of_copies(docs, of_class, "held", "taught"), frequent, rare=True).select("id", kind.alias("kind"), "n", F.col("r").alias("known"), "places", "bits")
    candidates = array_pairs(materialize(named) if groups > 1 else named, least, groups)
    candidates = candidates.unionAll(common_pairs(first_of_copies(rows, of_class, "held", "taught").withColumn("kind", kind), least))
    candidates = materialize(candidates.distinct())
    found = verified_pairs(candidates, docs.select("id", "text"), "id", least=least, cover=cover)
    sides = []
    for x, y in (("a", "b"), ("b", "a")):
        sides.append(found.withColumnsRenamed({x: "rep_h", y: "rep_t", f"cover_{x}": "cover_h", f"cover_{y}": "cover_t"}).select("rep_h", "rep_t", "similarity", "cover_h", "cover_t"))
    one = F.lit(1.0) if cover else F.lit(None).cast("double")
    same = members.groupBy("rep").agg(F.bool_or("held").alias("h"), F.bool_or("taught").alias("t")).where("h and t").select(F.col("rep").alias("rep_h"), F.col("rep").alias("rep_t"), F.lit(1.0).alias("similarity"), one.alias("cover_h"), one.alias("cover_t"))
    links = sides[0].unionAll(sides[1]).unionAll(same)
    # a class of several gives a row for each member of the kind; who stands alone, itself
    for kind, rep, own in (("held", "rep_h", "h"), ("taught", "rep_t", "t")):
        links = links.join(members.select(F.col("id").alias(own), F.col("rep").alias(rep), F.col(kind).alias("right_kind")), rep, "left")
        single = own_kind(rows, kind).select(F.col("id").alias(rep), F.lit(True).alias("single_kind"))
        links = links.join(single, rep, "left").where(f"right_kind or ({own} is null and single_kind)").withColumn(own, F.coalesce(own, rep)).drop("right_kind", "single_kind")
    full = links
    swap = F.col("h") < F.col("t")
    return full.select(
        F.least("h", "t").alias("doc_a"), F.greatest("h", "t").alias("doc_b"), "similarity",
        F.when(swap, F.col("cover_h")).otherwise(F.col("cover_t")).alias("cover_a"), F.when(swap, F.col("cover_t")).otherwise(F.col("cover_h")).alias("cover_b"),
    ).distinct()


def own_kind(rows: DataFrame, kind: str) -> DataFrame:
    """The ids of the texts in held-out splits, or in the training split."""
    return rows.where("held" if kind == "held" else "not held").select("id").distinct()


def _found(spark: SparkSession, sf_dir: str, cover: bool) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "split")
    return cross_split_pairs(docs, heldout_splits(spark, sf_dir), cover=cover)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, False).select("doc_a", "doc_b")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each split and source, null sources included: the documents that recur on the other
    side, their pairs and the mean of their covered shares."""
    pairs = _found(spark, sf_dir, True)
    sides = pairs.select(F.col("doc_a").alias("doc_id"), F.col("cover_a").alias("cover")).unionAll(pairs.select(F.col("doc_b").alias("doc_id"), F.col("cover_b").alias("cover")))
    per_doc = sides.groupBy("doc_id").agg(F.count("*").alias("pairs"), F.max("cover").alias("cover"))
    docs = table(spark, sf_dir, "documents").select("doc_id", split_name("split").alias("split"), F.lower("source").alias("source"))
    return docs.join(per_doc, "doc_id").groupBy("split", "source").agg(F.count("*").alias("documents"), F.sum("pairs").alias("pairs"), F.round(F.avg("cover"), 6).alias("mean_cover"))
