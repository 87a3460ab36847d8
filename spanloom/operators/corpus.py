"""From texts to token ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from spanloom.config import TokenFormat
from spanloom.functions.keys import pointer_size
from spanloom.operators.prefix import numbered, running
from spanloom.session import materialize


#: Leading words of the vocabulary that are sent to all executors.
HEAD_WORDS = 1_000_000


def words(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the column words: the text whose words are the runs of what is no space, tab, LF, CR
    or form feed. A null or blank text has none."""
    return df.withColumn("words", F.coalesce(F.col(text_col), F.lit("")))


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and where those of each begin and end. Of what Arrow takes for spaces
    only the vertical tab is none here."""
    by_set = pc.any(pc.match_substring(texts, "\v")).as_py()
    lists = pc.split_pattern_regex(texts, "[ \t\n\r\f]+") if by_set else pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), np.cumsum([0, *lists.value_lengths().to_pylist()])
    some = pc.not_equal(flat, "")
    return flat.filter(some), np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])[offsets]


def vocabulary(df: DataFrame, max_words: int | None = None) -> DataFrame:
    """(w, cnt, tok): ids by falling count, ties by the words' bytes. With max_words the rarer
    words get no id; encode() gives them the id max_words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pc.value_counts(_cut(batch.column(0))[0])
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["w", "n"])

    counts = df.select("words").mapInArrow(count, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("cnt"))
    counts = materialize(counts)  # they are gone through several times
    keyed = counts.withColumn("key", F.concat(F.lpad(F.hex(F.lit((1 << 62) - 1) - F.col("cnt")), 16, "0"), "w"))
    ranked = numbered(keyed, "key", "tok").select("w", "cnt", "tok")
    return ranked if max_words is None else ranked.where(F.col("tok") < max_words)


def encode(df: DataFrame, vocab: DataFrame, fmt: TokenFormat, id_col: str = "doc_id", unknown: int | None = None, head: int = HEAD_WORDS) -> DataFrame:
    """df with the column toks, an array of ids, in place of words. Words without an id get
    `unknown`; where it is None they must not occur. An id from the separator on is an error. The
    words of the first `head` ids, which most occurrences belong to, are sent to all, and texts are
    encoded where they are; only the other occurrences are brought to their word's id, and the
    texts that have some to those ids, so no word's rows gather in one task."""
    common = df.sparkSession.sparkContext.broadcast(vocab.where(F.col("tok") < head).select("w", "tok").toArrow().combine_chunks())
    fields, ids = df.drop("words").schema.fields, StructField("toks", ArrayType(LongType()))
    large = f"a token id needs more than {fmt.token_bytes} bytes"
    separator = fmt.separator

    def lists(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
        if len(flat) and flat.max() >= separator:
            raise ValueError(large)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, toks = (common.value.column(c).combine_chunks() for c in ("w", "tok"))
        toks = np.append(toks.to_numpy(), -1)
        for batch in batches:
            flat, offsets = _cut(batch.column(batch.schema.get_field_index("words")))
            named = flat.dictionary_encode()
            at = pc.fill_null(pc.index_in(named.dictionary, words), len(words)).to_numpy()
            found = toks[at][named.indices.to_numpy()]
            missed = np.flatnonzero(found < 0)
            rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(missed, offsets), pa.int32()), flat.take(pa.array(missed)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in fields), lists(found, offsets), rare], names=[*(f.name for f in fields), "toks", "rare"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toks, more = (batch.column(batch.schema.get_field_index(c)) for c in ("toks", "more"))
            flat = toks.flatten().to_numpy(zero_copy_only=False).copy()
            flat[flat < 0] = more.flatten().to_numpy(zero_copy_only=False)
            offsets = np.cumsum([0, *toks.value_lengths().to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in fields), lists(flat, offsets)], names=[*(f.name for f in fields), "toks"])

    part = df.mapInArrow(known, StructType([*fields, ids, StructField("rare", ArrayType(StringType()))]))
    rare = vocab.where(F.col("tok") >= head).select("w", "tok")
    if unknown is None and rare.isEmpty():
        return part.drop("rare")
    part = materialize(part)
    at = part.where(F.size("rare") > 0).select(id_col, F.posexplode("rare").alias("pos", "w"))
    tok = F.coalesce("tok", F.raise_error(F.lit("a word has no id")).cast("bigint") if unknown is None else F.lit(unknown))
    found = at.join(rare, "w", "left").select(id_col, "pos", tok.cast("bigint").alias("tok"))
    more = found.groupBy(id_col).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "tok"))), lambda x: x.tok).alias("more"))
    filled = part.where(F.size("rare") > 0).drop("rare").join(more, id_col).mapInArrow(fill, StructType([*fields, ids]))
    return part.where(F.size("rare") == 0).drop("rare").unionAll(filled)


def stream(docs: DataFrame, fmt: TokenFormat, max_tokens: int | None = None, max_docs: int | None = None) -> DataFrame:
    """docs(doc_id, toks) as one stream in order of doc_id, each document after a separator: with
    n_tokens (separator included), first (rank of the separator) and doc_no. The stream ends
    before the first document that would exceed max_tokens, and after max_docs documents."""
    keyed = docs.withColumn("key", F.lpad(F.hex(F.col("doc_id") + F.lit(1 << 62)), 16, "0")).withColumn("n_tokens", (F.size("toks") + 1).cast("bigint"))
    out = running(keyed, "key", {"first": F.col("n_tokens"), "doc_no": F.lit(1)}, before=True).drop("key")
    if max_tokens is not None:
        out = out.where(F.col("first") + F.col("n_tokens") <= max_tokens)
    if max_docs is not None:
        out = out.where(F.col("doc_no") < max_docs)
    return out.withColumn("byte_offset", F.col("first") * fmt.token_bytes)


def stream_stats(docs: DataFrame, fmt: TokenFormat) -> DataFrame:
    """One row: documents, num_ranks (tokens and separators), ds_size, ptr_size, index_bytes. An
    empty corpus has zeros and a pointer of one byte."""
    size = docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.size("toks") + 1), F.lit(0)).cast("bigint").alias("num_ranks"))
    sized = size.withColumn("ds_size", F.col("num_ranks") * fmt.token_bytes)
    pointed = sized.withColumn("ptr_size", pointer_size(F.greatest(F.col("ds_size"), F.lit(1))))
    return pointed.withColumn("index_bytes", F.col("ds_size") + F.col("num_ranks") * F.col("ptr_size"))
