"""Query sets: windows of held-out texts, drawn uniformly with replacement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.config import TokenFormat, Workload
from spanloom.functions.keys import encode
from spanloom.operators.prefix import running
from spanloom.session import materialize

#: Windows that share a bucket when draws are brought to their documents.
BUCKET = 4096


def sample_windows(docs: DataFrame, work: Workload, fmt: TokenFormat) -> DataFrame:
    """(length, qid, key): per_length windows of each length from docs(doc_id, toks). Draw i of a
    length takes the window whose number, in order of document and position, is the first eight
    hex digits of md5('seed|length|i') modulo the number of windows. Windows lie inside documents.
    A length that no document has is left out."""
    lengths = F.array(*(F.lit(n) for n in work.lengths))
    # they are gone through several times, the texts but once
    sizes = materialize(docs.select("doc_id", F.size("toks").alias("size")))
    sized = sizes.withColumn("length", F.explode(lengths)).withColumn("n", (F.col("size") - F.col("length") + 1).cast("bigint")).where("n > 0")
    sized = sized.withColumn("at", F.concat(F.lpad(F.col("length").cast("string"), 4, "0"), F.lpad(F.hex(F.col("doc_id") + F.lit(1 << 62)), 16, "0")))
    placed = running(sized.select("doc_id", "length", "n", "at"), "at", {"all_before": F.col("n")}, before=True)
    per_length = placed.groupBy("length").agg(F.sum("n").alias("windows"), F.min("all_before").alias("base"))
    draws = per_length.select("length", "windows", F.explode(F.sequence(F.lit(0), F.lit(work.per_length - 1))).alias("qid"))
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(work.seed)), F.col("length").cast("string"), F.col("qid").cast("string"))), 1, 8)
    draws = draws.withColumn("w", F.conv(digits, 16, 10).cast("bigint") % F.col("windows"))
    draws = draws.withColumn("bucket", F.floor(F.col("w") / BUCKET))
    spans = placed.join(F.broadcast(per_length), "length").withColumn("from", F.col("all_before") - F.col("base"))
    spans = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("from") / BUCKET), F.floor((F.col("from") + F.col("n") - 1) / BUCKET))))
    met = draws.select("length", "qid", "w", "bucket").join(spans.select("length", "bucket", "doc_id", "from", "n"), ["length", "bucket"]).where("w >= from and w < from + n")
    tokens = docs.select("doc_id", "toks").join(F.broadcast(met), "doc_id")  # as many rows as windows are drawn
    window = F.slice("toks", (F.col("w") - F.col("from") + 1).cast("int"), F.col("length"))
    return tokens.select("length", "qid", encode(window, fmt).alias("key"))


def write_query_sets(queries: DataFrame, path: str) -> None:
    queries.write.mode("overwrite").partitionBy("length").parquet(path)


def read_query_sets(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).select("length", "qid", "key")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)
