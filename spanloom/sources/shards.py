"""Corpus shards as gzipped JSON lines, and the corpus as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from spanloom.config import Shards
from spanloom.functions.keys import shard_file
from spanloom.operators.prefix import numbered


def read_shards(spark: SparkSession, folder: str, split: str, indexes: list[int], shards: Shards) -> DataFrame:
    """(doc_id, text): the texts of the shards in the order given, then by line. All files are
    read by one scan; a shard is a file, or a folder of files in order of their names. A gzipped
    file is read by one task, so its lines are numbered in order; a line without text gives a null
    text. A shard that is named twice is read once."""
    if not indexes:
        return spark.createDataFrame([], "doc_id bigint, text string")
    names = [shards.file_name(split, i) for i in indexes]
    schema = StructType([StructField("text", StringType()), StructField("shard", IntegerType())])
    rows = spark.read.schema(StructType(schema.fields[:1])).json([f"{folder}/{n}" for n in names])
    rows = rows.select("text", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line"))
    order = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, shard int").groupBy("name").agg(F.min("shard").alias("shard"))
    depth = names[0].count("/") + 1  # the name's last parts stand at the end of the path, or before a file's name
    parts = F.split("path", "/")
    at_end = F.array_join(F.slice(parts, -depth, depth), "/")
    above = F.array_join(F.slice(parts, -depth - 1, depth), "/")
    named = rows.withColumns({"a": at_end, "b": above}).join(F.broadcast(order.select(F.col("name").alias("a"), F.col("shard").alias("x"))), "a", "left")
    named = named.join(F.broadcast(order.select(F.col("name").alias("b"), F.col("shard").alias("y"))), "b", "left").withColumn("shard", F.coalesce("x", "y"))
    key = F.concat(F.lpad(F.hex("shard"), 8, "0"), F.col("path"), F.lpad(F.hex("line"), 16, "0"))
    return numbered(named.withColumn("key", key), "key", "doc_id").select("doc_id", "text")


def write_shards(df: DataFrame, folder: str, split: str, shards: Shards, order_col: str = "doc_id", shard_col: str = "shard") -> None:
    """Write the column text of each shard in order, as gzipped JSON lines in a folder named as the
    shard is, in one job; only such a folder for each shard number that occurs. A shard is one
    file, however many there are."""
    rows = df.where(F.col(shard_col).isNotNull()).select(shard_file(F.lit(split), F.col(shard_col), shards).alias("name"), order_col, "text")
    rows = rows.repartition("name").sortWithinPartitions("name", order_col).select("name", "text")
    target = f"{folder}/{split}.writing"
    rows.write.mode("overwrite").partitionBy("name").option("compression", "gzip").option("ignoreNullFields", "false").json(target)
    _rename(df.sparkSession, target, folder)


def _rename(spark: SparkSession, source: str, folder: str) -> None:
    """Move each folder name=<shard> to folder/<shard>."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    at = path(source)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        if name.startswith("name="):
            shard = jvm.java.net.URLDecoder.decode(name.removeprefix("name="), "UTF-8")
            to = path(f"{folder}/{shard}")
            fs.mkdirs(to.getParent())
            fs.delete(to, True)
            fs.rename(status.getPath(), to)
    fs.delete(at, True)
