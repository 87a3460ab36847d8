"""Reading the input tables and keeping what many queries need."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.session import materialize

_kept: dict[tuple, Any] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_name(column: str) -> Column:
    """The split without outer blanks, in lower case; null stays null."""
    return F.lower(F.expr(f"trim(BOTH ' \\t\\r\\n' FROM {column})"))


def _state(spark: SparkSession, path: str) -> tuple:
    """What a path held when it was read, in any file system: names, sizes and times of its files."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return (path,)
    files, found = fs.listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def kept(spark: SparkSession, sf_dir: str, name: str, source: str, build: Callable[[], Any]) -> Any:
    """What build makes, made once for each session and state of the source table."""
    key = (spark.sparkContext.applicationId, name, _state(spark, f"{sf_dir}/{source}.parquet"))
    if key not in _kept:
        _kept[key] = build()
    return _kept[key]


def once(spark: SparkSession, sf_dir: str, name: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that build makes, written once for each session and state of the source table."""
    return kept(spark, sf_dir, name, source, lambda: materialize(build()))
