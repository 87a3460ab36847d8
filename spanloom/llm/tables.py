"""The test tables as the operators of this subpackage read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_name(column: str | Column) -> Column:
    """The split without outer blanks, in lower case; null stays null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def heldout_splits(spark: SparkSession, sf_dir: str) -> list[str]:
    """The names in heldout_config, which has one row for each held-out split."""
    rows = table(spark, sf_dir, "heldout_config").select(split_name("split").alias("s")).where("s is not null").distinct().collect()
    return sorted(r.s for r in rows)
