"""Sessions and intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: With this setting a query's shuffle files go when it ends, not when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_dir: str | None = None
_written: list[str] = []


def local_session(cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); where it is unset, which may only be
    so in local runs, a folder of this process that is removed at its end."""
    global _local_dir
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master or ""
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_dir is None or not os.path.isdir(_local_dir):
        _local_dir = tempfile.mkdtemp(prefix="spanloom-")
        atexit.register(shutil.rmtree, _local_dir, ignore_errors=True)
    return "file://" + _local_dir


def _remove_written() -> None:
    """Remove this process's tables at its end where the shared folder is a mounted one; in other
    stores they are left to the store's own expiry."""
    for path in _written:
        shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage is cut, the rows
    outlive a lost executor, and what is expensive is computed once. The shuffle files that this
    took are removed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanloom-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    if not _written:
        atexit.register(_remove_written)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)
