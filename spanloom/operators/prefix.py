"""Running sums and row numbers in one global order, on all executors.

Rows are sent to ranges of the order, as many as the number of rows asks for, sorted and summed up
within their range; the ranges' totals, one row for each range, are summed up and added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from spanloom.session import materialize

#: Rows of a range; up to this many rows need no cut.
ROWS_PER_RANGE = 500_000


def running(df: DataFrame, key: str, sums: dict[str, Column], before: bool = False, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """df with a column for each of sums: the sum of the expression over all rows up to this one
    (before: without it) in the order of key, which must be unique; null keys come first, null
    values count 0. Columns of df with those names are replaced. An empty df gives an empty one."""
    values = {f"__{k}": F.coalesce(v, F.lit(0)).cast("bigint") for k, v in sums.items()}
    tagged = df.withColumns(values)
    ranges = -(-df.count() // rows_per_range)
    if ranges < 2:
        order = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        return tagged.withColumns({k: F.coalesce(F.sum(f"__{k}").over(order), F.lit(0)) for k in sums}).drop(*values)
    names = list(values)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        total = dict.fromkeys(names, 0)
        for batch in batches:
            columns, fields = batch.columns, batch.schema.names
            for name in names:
                v = batch.column(fields.index(name)).to_numpy()
                upto = np.cumsum(v) + total[name]
                total[name] = int(upto[-1]) if len(v) else total[name]
                columns.append(pa.array(upto - v if before else upto))
            columns.append(pa.array(np.full(batch.num_rows, at)))
            yield pa.RecordBatch.from_arrays(columns, names=[*fields, *(f"{n}_in" for n in names), "__range"])

    more = [StructField(c, LongType()) for c in (*(f"{n}_in" for n in names), "__range")]
    parts = tagged.repartitionByRange(ranges, key).sortWithinPartitions(key).mapInArrow(add_up, StructType([*tagged.schema.fields, *more]))
    parts = materialize(parts)
    totals = parts.groupBy("__range").agg(*(F.sum(n).alias(f"{n}_all") for n in names))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__range", *(F.coalesce(F.sum(f"{n}_all").over(earlier), F.lit(0)).alias(f"{n}_all") for n in names))
    out = parts.join(F.broadcast(starts), "__range").withColumns({k: F.col(f"__{k}_in") + F.col(f"__{k}_all") for k in sums})
    return out.drop("__range", *names, *(f"{n}_in" for n in names), *(f"{n}_all" for n in names))


def numbered(df: DataFrame, key: str, name: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """df with the number of each row, from 0, in the order of key."""
    return running(df, key, {name: F.lit(1)}, before=True, rows_per_range=rows_per_range)
