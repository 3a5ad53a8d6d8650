"""Places of rows in one global order, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.session import materialize

#: Spark numbers rows as partition * 2^33 + row.
_ROWS = 33


def numbered(rows: DataFrame, order: list[Column], name: str, columns: list[Column] | None = None) -> DataFrame:
    """rows (or the given columns of them) with ``place`` (long, from 0 without gaps): their place in the given order.

    The rows are range-partitioned, sorted and written; the counts of the partitions then
    give each its first place. Rows should be narrow: the order is sampled beforehand, so
    they are made twice where they are not a written table.
    """
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    written = materialize(sorted_rows.select(*(columns or ["*"]), F.monotonically_increasing_id().alias("__at")), name)
    part = F.shiftright("__at", _ROWS)
    counts = written.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # one row a partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__begin"))
    placed = written.withColumn("__part", part).join(F.broadcast(begins), "__part")
    return placed.withColumn("place", F.col("__begin") + F.col("__at").bitwiseAND((1 << _ROWS) - 1)).drop("__part", "__at", "__begin")
