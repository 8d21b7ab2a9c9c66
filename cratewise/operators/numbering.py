"""Numbers over whole tables, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cratewise.sources.shared import written


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Numbers from 1 in the order of a column, nulls last: a sort by ranges, then each range's start, so no task holds all rows.

    The sorted rows are written before their places are used twice: the bounds of ranges come from a sample, and small partitions are
    merged by their size, so a second sort would put other rows into other partitions.
    """
    by = F.col(order).asc_nulls_last()
    placed = rows.repartitionByRange(by).sortWithinPartitions(by).withColumn("part_", F.spark_partition_id()).withColumn("in_", F.monotonically_increasing_id())
    placed = written(placed, "numbered")
    sizes = placed.groupBy("part_").count()
    starts = sizes.select("part_", F.coalesce(F.sum("count").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start_"))
    return placed.join(F.broadcast(starts), "part_").withColumn(name, F.col("start_") + (F.col("in_") - F.shiftleft(F.col("part_").cast("long"), 33)) + 1).drop("part_", "in_", "start_")
