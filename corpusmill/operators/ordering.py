"""Global positions and running sums without moving a group to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Table

#: monotonically_increasing_id() holds the partition above this bit and the row's place in it below.
ROW_BITS = 33


def numbered(rows: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """Adds each row's place (long, from 0) in the order. Rows are range-sorted once and numbered in their
    partitions; what comes before a partition is a sum over one row per partition."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = Table(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("place__", F.monotonically_increasing_id())).df
    part = F.shiftright("place__", ROW_BITS).alias("part__")
    sizes = table.groupBy(part).agg(F.count(F.lit(1)).alias("n__"))
    ahead = Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    sizes = sizes.select("part__", F.coalesce(F.sum("n__").over(ahead), F.lit(0)).alias("ahead__"))
    found = table.withColumn("part__", part).join(F.broadcast(sizes), "part__")  # a row per partition
    place = F.col("ahead__") + F.col("place__").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return found.withColumn(name, place).select(*rows.columns, name)


def running(rows: DataFrame, by: str, order: str, sums: dict[str, str]) -> DataFrame:
    """Adds, for each (new name, column) of `sums`, the sum of the column over the earlier rows of the group `by`.

    Bring narrow rows. They are written once, as range partitioning reads them twice (for its bounds, too), and
    range-sorted by group and order, so a large group is many parts; sums run inside the parts of a group, and over
    one row per part before.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = Table(rows).df.repartitionByRange(n, by, order).withColumn("part__", F.spark_partition_id())
    table = Table(parted).df
    totals = table.groupBy(by, "part__").agg(*[F.sum(c).alias(f"{name}__") for name, c in sums.items()])
    ahead = Window.partitionBy(by).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(by).alias("by__"), F.col("part__").alias("p__"), *[F.coalesce(F.sum(f"{name}__").over(ahead), F.lit(0)).alias(f"{name}__") for name in sums])
    inside = Window.partitionBy("part__", by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    found = table.withColumns({name: F.coalesce(F.sum(c).over(inside), F.lit(0)) for name, c in sums.items()})
    found = found.join(totals, (F.col("part__") == F.col("p__")) & F.col(by).eqNullSafe(F.col("by__")))
    return found.select(*rows.columns, *[(F.col(name) + F.col(f"{name}__")).cast("long").alias(name) for name in sums])
