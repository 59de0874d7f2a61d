"""Running numbers over all rows without putting them, or those of one group, into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry import scratch


def numbered(rows: DataFrame, group: str, order: list[Column | str], name: str = "n", parts: int | None = None) -> DataFrame:
    """Rows numbered from 1 by ``group`` and then ``order``.

    Rows are sorted by range; a row's number is the one within its partition plus
    a prefix sum over one row per partition.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartitionByRange(parts, group, *order).withColumn("__at__", F.spark_partition_id())
    spread = scratch.table(spread, "ranges")  # the cuts come from samples: they are made once
    inside = spread.withColumn(name, F.row_number().over(Window.partitionBy("__at__").orderBy(group, *order)))
    before = Window.orderBy("__at__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy("__at__").agg(F.count("*").alias("__held__")).select("__at__", F.coalesce(F.sum("__held__").over(before), F.lit(0)).alias("__before__"))
    return inside.join(F.broadcast(offsets), "__at__").withColumn(name, F.col(name) + F.col("__before__")).drop("__before__", "__at__")  # a row a partition
