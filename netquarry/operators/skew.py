"""Joins and ranks that stay spread out when one key holds a large share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry import scratch

HOT = 1_000_000  # rows of one key that a task may take
KEYS = 100_000  # most keys of which every task is told that they are hot


def join_one(rows: DataFrame, ones: DataFrame, key: str, n_rows: int, spread: list[str], hot: int = HOT) -> DataFrame:
    """``rows`` joined to ``ones``, which has one row a key.

    ``n_rows`` is the number of rows: up to ``hot`` of them no key can be hot and the
    join is plain.  Beyond it, keys of more than ``hot`` rows (or of a share of
    1 / ``KEYS``, so that there are at most that many) are counted, and each is split
    into parts by a hash of the columns ``spread``, their row of ``ones`` being
    repeated once a part.
    """
    if n_rows <= hot:
        return rows.join(ones, key)
    limit = max(hot, n_rows // KEYS)
    counts = rows.groupBy(key).agg(F.count("*").alias("__n__")).where(F.col("__n__") > limit)
    split = F.broadcast(counts.select(key, F.ceil(F.col("__n__") / limit).cast("int").alias("__parts__")))  # at most KEYS rows
    parts = F.coalesce("__parts__", F.lit(1))
    left = rows.join(split, key, "left").withColumn("__part__", F.pmod(F.xxhash64(*spread), parts).cast("int")).drop("__parts__")
    right = ones.join(split, key, "left").withColumn("__part__", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts__")
    return left.join(right, [key, "__part__"]).drop("__part__")


def ranked(rows: DataFrame, keys: list[str], order: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """Rows numbered from 1 within ``keys`` by ``order``, a large key being spread over tasks.

    All rows are sorted by range, which cuts a large key into several partitions;
    a row's number is the one within its partition plus what its key has in the
    partitions before.  Those counts, one per key and partition, are what a prefix
    sum runs over.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn("__at__", F.spark_partition_id())
    spread = scratch.table(spread, "ranges")  # the cuts come from samples: they are made once
    inside = spread.withColumn("__k__", F.row_number().over(Window.partitionBy(*keys, "__at__").orderBy(*order)))
    held = spread.groupBy(*keys, "__at__").agg(F.count("*").alias("__held__"))
    before = Window.partitionBy(*keys).orderBy("__at__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(*keys, "__at__", F.coalesce(F.sum("__held__").over(before), F.lit(0)).alias("__before__"))
    same = reduce(lambda a, b: a & b, [F.col(f"i.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*keys, "__at__"]])
    kept = [F.col(f"i.{c}") for c in rows.columns]
    return inside.alias("i").join(offsets.alias("o"), same).select(*kept, (F.col("i.__k__") + F.col("o.__before__")).cast("int").alias(name))
