"""Contiguous shards of near-equal bytes from global prefix sums, in DataFrame operations only.

Rows are dealt into ranges of the order key, each range is totalled, the few
totals give each range its offset, and prefix sums within ranges complete the
global ones. Cutting these at equal targets gives the shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutlake.llm.common import lanes, pinned


def shard_by_bytes(df: DataFrame, size: Column, order_by: list[str], shards: int, keep: list[Column]) -> DataFrame:
    """``keep`` columns with size, shard and slot of every row.

    ``order_by`` names the columns of the global order (nulls first). Shard k takes
    the rows whose middle byte lies in the k-th of ``shards`` equal parts of all
    bytes, so shards are contiguous in that order and differ from the target by
    less than one row at either end. slot counts a shard's rows from 0. Rows that
    are equal in all order columns are told apart by the input order, so a key
    that many rows share is split over ranges too. Only sums, one row per range
    and one per shard, are gathered anywhere.
    """
    spark = df.sparkSession
    # keys under names of ours, beside whatever columns the caller has
    slim = df.select(*keep, size.cast("long").alias("size"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(order_by)], F.monotonically_increasing_id().alias("_row"))
    keys = [*(f"_k{i}" for i in range(len(order_by))), "_row"]
    ranged = pinned(slim.repartitionByRange(4 * lanes(spark), *keys).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("_bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_rows_before"))
    total = totals.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("_total"))
    inside = Window.partitionBy("_range").orderBy(*keys)
    prefix = (
        ranged.withColumn("_bytes_here", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_rows_here", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "_range")  # one row per range
        .crossJoin(F.broadcast(total))  # one row
        .withColumn("_middle", 2 * (F.col("_bytes_before") + F.col("_bytes_here")) + F.col("size"))
        .withColumn("_index", F.col("_rows_before") + F.col("_rows_here"))
        .withColumn("shard", F.when(F.col("_total") == 0, 0).otherwise(F.least(F.lit(shards - 1), F.expr(f"_middle * {shards} div (2 * _total)"))).cast("int"))
    )
    prefix = pinned(prefix.drop("_range", "_bytes_before", "_rows_before", "_bytes_here", "_rows_here", "_total", "_middle", *keys))
    first = prefix.groupBy("shard").agg(F.min("_index").alias("_first"))
    return prefix.join(F.broadcast(first), "shard").withColumn("slot", (F.col("_index") - F.col("_first")).cast("long")).drop("_index", "_first")
