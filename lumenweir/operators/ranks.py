"""Positions within groups of any size, without a task that holds a whole group.

Rows are dealt by (group, bucket), where the bucket is a hash of the row: a group that holds a third of all rows still
falls into many even parts. A row's position is its rank within its part plus the sizes of the parts before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one part of the largest possible group is meant to hold, and the fewest parts a group is cut into.
PART_ROWS = 50_000
LEAST_PARTS = 64


def parts_for(rows: int) -> int:
    """Parts of a group, as a power of 2 that follows the table's size."""
    return max(LEAST_PARTS, 1 << max(0, -(-rows // PART_ROWS) - 1).bit_length())


def ranked(df: DataFrame, group: str, bucket: Column, order: list, name: str) -> DataFrame:
    """df with `name`, the 0-based position within `group` by (bucket, order). Groups must not be null."""
    df = df.withColumn("_bucket", bucket)
    sizes = df.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    inner = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order))
    out = df.withColumn("_rank", inner).join(offsets, [group, "_bucket"])
    return out.withColumn(name, (F.col("_before") + F.col("_rank") - 1).cast("bigint")).drop("_bucket", "_before", "_rank")


def prefix_sums(df: DataFrame, by: list[str], bucket: Column, order: list, weight: str, before: str, total: str) -> DataFrame:
    """df with `before`, the sum of `weight` over the rows ahead within `by`, by (bucket, order), and `total`, that of all rows.

    bucket must rise with order. As with ranked(), a part of a group is a task's work, never the group.
    """
    df = df.withColumn("_bucket", bucket)
    sums = df.groupBy(*by, "_bucket").agg(F.sum(weight).alias("_sum"))
    group = Window.partitionBy(*by)
    ahead = F.coalesce(F.sum("_sum").over(group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*by, "_bucket", ahead.alias("_ahead"), F.sum("_sum").over(group).alias(total))
    inner = F.coalesce(F.sum(weight).over(Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_inner", inner).join(sums, [*by, "_bucket"]).withColumn(before, F.col("_ahead") + F.col("_inner")).drop("_bucket", "_ahead", "_inner")


def next_in_ring(df: DataFrame, group: str, key: str, value: str, name: str) -> DataFrame:
    """df with `name`: the `value` of the next row of the group by `key` (a bigint, once in a group), of the last row that of the first.

    The order is global, its parts are ranges of the key; the next row is joined by position, so that no task holds a group.
    """
    ends = df.agg(F.min(key).alias("a"), F.max(key).alias("z"), F.count("*").alias("n")).first()
    width = max(1, ((ends.z or 0) - (ends.a or 0)) // parts_for(ends.n) + 1)
    placed = ranked(df, group, F.floor((F.col(key) - F.lit(ends.a or 0)) / width), [key], "_at")
    sizes = df.groupBy(group).agg(F.count("*").alias("_size"))
    after = placed.select(F.col(group).alias("_group"), F.col("_at").alias("_next"), F.col(value).alias(name))
    placed = placed.join(sizes, group).withColumn("_next", F.pmod(F.col("_at") + 1, F.col("_size"))).withColumnRenamed(group, "_group")
    return placed.join(after, ["_group", "_next"]).withColumnRenamed("_group", group).drop("_next", "_at", "_size")
