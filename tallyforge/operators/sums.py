"""Running sums in which no task sees all rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, group: list[str], bucket: str, order: list, value: Column, name: str) -> DataFrame:
    """df with the sum of value over the rows of its group before it, by bucket and then by order within the bucket.

    Prefix sums of two levels: a task sees one bucket of a group, or one row for each bucket. Null groups match each other.
    """
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    keys = [*group, bucket]
    offsets = sums.select(*[F.col(k).alias(f"_{k}_") for k in keys], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = None
    for k in keys:
        equal = F.col(k).eqNullSafe(F.col(f"_{k}_"))
        same = equal if same is None else same & equal
    placed = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(offsets, same)
    return placed.withColumn(name, F.col("_offset") + F.col("_inside")).drop("_offset", "_inside", *[f"_{k}_" for k in keys])
