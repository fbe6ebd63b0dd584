"""Latency of the order pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pipeline_latency(records: DataFrame) -> DataFrame:
    """records (received, consumed, matched, published: milliseconds) -> queue, engine, publish, total and end-to-end milliseconds."""
    queue = F.greatest(F.lit(0), F.col("consumed") - F.col("received"))
    parts = {"queue_ms": queue, "engine_ms": F.col("matched") - F.col("consumed"), "publish_ms": F.col("published") - F.col("matched"),
        "total_ms": F.col("published") - F.col("consumed"), "end_to_end_ms": queue + F.col("published") - F.col("consumed")}
    return records.select("*", *[v.cast("long").alias(k) for k, v in parts.items()])


def latency_percentiles(values: DataFrame, group: str, value: str, ratios: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(group, n, min, p50, p95, max, avg): percentile r is the value at place min(n - 1, int(n * r)) of the sorted values.

    Values are counted first, so the sort sees each distinct value of a group once.
    """
    counted = values.groupBy(group, value).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    n = F.sum("c").over(Window.partitionBy(group))
    placed = counted.withColumns({"upto": upto, "n": n})
    picks = [F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * r)), F.col(value))).alias(f"p{round(r * 100)}") for r in ratios]
    return placed.groupBy(group).agg(F.max("n").alias("n"), F.min(value).alias("min"), *picks, F.max(value).alias("max"), F.round(F.sum(F.col(value) * F.col("c")) / F.max("n"), 2).alias("avg"))


def latency_percentiles_fast(values: DataFrame, group: str, value: str, ratios: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """The same from sketches: one aggregation, percentiles within 1 in 10,000 of their place."""
    picks = [F.percentile_approx(value, r, 10_000).alias(f"p{round(r * 100)}") for r in ratios]
    return values.groupBy(group).agg(F.count("*").alias("n"), F.min(value).alias("min"), *picks, F.max(value).alias("max"), F.round(F.avg(value), 2).alias("avg"))
