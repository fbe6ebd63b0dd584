"""Reconciling ledger sums with balance projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.assets import normalize_precision

LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def merged(rows: DataFrame, value: str) -> DataFrame:
    """(account_id, asset, value): rows of one account and asset, in any case, summed; null counts as 0 among several, one null stays."""
    return rows.groupBy("account_id", F.upper("asset").alias("asset")).agg(F.when((F.count("*") == 1) | (F.count(value) > 0), F.sum(value)).otherwise(F.lit(0)).cast("decimal(38,8)").alias("value"))


def compare(ledger: DataFrame, balances: DataFrame, max_id: int | None = None) -> DataFrame:
    """(account_id, asset, item_type, expected_value, actual_value, diff_value, severity, status): keys whose normalised values differ
    or that only one side has. Expected is the ledger's sum, actual the balance's total; the difference is null with one side missing."""
    truth = ledger if max_id is None else ledger.where(F.col("id") <= max_id)
    return differing(merged(truth, "amount"), merged(totals(balances), "total"))


def totals(balances: DataFrame) -> DataFrame:
    return balances.select("account_id", "asset", (F.col("available") + F.col("locked")).alias("total"))


def differing(truth: DataFrame, snapshot: DataFrame) -> DataFrame:
    """compare() of two sides that merged() has made."""
    expected = truth.select("account_id", "asset", F.col("value").alias("expected"), F.lit(True).alias("in_truth"))
    actual = snapshot.select("account_id", "asset", F.col("value").alias("actual"), F.lit(True).alias("in_snapshot"))
    both = expected.join(actual, ["account_id", "asset"], "full_outer")
    asset = F.col("asset")
    e, a = normalize_precision(F.col("expected"), asset), normalize_precision(F.col("actual"), asset)
    both = both.select("account_id", "asset", e.alias("expected_value"), a.alias("actual_value"), (F.col("in_truth").isNull() | F.col("in_snapshot").isNull()).alias("alone"))
    differ = both.where(F.col("alone") | ~F.col("expected_value").eqNullSafe(F.col("actual_value")))
    return differ.select("account_id", "asset", F.lit("CLOSING_BALANCE").alias("item_type"), "expected_value", "actual_value",
        (F.col("actual_value") - F.col("expected_value")).cast("decimal(38,8)").alias("diff_value"), F.lit("HIGH").alias("severity"),
        F.lit("OPEN").alias("status"))


def summary(diffs: DataFrame) -> DataFrame:
    return diffs.agg(F.count("*").alias("diff_count"), F.count_if(F.col("severity").isin("HIGH", "CRITICAL")).alias("high_severity_count"),
        F.coalesce(F.sum(F.abs("diff_value")), F.lit(0)).cast("decimal(38,8)").alias("total_abs_diff"))


def level(severity: Column) -> Column:
    found = F.lit(-1)
    for i, name in enumerate(LEVELS):
        found = F.when(severity == name, i).otherwise(found)
    return found


def open_diffs(diffs: DataFrame, n: int, alphabetical: bool = False, order: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """The first n open differences, the gravest first; alphabetical compares the levels' names instead."""
    gravest = F.col("severity") if alphabetical else level(F.col("severity"))
    return diffs.where(F.col("status") == "OPEN").orderBy(gravest.desc(), *order).limit(n)
