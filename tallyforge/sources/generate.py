"""Deterministic ledgers and order flows of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bulk_seed(spark: SparkSession, date: str, accounts: int, trades: int, base: int = 1_000_000, symbol: str = "BTCUSDT") -> tuple[DataFrame, DataFrame]:
    """(ledger, balances): accounts * trades * 3 ledger rows and accounts * 2 balances.

    Trade k of all has quantity k % 7 + 1, price 1000 + k % 100, fee (k % 3 + 1) / 100 and comes trade_no seconds after ten o'clock.
    """
    from tallyforge.functions.assets import MONEY, base_asset, quote_asset

    s = F.lit(symbol)
    k = F.col("id")
    t = spark.range(accounts * trades).select(
        k.alias("k"), (F.floor(k / trades) + base + 1).cast("long").alias("account_id"), (k % trades + 1).alias("no"),
            (k % 7 + 1).cast(MONEY).alias("q"), (1000 + k % 100).cast(MONEY).alias("p"), ((k % 3 + 1).cast(MONEY) / 100).cast(MONEY).alias("fee"),
    )
    rows = F.array(
        F.struct(F.lit(1).alias("leg"), base_asset(s).alias("asset"), F.col("q").alias("amount"), F.lit("TRADE").alias("entry_type")),
        F.struct(F.lit(2).alias("leg"), quote_asset(s).alias("asset"), (-F.col("q") * F.col("p")).cast(MONEY).alias("amount"), F.lit("TRADE").alias("entry_type")),
        F.struct(F.lit(3).alias("leg"), quote_asset(s).alias("asset"), (-F.col("fee")).cast(MONEY).alias("amount"), F.lit("FEE").alias("entry_type")),
    )
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(f"{date} 10:00:00").cast("timestamp")) + F.col("no"))
    trade = F.concat(F.lit("SEED-"), F.col("k").cast("string"))
    led = t.select("k", "account_id", trade.alias("trade_id"), at.alias("created_at"), F.explode(rows).alias("r"))
    ledger = led.select((F.col("k") * 3 + F.col("r.leg")).cast("long").alias("id"), "account_id", "r.asset", "r.amount", "r.entry_type", "trade_id",
        F.concat_ws(":", "trade_id", F.col("account_id").cast("string"), "r.asset", "r.entry_type").alias("idempotency_key"), "created_at")
    balances = ledger.groupBy("account_id", "asset").agg(F.sum("amount").cast(MONEY).alias("available")).withColumn("locked", F.lit(0).cast(MONEY))
    return ledger, balances


def burst_orders(spark: SparkSession, n: int, symbol: str, start: str, price: int = 100, quantity: int = 1, accounts: int = 10) -> DataFrame:
    """n LIMIT GTC commands at one price, buys and sells in turn."""
    k = F.col("id")
    return spark.range(n).select(
        F.lit("NEW").alias("command_type"), (k % accounts + 1).alias("user_id"), F.concat(F.lit("burst-"), k.cast("string")).alias("client_order_id"),
            F.lit(symbol).alias("symbol"), F.when(k % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        F.lit("LIMIT").alias("order_type"), F.lit("GTC").alias("time_in_force"), F.lit(price).cast("decimal(20,8)").alias("price"),
            F.lit(quantity).cast("decimal(20,8)").alias("quantity"), F.lit(None).cast("string").alias("cancel_by"),
            F.lit(None).cast("string").alias("cancel_value"),
        F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + k).alias("received_at"), k.alias("seq"),
    )
