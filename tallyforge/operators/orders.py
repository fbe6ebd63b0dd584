"""Order and trade projections, and the query layer over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import assets
from tallyforge.operators.ledger import first_by


def project_orders(updates: DataFrame, tie: list[str], stored: DataFrame | None = None) -> DataFrame:
    """The last state of each order: the update with the largest event_seq; one without a seq counts as later than any. stored
    (order_id, last_event_seq) states stand against updates that are not newer. tie orders updates with equal seq: the first wins."""
    rows = updates
    if stored is not None:
        known = stored.select("order_id", "last_event_seq")
        rows = updates.join(known, "order_id", "left").where(F.col("event_seq").isNull() | F.col("last_event_seq").isNull() | (F.col("event_seq") > F.col("last_event_seq"))).select(*updates.columns)
    late = F.col("event_seq").isNull().cast("int")
    best = rows.withColumn("_rank", -late).withColumn("_seq", -F.coalesce("event_seq", F.lit(0)))
    return first_by(best, ["order_id"], ["_rank", "_seq", *tie]).drop("_rank", "_seq")


def attach_order(updates: DataFrame, orders: DataFrame) -> DataFrame:
    """updates with matched_order_id: the stored order with the update's user and client id, else with its user and order id."""
    by_client = orders.select(F.col("user_id").alias("account_id"), "client_order_id", F.col("order_id").alias("_by_client")).dropDuplicates(["account_id", "client_order_id"])
    by_order = orders.select(F.col("user_id").alias("account_id"), "order_id", F.col("order_id").alias("_by_order")).dropDuplicates(["account_id", "order_id"])
    found = updates.join(by_client, ["account_id", "client_order_id"], "left").join(by_order, ["account_id", "order_id"], "left")
    return found.withColumn("matched_order_id", F.coalesce("_by_client", "_by_order")).select(*updates.columns, "matched_order_id")


def project_trades(executions: DataFrame, order: list[str], stored: DataFrame | None = None) -> DataFrame:
    """One trade for each event id and each (trade_id, account): the first in the order wins; fee 0.

    Two passes equal the sequential rule, as rows with one event id have one trade and account.
    """
    rows = executions
    if stored is not None:
        rows = rows.join(stored.select("event_id"), "event_id", "left_anti").join(stored.select("trade_id", "account_id"), ["trade_id", "account_id"], "left_anti").select(*executions.columns)
    rows = first_by(rows.withColumn("_event", F.coalesce("event_id", F.concat_ws(":", "trade_id", F.col("account_id").cast("string")))), ["_event"], order).drop("_event")
    rows = first_by(rows, ["trade_id", "account_id"], order)
    return rows.select(
        "event_id", "trade_id", "order_id", F.col("account_id").alias("user_id"), "symbol", "side", F.col("quantity").alias("exec_quantity"), F.col("price").alias("exec_price"),
        assets.value_of(F.col("quantity"), F.col("price")).alias("exec_value"), F.lit(0).cast(assets.MONEY).alias("fee_amount"), assets.fee_currency(F.col("symbol")).alias("fee_currency"),
        F.col("liquidity").alias("liquidity_flag"), F.col("executed_at").alias("exec_time"),
    )


def search_orders(orders: DataFrame, user_id: int | None = None, symbol: str | None = None, status: str | None = None, start: str | None = None,
    end: str | None = None, client_order_id: str | None = None) -> DataFrame:
    """Orders that meet all given conditions; bounds of created_at are inclusive."""
    rows = orders
    for column, value in (("user_id", user_id), ("symbol", symbol), ("status", status), ("client_order_id", client_order_id)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if start is not None:
        rows = rows.where(F.col("created_at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.where(F.col("created_at") <= F.lit(end).cast("timestamp"))
    return rows


def pending_orders(orders: DataFrame, user_id: int | None = None, symbol: str | None = None) -> DataFrame:
    return search_orders(orders, user_id, symbol, "NEW")


def trades_by(trades: DataFrame, user_id: int | None = None, order_id: int | None = None, symbol: str | None = None, start: str | None = None,
    end: str | None = None, liquidity: str | None = None) -> DataFrame:
    rows = trades
    for column, value in (("user_id", user_id), ("order_id", order_id), ("symbol", symbol), ("liquidity_flag", liquidity)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if start is not None:
        rows = rows.where(F.col("exec_time") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.where(F.col("exec_time") <= F.lit(end).cast("timestamp"))
    return rows


def page(df: DataFrame, sort: list[Column], size: int = 20, number: int = 0) -> DataFrame:
    """Page `number`, counted from 0. sort has to be total, or pages may overlap."""
    return df.orderBy(*sort).offset(size * number).limit(size)


def page_with_total(df: DataFrame, sort: list[Column], size: int = 20, number: int = 0) -> DataFrame:
    """The page with total_count and total_pages of all rows, each in every row; the count is one aggregate, not a window."""
    total = df.agg(F.count("*").alias("total_count")).withColumn("total_pages", F.ceil(F.col("total_count") / size))
    return page(df, sort, size, number).crossJoin(F.broadcast(total))  # one row


def page_after(df: DataFrame, time: str, key: str, last: tuple, size: int = 20) -> DataFrame:
    """The newest-first page that follows the row (time, key): no offset to skip over, however deep."""
    t, k = F.lit(last[0]).cast("timestamp"), F.lit(last[1])
    return df.where((F.col(time) < t) | ((F.col(time) == t) & (F.col(key) < k))).orderBy(F.desc(time), F.desc(key)).limit(size)


def pending_count_by_symbol(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("status") == "NEW").groupBy("user_id", "symbol").agg(F.count("*").alias("n_pending"))


def exec_qty_by_order(trades: DataFrame) -> DataFrame:
    return trades.groupBy("order_id").agg(F.sum("exec_quantity").cast("decimal(38,8)").alias("exec_quantity"))


def order_state_from_fills(fills: DataFrame, orders: DataFrame) -> DataFrame:
    """(order_id, filled, remaining, status, avg_price): from sums of fills (order_id, quantity, price); the average is the sums' quotient."""
    sums = fills.groupBy("order_id").agg(F.sum("quantity").alias("filled"), F.sum(F.col("quantity") * F.col("price")).alias("value"))
    both = orders.select("order_id", "quantity").join(sums, "order_id", "left").withColumn("filled", F.coalesce("filled", F.lit(0)))
    status = F.when(F.col("filled") == 0, "NEW").when(F.col("filled") < F.col("quantity"), "PARTIALLY_FILLED").otherwise("FILLED")
    return both.select("order_id", "filled", F.greatest(F.col("quantity") - F.col("filled"), F.lit(0)).alias("remaining"), status.alias("status"),
        (F.col("value").cast("double") / F.col("filled").cast("double")).alias("avg_price"))


def ranked_newest(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(time), F.desc(tie))))
