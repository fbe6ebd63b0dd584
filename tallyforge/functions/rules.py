"""Validation rules as column functions, and the scope of a clearing batch."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: symbol, tick size, step size, least and most quantity, least notional. Fixed values.
CONSTRAINTS = (
    ("BTCUSDT", "0.01", "0.00001", "0.001", "1000", "10"),
    ("ETHUSDT", "0.01", "0.0001", "0.01", "10000", "10"),
)
CLIENT_ID = r"^[A-Za-z0-9_-]+$"
CLIENT_ID_LENGTH = (5, 64)


def constraints(df: DataFrame, rows=CONSTRAINTS) -> DataFrame:
    kinds = ", ".join(f"{c} decimal(20,8)" for c in ("tick", "step", "least", "most", "least_notional"))
    from decimal import Decimal

    return df.sparkSession.createDataFrame([(s, *map(Decimal, xs)) for s, *xs in rows], f"symbol string, {kinds}")


def valid_client_order_id(value: Column) -> Column:
    low, high = CLIENT_ID_LENGTH
    return F.coalesce(value.rlike(CLIENT_ID) & F.length(value).between(low, high), F.lit(False))


def first_failure(rules: list[tuple[Column, str]]) -> Column:
    """The name of the first rule whose condition holds, else null."""
    found = F.lit(None).cast("string")
    for condition, name in reversed(rules):
        found = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(found)
    return found


def validate_orders(orders: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """orders with reject: the first rule that a NEW order breaks, null if it is accepted.

    Our own limits, a row for each of a few symbols, are broadcast; a table that is given is left to Spark, which knows its size.
    """
    limits = F.broadcast(constraints(orders)) if limits is None else limits
    made = [c for c in limits.columns if c != "symbol"]
    rows = orders.join(limits, "symbol", "left")
    q, p, limit = F.col("quantity"), F.col("price"), F.col("order_type") == "LIMIT"
    missing = F.col("client_order_id").isNull() | F.col("symbol").isNull() | F.col("side").isNull() | F.col("order_type").isNull() | q.isNull()
    rules = [
        (missing, "MISSING_FIELD"),
        (limit & (p.isNull() | (p <= 0)), "INVALID_PRICE"),
        (q <= 0, "INVALID_QUANTITY"),
        (F.col("tick").isNull(), "UNKNOWN_SYMBOL"),
        (p.isNotNull() & (p % F.col("tick") != 0), "INVALID_TICK"),
        (q % F.col("step") != 0, "INVALID_STEP"),
        ((q < F.col("least")) | (q > F.col("most")), "QUANTITY_OUT_OF_RANGE"),
        (p.isNotNull() & (p * q < F.col("least_notional")), "NOTIONAL_TOO_SMALL"),
    ]
    return rows.withColumn("reject", first_failure(rules)).select(*orders.columns, "reject")


def parse_scope(scope: str | None) -> tuple[str, int, int]:
    """('all', 0, 0), ('account', from, to) or ('chunk', index, of); anything else raises ValueError."""
    text = (scope or "").strip()
    if not text:
        return "all", 0, 0
    if m := re.fullmatch(r"account:(\d+)-(\d+)", text):
        low, high = int(m[1]), int(m[2])
        if 0 < low <= high:
            return "account", low, high
    if m := re.fullmatch(r"chunk:(\d+)/(\d+)", text):
        i, n = int(m[1]), int(m[2])
        if i < n:
            return "chunk", i, n
    raise ValueError(f"unsupported scope: {scope!r}")


def account_hash(account_id: Column) -> Column:
    """The 32-bit hash by which accounts are dealt to chunks: the id's halves, exclusive or."""
    low = account_id.bitwiseXOR(F.shiftrightunsigned(account_id, 32)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low)


def scope_filter(scope: str | None, account_id: str = "account_id") -> Column:
    kind, a, b = parse_scope(scope)
    account = F.col(account_id)
    if kind == "all":
        return F.lit(True)
    if kind == "account":
        return account.between(a, b)
    return F.pmod(account_hash(account), F.lit(b)) == a
