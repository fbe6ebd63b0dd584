"""Column functions of symbols, assets and amounts, shared by batch and stream."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY, SETTLED = "decimal(20,8)", "decimal(36,18)"
#: Suffixes that split a symbol, in order, and those that the trade projection knows. Fixed values.
QUOTES, FEE_QUOTES = ("USDT", "USDC", "USD"), ("USDT", "KRW", "BTC", "ETH")
#: Decimal places of an asset; others have 8. Fixed values.
SCALES = {"KRW": 0, "USD": 2}


def _first_suffix(symbol: Column, suffixes: tuple[str, ...], make, otherwise: Column) -> Column:
    found = otherwise
    for s in reversed(suffixes):
        found = F.when(symbol.endswith(s), make(s)).otherwise(found)
    return found


def base_asset(symbol: Column) -> Column:
    """The symbol without every occurrence of its quote suffix; its first 3 characters if it has none."""
    return _first_suffix(symbol, QUOTES, lambda s: F.replace(symbol, F.lit(s), F.lit("")), F.substring(symbol, 1, 3))


def quote_asset(symbol: Column) -> Column:
    """The quote suffix; the symbol's last 4 characters if it has none."""
    return _first_suffix(symbol, QUOTES, F.lit, F.right(symbol, F.lit(4)))


def fee_currency(symbol: Column) -> Column:
    """The trade projection's own rule: other suffixes, and the whole symbol if none fits."""
    return _first_suffix(symbol, FEE_QUOTES, F.lit, symbol)


def is_buy(side: Column) -> Column:
    return F.upper(side) == "BUY"


def value_of(quantity: Column, price: Column) -> Column:
    """quantity * price to 8 places, half up."""
    return (quantity.cast(MONEY) * price.cast(MONEY)).cast(MONEY)


def base_change(side: Column, quantity: Column) -> Column:
    return F.when(is_buy(side), quantity).otherwise(-quantity).cast(MONEY)


def quote_change(side: Column, quantity: Column, price: Column) -> Column:
    value = value_of(quantity, price)
    return F.when(is_buy(side), -value).otherwise(value).cast(MONEY)


def idempotency_key(trade_id: Column, account_id: Column, asset: Column, entry_type: Column) -> Column:
    return F.concat_ws(":", trade_id, account_id.cast("string"), asset, entry_type)


def normalize_asset(asset: Column) -> Column:
    return F.upper(asset)


def normalize_precision(value: Column, asset: Column) -> Column:
    """value rounded half up to the asset's decimal places."""
    wide = value.cast("decimal(38,18)")
    found = F.round(wide, 8)
    for name, places in SCALES.items():
        found = F.when(F.upper(asset) == name, F.round(wide, places).cast("decimal(38,8)")).otherwise(found.cast("decimal(38,8)"))
    return found


def snapshot_key(max_ledger_id: Column) -> Column:
    return F.concat(F.lit("WM-"), F.substring(F.md5(F.concat(F.lit("max_ledger_id="), max_ledger_id.cast("string"))), 1, 12))


def run_key(batch_type: Column, at: Column) -> Column:
    """EOD, or INTRADAY with the start of the 600 s bucket that holds the time."""
    seconds = (F.floor(F.unix_timestamp(at.cast("timestamp")) / 600) * 600).cast("string")
    return F.when(batch_type == "EOD", "EOD").otherwise(F.concat(F.lit("INTRADAY-"), seconds))


def live_key(business_date: Column) -> Column:
    return F.concat(F.lit("LIVE-"), business_date.cast("string"))


def order_of(liquidity: Column, taker_order_id: Column, maker_order_id: Column) -> Column:
    """The order of an execution: the taker's for a taker, else the maker's."""
    return F.when(liquidity == "TAKER", taker_order_id).otherwise(maker_order_id)
