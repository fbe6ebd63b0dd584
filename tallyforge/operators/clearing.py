"""End-of-day and intraday clearing at a ledger watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import assets
from tallyforge.functions.rules import scope_filter
from tallyforge.operators.ledger import _daily_sums, _day_measures, daily_sums, up_to

WIDE = "decimal(38,8)"
MOVED = ("net_change", "fee_total", "trade_value", "trade_count")
RESULT = ("opening_balance", "closing_balance", "net_change", "fee_total", "trade_count", "trade_value")


def eod_results(results: DataFrame, batches: DataFrame, before: str) -> DataFrame:
    """FINAL results of EOD batches with an earlier business date. There are few batches: a few a day."""
    eod = batches.where(F.col("batch_type") == "EOD").select(F.col("id").alias("batch_id"))
    return results.where((F.col("status") == "FINAL") & (F.col("business_date") < F.lit(before).cast("date"))).join(eod, "batch_id", "left_semi")


def opening_asof(results: DataFrame, batches: DataFrame, before: str) -> DataFrame:
    """(account_id, asset, opening): the closing of the latest earlier date, ties by the largest id."""
    latest = F.max_by("closing_balance", F.struct("business_date", "id"))
    return eod_results(results, batches, before).groupBy("account_id", F.upper("asset").alias("asset")).agg(latest.cast(WIDE).alias("opening"))


def previous_closings(results: DataFrame, batches: DataFrame, before: str) -> DataFrame:
    """All earlier closings of each account and asset with their place, the latest first."""
    order = Window.partitionBy("account_id", F.upper("asset")).orderBy(F.desc("business_date"), F.desc("id"))
    return eod_results(results, batches, before).withColumn("place", F.row_number().over(order))


def clear_from(ledger: DataFrame, results: DataFrame, batches: DataFrame, date: str, max_id: int | Column, scope: str = "") -> DataFrame:
    """clear() with the openings as of the date from stored results: the closing of the latest earlier end-of-day batch, where there is one."""
    return clear(ledger, date, max_id, scope, opening_asof(results, batches, date))


def clear(ledger: DataFrame, date: str, max_id: int | Column, scope: str = "", openings: DataFrame | None = None) -> DataFrame:
    """(account_id, asset, opening_balance, closing_balance, net_change, fee_total, trade_count, trade_value) of a business date.

    closing sums the ledger up to the watermark, an id or the condition of the rows up to it; the rest sums those of the day, apart, so that the
    history moves no more than an amount a row. A given opening stands, else it is closing - net. Rows in which all six are 0 are left out. The day
    is summed by trade first, so that distinct trades of a hot account are counted in many tasks.
    """
    rows = ledger.where(up_to(max_id) & scope_filter(scope))
    closing = rows.groupBy("account_id", F.upper("asset").alias("asset")).agg(F.coalesce(F.sum("amount"), F.lit(0)).cast(WIDE).alias("closing_balance"))
    day = daily_sums(rows.where(_today(date))).withColumnsRenamed({"account_id": "_account", "asset": "_asset"})
    both = closing.join(day, F.col("account_id").eqNullSafe(F.col("_account")) & F.col("asset").eqNullSafe(F.col("_asset")), "left")
    return _derived(both.select("account_id", "asset", "closing_balance", *[F.coalesce(c, F.lit(0)).alias(c) for c in MOVED]), openings)


def _today(date: str) -> Column:
    day = F.lit(date).cast("date")
    return (F.col("created_at") >= day.cast("timestamp")) & (F.col("created_at") < F.date_add(day, 1).cast("timestamp"))


def clear_incremental(ledger: DataFrame, date: str, max_id: int | Column, previous_max_id: int | Column, previous: DataFrame, scope: str = "", openings: DataFrame | None = None) -> DataFrame:
    """clear() from the closings (account_id, asset, closing_balance) of an earlier watermark and the rows since; rows of the day
    itself are read whatever their id, so that the day's figures are whole."""
    today, new = _today(date), ~up_to(previous_max_id)
    rows = ledger.where(up_to(max_id) & (new | today) & scope_filter(scope))
    by_trade = rows.groupBy("account_id", F.upper("asset").alias("asset"), F.when(today, F.col("trade_id")).alias("trade")).agg(F.sum(F.when(new, F.col("amount"))).alias("all"), *_day_measures(today))
    moved = _daily_sums(by_trade, F.sum("all").alias("moved"))
    before = previous.where(scope_filter(scope)).select(F.col("account_id").alias("_account"), F.upper("asset").alias("_asset"), F.col("closing_balance").alias("before"))
    both = moved.join(before, F.col("account_id").eqNullSafe(F.col("_account")) & F.col("asset").eqNullSafe(F.col("_asset")), "full_outer")
    zero = F.lit(0)
    filled = both.select(F.coalesce("account_id", "_account").alias("account_id"), F.coalesce("asset", "_asset").alias("asset"), (F.coalesce("before",
        zero) + F.coalesce("moved", zero)).cast(WIDE).alias("closing_balance"), *[F.coalesce(c, zero).alias(c) for c in MOVED])
    return _derived(filled, openings)


def _derived(sums: DataFrame, openings: DataFrame | None) -> DataFrame:
    opening = (F.col("closing_balance") - F.col("net_change")).cast(WIDE)
    if openings is not None:
        sums = sums.join(openings, ["account_id", "asset"], "left")
        opening = F.coalesce(F.col("opening"), opening).cast(WIDE)
    found = sums.select("account_id", "asset", opening.alias("opening_balance"), "closing_balance", F.col("net_change").cast(WIDE),
        F.col("fee_total").cast(WIDE), F.col("trade_count").cast("long"), F.col("trade_value").cast(WIDE))
    some = F.lit(False)
    for c in RESULT:
        some = some | (F.col(c) != 0)
    return found.where(some)


def violations(results: DataFrame) -> DataFrame:
    """results with violation, for those that break a rule: the first that does."""
    rules = F.when(F.col("opening_balance") + F.col("net_change") != F.col("closing_balance"), "OPENING_PLUS_NET").when(F.col("trade_count") < 0,
        "NEGATIVE_COUNT").when(F.col("trade_value") < 0, "NEGATIVE_VALUE")
    rules = rules.when(F.col("fee_total") < 0, "NEGATIVE_FEE").when((F.col("trade_count") == 0) & (F.col("trade_value") != 0), "VALUE_WITHOUT_TRADES")
    return results.withColumn("violation", rules).where("violation is not null")


def checked(results: DataFrame) -> DataFrame:
    """results, or ValueError if any breaks a rule: a batch with one fails as a whole."""
    if bad := violations(results).first():
        raise ValueError(f"clearing is inconsistent: {bad['violation']} for account {bad['account_id']}, {bad['asset']}")
    return results


def universe(ledger: DataFrame, max_id: int | Column, scope: str = "") -> DataFrame:
    """(account_id, asset) of all holders up to the watermark; today's active keys are among them."""
    return ledger.where(up_to(max_id) & scope_filter(scope)).select("account_id", F.upper("asset").alias("asset")).distinct()


def stamped(results: DataFrame, batch_id: int, date: str, batch_type: str) -> DataFrame:
    """Rows of the result table: FINAL for EOD, else PRELIMINARY."""
    return results.select(F.lit(batch_id).cast("long").alias("batch_id"), F.lit(date).cast("date").alias("business_date"), "account_id", "asset",
        *[F.col(c).cast(assets.SETTLED if c != "trade_count" else "long") for c in RESULT],
        F.lit("FINAL" if batch_type == "EOD" else "PRELIMINARY").alias("status"))


def results_with_batch(results: DataFrame, batches: DataFrame, batch_type: str | None = None) -> DataFrame:
    chosen = batches if batch_type is None else batches.where(F.col("batch_type") == batch_type)
    return results.join(chosen.select(F.col("id").alias("batch_id"), "batch_type", "snapshot_key"), "batch_id")


def latest_batches(batches: DataFrame, status: str | None = None) -> DataFrame:
    """The newest batch, by id, of each business date, type and scope."""
    rows = batches if status is None else batches.where(F.col("status") == status)
    newest = rows.groupBy("business_date", "batch_type", F.coalesce("scope", F.lit("")).alias("scope"))
    return newest.agg(F.max("id").alias("id"), F.max_by("status", "id").alias("status"), F.max_by("snapshot_key", "id").alias("snapshot_key"))


def next_attempts(batches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, next_attempt): one more than the largest attempt."""
    return batches.groupBy(*keys).agg((F.coalesce(F.max("attempt"), F.lit(0)) + 1).cast("int").alias("next_attempt"))
