"""Settlement events, the outbox, and finding events that are missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.ledger import first_by

TOPIC, PRODUCER, EVENT, VERSION = "clearing.settlement", "clearing", "SETTLEMENT", 1


def settlement_key(batch_id, account_id, asset):
    return F.concat_ws(":", F.lit("clearing:settlement"), batch_id.cast("string"), account_id.cast("string"), asset)


def build_events(results: DataFrame, batches: DataFrame) -> DataFrame:
    """results joined with their batches -> outbox rows, one JSON event each; the payload's key is the account."""
    of_batch = batches.select(F.col("id").alias("batch_id"), "batch_type", "snapshot_key")
    rows = results.join(of_batch, "batch_id")
    money = {"openingBalance": "opening_balance", "closingBalance": "closing_balance", "netChange": "net_change", "feeTotal": "fee_total", "tradeValue": "trade_value"}
    body = F.struct(
        F.lit(EVENT).alias("eventType"), F.col("business_date").cast("string").alias("businessDate"), F.col("batch_id").alias("batchId"), F.col("batch_type").alias("batchType"),
        F.col("account_id").alias("accountId"), "asset", "status", *[F.col(c).cast("string").alias(k) for k, c in money.items()],
            F.col("trade_count").alias("tradeCount"), F.col("snapshot_key").alias("snapshotKey"),
    )
    payload = F.to_json(F.struct(F.lit(VERSION).alias("schemaVersion"), F.lit(TOPIC).alias("topic"), F.col("account_id").cast("string").alias("key"),
        F.lit(PRODUCER).alias("producer"), F.lit(EVENT).alias("eventType"), body.alias("body")))
    return rows.select(
        F.lit("CLEARING").alias("producer_type"), F.lit(EVENT).alias("event_type"), F.lit("CLEARING_RESULT").alias("aggregate_type"), F.col("batch_id").alias("aggregate_id"),
        settlement_key(F.col("batch_id"), F.col("account_id"), F.upper("asset")).alias("idempotency_key"), payload.alias("payload"), F.lit("PENDING").alias("status"), F.lit(0).alias("retry_count"),
    )


def append_outbox(events: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Events to add: the first of each idempotency key, by payload, whose key is not stored yet."""
    first = first_by(events, ["idempotency_key"], ["payload"])
    return first if existing is None else first.join(existing.select("idempotency_key"), "idempotency_key", "left_anti").select(*events.columns)


def missing_events(results: DataFrame, outbox: DataFrame) -> DataFrame:
    """Results without an event."""
    key = settlement_key(F.col("batch_id"), F.col("account_id"), F.upper("asset"))
    return results.withColumn("idempotency_key", key).join(outbox.select("idempotency_key"), "idempotency_key", "left_anti")


def incomplete_batches(results: DataFrame, outbox: DataFrame, batches: DataFrame, now: str, minutes: int = 180) -> DataFrame:
    """(batch_id, n_results, n_events): batches that ended SUCCESS or FAILED in the last minutes and have results, but not one event each."""
    done = batches.where(F.col("status").isin("SUCCESS",
        "FAILED") & (F.col("finished_at") >= F.lit(now).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes))) & (F.col("finished_at") <= F.lit(now).cast("timestamp")))
    n_results = results.groupBy("batch_id").agg(F.count("*").alias("n_results"))
    n_events = outbox.where(F.col("event_type") == EVENT).groupBy(F.col("aggregate_id").alias("batch_id")).agg(F.countDistinct("idempotency_key").alias("n_events"))
    both = done.select(F.col("id").alias("batch_id")).join(n_results, "batch_id").join(n_events, "batch_id", "left")
    return both.select("batch_id", "n_results", F.coalesce("n_events", F.lit(0)).alias("n_events")).where("n_results <> n_events")


def outbox_snapshot(outbox: DataFrame, now: str, stuck_seconds: int = 60) -> DataFrame:
    """Counts by status, pending older than the threshold, and whether the backlog raises an alarm."""
    status, old = F.col("status"), F.col("created_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(stuck_seconds))
    counts = outbox.agg(*[F.count_if(status == s).alias(s.lower()) for s in ("PENDING", "SENT", "FAILED")], F.count_if((status == "PENDING") & old).alias("stuck"))
    return counts.withColumn("alarm", (F.col("pending") >= 10_000) | (F.col("failed") >= 100) | (F.col("stuck") > 0))


def oldest_by_status(outbox: DataFrame, status: str, n: int, key: str = "idempotency_key") -> DataFrame:
    return outbox.where(F.col("status") == status).orderBy("created_at", key).limit(n)


def load_batch(outbox: DataFrame, limit: int, max_retries: int, key: str = "idempotency_key") -> DataFrame:
    """Pending events to send next: fewer retries than the most, oldest first."""
    return oldest_by_status(outbox.where(F.col("retry_count") < max_retries), "PENDING", limit, key)
