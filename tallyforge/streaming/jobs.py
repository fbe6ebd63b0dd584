"""Streaming jobs. Each uses the batch columns; a job that keeps tables writes them in foreachBatch, keyed so that a batch that
is run again changes nothing."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tallyforge.operators import balances as bal
from tallyforge.operators import ledger as led
from tallyforge.operators import orders as ords
from tallyforge.operators import settlement
from tallyforge.operators.matching import COLUMNS, EVENTS, Book, framed
from tallyforge.operators.risk import volume_step
from tallyforge.sources import events, versions


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path; None as long as nothing has been written."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    """A query that takes all that is there and ends."""
    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_within(stream: DataFrame, keys: list[str], time: str, lateness: str) -> DataFrame:
    """The first row of each key as long as copies come within the lateness; state is bounded by it."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def post_ledger(path: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """Appends an execution batch to the ledger exactly once: keys of other batches are left out, and a batch's own rows are
    replaced when it runs again. Ids go on from the largest of the batches before."""

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = _stored(spark, path)
        before = None if before is None else before.where(F.col("batch") < n)
        start_id = 0 if before is None else before.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        rows = led.with_ids(led.post_ledger(batch, order, before), [F.col("posted"), F.col("leg"), F.col("idempotency_key")], start_id)
        rows.drop("posted", "leg").write.mode("overwrite").parquet(f"{path}/batch={n}")

    return write


def split_executions(path: str) -> Callable[[DataFrame, int], None]:
    """Parses a batch of execution texts (value) and writes the valid rows and the quarantined ones, with reason and text, as two parts of
    one table under the batch's id: one commit makes both visible, and a batch that runs again replaces both."""

    def write(batch: DataFrame, n: int) -> None:
        bad = F.col("reject").isNotNull()
        parsed = events.parse_executions(batch).withColumn("raw", F.when(bad, F.col("raw"))).withColumn("sink", F.concat(F.when(bad, "quarantine-").otherwise("valid-"), F.lit(str(n))))
        versions.replace_parts(parsed, path, "sink", [f"valid-{n}", f"quarantine-{n}"])

    return write


def executions_in(spark: SparkSession, path: str, sink: str) -> DataFrame:
    """The rows of sink valid or quarantine that split_executions() has written."""
    found = versions.read(spark, path, [p for p in versions.manifest(spark, path)["parts"] if p.startswith(f"{sink}-")])
    return found.drop("sink", *(("reject", "raw") if sink == "valid" else ()))


def project_orders(path: str, tie: list[str]) -> Callable[[DataFrame, int], None]:
    """Upserts by event_seq: versions of a batch's orders that are newer than the stored ones. latest_orders() reads the result."""

    def write(batch: DataFrame, n: int) -> None:
        before = _stored(batch.sparkSession, path)
        stored = None if before is None else before.where(F.col("batch") < n).groupBy("order_id").agg(F.max("event_seq").alias("last_event_seq"))
        ords.project_orders(batch, tie, stored).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return write


def order_versions(updates: DataFrame, tie: list[str]) -> DataFrame:
    """The same by state: each order's last update so far, to be written in update mode with keep_versions(). A batch costs what its own
    orders cost, however many were met before; the state has one row for each order."""
    late = F.col("event_seq").isNull().cast("int")
    order = F.struct((-late).alias("_rank"), (-F.coalesce("event_seq", F.lit(0))).alias("_seq"), *[F.col(c) for c in tie])
    last = updates.groupBy(F.col("order_id").alias("_order")).agg(F.min_by(F.struct(*updates.columns), order).alias("v"))
    return last.select("v.*")


def keep_versions(path: str) -> Callable[[DataFrame, int], None]:
    """Writes the changed rows of a batch; run again, it replaces them."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return write


def latest_orders(versions: DataFrame) -> DataFrame:
    kept = [c for c in versions.columns if c != "batch"]
    return versions.groupBy("order_id").agg(F.max_by(F.struct(*kept), "batch").alias("v")).select("v.*")


def project_trades(path: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, n: int) -> None:
        before = _stored(batch.sparkSession, path)
        stored = None if before is None else before.where(F.col("batch") < n).select("event_id", "trade_id", F.col("user_id").alias("account_id"))
        ords.project_trades(batch, order, stored).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return write


def running_balances(postings: DataFrame) -> DataFrame:
    """(account_id, asset, available): to be written in update mode."""
    return postings.groupBy("account_id", F.upper("asset").alias("asset")).agg(F.sum("amount").cast("decimal(38,8)").alias("available"))


def risk_diffs(path: str) -> Callable[[DataFrame, int], None]:
    """Commands of accounts that turn negative, once: from updated balances against the accounts that earlier batches blocked."""

    def write(batch: DataFrame, n: int) -> None:
        before = _stored(batch.sparkSession, path)
        bad = bal.risk_state(batch.withColumn("locked", F.lit(0))).where(F.col("status") == "BLOCKED")
        if before is not None:
            bad = bad.join(before.where(F.col("batch") < n).select("account_id"), "account_id", "left_anti")
        bad.select("account_id", F.lit("BLOCK_ACCOUNT").alias("command_type"), F.col("block_reason").alias("reason")).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return write


def anomaly_counts(commands: DataFrame, command: str, keys: list[str], lateness: str = "10 minutes", length: str = "1 minute") -> DataFrame:
    """Counts in tumbling windows, each out once its window is closed by the watermark."""
    late = commands.where(F.col("command_type") == command).withWatermark("ts", lateness)
    return late.groupBy(*keys, F.window("ts", length).alias("w")).agg(F.count("*").alias("n"))


def floods(counts: DataFrame, threshold: int) -> DataFrame:
    return counts.where(F.col("n") > threshold).select("account_id", F.col("w.end").alias("detected_at"), "n")


def cancel_repeats(counts: DataFrame, threshold: int) -> DataFrame:
    return counts.where(F.col("n") > threshold).select("account_id", "symbol", F.col("w.end").alias("detected_at"), "n")


def flood_log(commands: DataFrame, threshold: int, lateness: str = "10 minutes", length: str = "1 minute") -> DataFrame:
    """Flood windows of accounts and of accounts in a symbol (null for the first), each out once the watermark has closed it."""
    timed = commands.where(F.col("command_type") == "NEW").withWatermark("ts", lateness)
    levels = F.array(F.struct(F.lit(False).alias("one"), F.lit(None).cast("string").alias("symbol")), F.struct(F.lit(True).alias("one"), F.col("symbol").alias("symbol")))
    each = timed.select("account_id", "ts", F.explode(levels).alias("level"))  # one state for both levels
    found = each.groupBy("account_id", "level", F.window("ts", length).alias("w")).agg(F.count("*").alias("n")).where(F.col("n") > threshold)
    return found.select("account_id", F.col("level.symbol").alias("symbol"), F.window_time("w").alias("at"), F.col("w.end").alias("detected_at"), "n")


class Escalation(StatefulProcessor):
    """Counts an account's floods in the trailing seconds at each flood. Its state is the times of floods, which a timer drops when
    no later flood can count them.

    Windows are closed in order of their ends, and those of one end in one batch, so all that a flood has to count is here when it comes.
    """

    def __init__(self, floods: int, seconds: int) -> None:
        self.floods, self.micros = floods, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "at long")

    def _kept(self, since: int) -> list[int]:
        return sorted(t for (t,) in self.times.get() if t >= since)

    def _wake(self, at: int) -> None:
        self.handle.registerTimer((at + self.micros) // 1000 + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        ends = [int(t.value // 1000) for t in pd.to_datetime(new["detected_at"])]
        before = self._kept(min(ends) - self.micros)
        times = sorted(before + ends)
        new["n_recent"] = [bisect_right(times, t) - bisect_left(times, t - self.micros) for t in ends]
        blocks = new["symbol"].isna() & (new["n_recent"] >= self.floods)
        new["action"] = ["Account blocked" if b else None for b in blocks]
        kept = [t for t in times if t >= max(ends) - self.micros]
        self.times.put([(t,) for t in kept])
        if not before:
            self._wake(kept[0])
        yield new[["account_id", "symbol", "detected_at", "n", "n_recent", "action"]]

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        kept = self._kept(now - self.micros)
        if kept:
            self.times.put([(t,) for t in kept])
            self._wake(kept[0])
        else:
            self.times.clear()
        return iter(())

    def close(self) -> None:
        pass


def escalations(log: DataFrame, floods: int = 3, seconds: int = 3600) -> DataFrame:
    """flood_log() with n_recent and action, as risk.flood_escalation() gives them for a table. Start it with keyed_state()."""
    schema = "account_id long, symbol string, detected_at timestamp, n long, n_recent long, action string"
    return log.groupBy("account_id").transformWithStateInPandas(Escalation(floods, seconds), schema, "Append", "EventTime")


def keyed_state(spark: SparkSession, begin: Callable[[], object]) -> object:
    """begin(), which starts a stream with lists and timers as state: these need the store on disk, of which a batch writes the changes."""
    store = "spark.sql.streaming.stateStore"
    wanted = {f"{store}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", f"{store}.rocksdb.changelogCheckpointing.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        return begin()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def match_orders(commands: DataFrame, keep_done: int = 10_000) -> DataFrame:
    """Order updates and fills per symbol, with the book as keyed state. Of a symbol's terminal orders the newest keep_done stay; of
    the others only account and client id, so that a repeated command is ignored however late. The rest of the state is the
    resting orders."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        book = Book(state.get[0] if state.exists else None)
        place = state.get[1] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(["received_at", "_new", "seq"], kind="stable")
        events = book.replay(rows)
        book.forget_done(keep_done)
        out = framed(key[0], events)
        out["place"] = out["place"] + place
        state.update((book.state(), place + len(out)))
        yield out[COLUMNS]

    rows = commands.withColumns({"_new": (F.col("command_type") != "NEW").cast("int"), "price": F.col("price").cast("long"), "quantity": F.col("quantity").cast("long")})
    return rows.groupBy("symbol").applyInPandasWithState(run, EVENTS, "book string, place long", "append", "NoTimeout")


class VolumeLimit(StatefulProcessor):
    """risk.volume_limit() for one account on a stream: orders wait until the watermark has passed them, and are then decided in order of
    time and event id. A timer wakes the account for its first waiting order, and drops its state when it no longer counts."""

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long, notional string")
        self.sums = handle.getValueState("sums", "total string, until long, blocked long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        given = list(zip((int(a) for a in new["at"]), (int(e) for e in new["event_id"]), (None if pd.isna(x) else str(x) for x in new["notional"])))
        before = min((r[0] for r in self.waiting.get()), default=None)
        self.waiting.appendList(given)
        first = min(r[0] for r in given)
        if before is None or first < before:
            self._wake(first)
        return iter(())

    def _wake(self, at: int) -> None:
        self.handle.registerTimer((at + 999) // 1000)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2])
        due, rest = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        held = self.sums.get() if self.sums.exists() else None
        state, made = held and (Decimal(held[0]), held[1], held[2]), []
        for at, event_id, x in due:
            state, (accepted,) = volume_step(state, at, None if x is None else Decimal(x), self.limit)
            made.append((key[0], event_id, at, accepted))
        until = max((t for t in (state or ())[1:] if t is not None), default=0)
        if state and until > now:
            self.sums.update((str(state[0]), state[1], state[2]))
        else:
            self.sums.clear()
        if rest:
            self.waiting.put(rest)
            self._wake(rest[0][0])
        else:
            self.waiting.clear()
            if state and until > now:
                self._wake(until)
        if made:
            yield pd.DataFrame(made, columns=["account_id", "event_id", "at", "accepted"])

    def close(self) -> None:
        pass


def volume_limit(orders: DataFrame, lateness: str, limit: int) -> DataFrame:
    """(account_id, event_id, at, accepted): the exact daily volume on a stream; at is the time in microseconds. Orders later than the lateness
    or without a time are not decided. Start it with keyed_state()."""
    timed = orders.where(F.col("ts").isNotNull()).withWatermark("ts", lateness)
    rows = timed.select("account_id", "event_id", "ts", F.unix_micros("ts").alias("at"), "notional")
    return rows.groupBy("account_id").transformWithStateInPandas(VolumeLimit(limit), "account_id long, event_id long, at long, accepted boolean", "Append", "EventTime")


def volume_sessions(orders: DataFrame, lateness: str = "1 hour", gap: str = "24 hours") -> DataFrame:
    return orders.withWatermark("ts", lateness).groupBy("account_id", F.session_window("ts", gap).alias("w")).agg(F.sum("notional").cast("decimal(38,8)").alias("volume"))


def settlement_events(path: str, batches: DataFrame) -> Callable[[DataFrame, int], None]:
    """New clearing results to outbox events, one for each key whatever is run again."""

    def write(batch: DataFrame, n: int) -> None:
        before = _stored(batch.sparkSession, path)
        stored = None if before is None else before.where(F.col("batch") < n)
        settlement.append_outbox(settlement.build_events(batch, batches), stored).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return write
