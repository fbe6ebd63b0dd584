"""Anomaly patterns over time windows, order limits and blocked accounts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.storage import stored

#: Patterns are logged above, not at, these counts. Fixed values.
FLOOD, CANCELS, FLOODS_TO_BLOCK, LARGE = 100, 50, 3, 100
RATE_LIMIT, DAILY_LIMIT, VOLUME_LIMIT = 10, 1000, 100_000_000


def counts_in_windows(commands: DataFrame, command: str, keys: list[str], length: str = "1 minute") -> DataFrame:
    """(keys, start, n): commands of a kind in tumbling windows."""
    return commands.where(F.col("command_type") == command).groupBy(*keys, F.window("ts",
        length).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def order_flood(commands: DataFrame, threshold: int = FLOOD, by_symbol: bool = False, length: str = "1 minute") -> DataFrame:
    """Windows in which an account, or an account in a symbol, sent more orders than the threshold, as log rows."""
    keys = ["account_id", "symbol"] if by_symbol else ["account_id"]
    return _logged(counts_in_windows(commands, "NEW", keys, length).where(F.col("n") > threshold), "ORDER_FLOOD", by_symbol)


def cancel_repeat(commands: DataFrame, threshold: int = CANCELS, length: str = "1 minute") -> DataFrame:
    return _logged(counts_in_windows(commands, "CANCEL", ["account_id", "symbol"], length).where(F.col("n") > threshold), "CANCEL_REPEAT", True)


def _logged(found: DataFrame, pattern: str, by_symbol: bool) -> DataFrame:
    symbol = F.col("symbol") if by_symbol else F.lit(None).cast("string")
    return found.select("account_id", symbol.alias("symbol"), F.lit(pattern).alias("pattern_type"), "n", F.col("end").alias("detected_at"))


def flood_escalation(log: DataFrame, floods: int = FLOODS_TO_BLOCK, seconds: int = 3600) -> DataFrame:
    """log with n_recent and action: an account-level flood that is at least the floods-th flood row of the account within the trailing
    seconds blocks the account. Symbol-level floods count but do not block.

    Time is cut in parts as long as the frame, and each part has the rows of the one before as a halo: a hot account is many small windows."""
    at = F.unix_timestamp(F.col("detected_at").cast("timestamp"))
    rows = log.where(F.col("pattern_type") == "ORDER_FLOOD").withColumns({"_at": at, "_part": F.floor(at / seconds)})
    own, halo = F.struct(F.col("_part").alias("part"), F.lit(True).alias("own")), F.struct((F.col("_part") + 1).alias("part"), F.lit(False).alias("own"))
    dealt = rows.withColumn("_dealt", F.explode(F.when(F.col("_at").isNull(), F.array(own)).otherwise(F.array(own, halo))))
    frame = Window.partitionBy("account_id", "_dealt.part").orderBy("_at").rangeBetween(-seconds, 0)
    counted = dealt.withColumn("n_recent", F.count("*").over(frame)).where("_dealt.own")
    blocks = F.col("symbol").isNull() & (F.col("n_recent") >= floods)
    return counted.select(*log.columns, "n_recent", F.when(blocks, "Account blocked").alias("action"))


def large_order(orders: DataFrame, factor: int = LARGE, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Orders over factor times the average quantity of the symbol's orders before them, with that average as sum and count.

    The running sums have two levels, days and orders within a day, so that a symbol's history is not one task.
    """
    rows = orders.withColumn("_day", F.to_date("ts"))
    days = rows.groupBy("symbol", "_day").agg(F.sum("quantity").alias("_sum"), F.count("quantity").alias("_n"))
    before = Window.partitionBy("symbol").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    days = days.select("symbol", "_day", F.coalesce(F.sum("_sum").over(before), zero).alias("_sum"), F.coalesce(F.sum("_n").over(before), zero).alias("_n"))
    inside = Window.partitionBy("symbol", "_day").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_s": F.coalesce(F.sum("quantity").over(inside), zero), "_c": F.coalesce(F.count("quantity").over(inside), zero)}).join(days, ["symbol", "_day"])
    rows = rows.withColumns({"sum_before": (F.col("_s") + F.col("_sum")).cast("decimal(38,8)"), "n_before": (F.col("_c") + F.col("_n")).cast("long")})
    return rows.where((F.col("n_before") > 0) & (F.col("quantity") * F.col("n_before") > F.col("sum_before") * factor)).select(*orders.columns, "sum_before", "n_before")


def pattern_counts(log: DataFrame, since: str | None = None, by_symbol: bool = False) -> DataFrame:
    rows = log if since is None else log.where(F.col("detected_at") >= F.lit(since).cast("timestamp"))
    return rows.groupBy("account_id", *(["symbol"] if by_symbol else []), "pattern_type").agg(F.count("*").alias("n"))


def anomaly_log_by(log: DataFrame, account_id: int | None = None, pattern: str | None = None, since: str | None = None, unactioned: bool = False) -> DataFrame:
    rows = log
    if account_id is not None:
        rows = rows.where(F.col("account_id") == account_id)
    if pattern is not None:
        rows = rows.where(F.col("pattern_type") == pattern)
    if since is not None:
        rows = rows.where(F.col("detected_at") >= F.lit(since).cast("timestamp"))
    return rows.where(~F.col("action_taken")) if unactioned else rows


def block_precheck(commands: DataFrame, blocked: DataFrame, halted: DataFrame | None = None) -> DataFrame:
    """NEW commands with reject: ACCOUNT_BLOCKED, SYMBOL_HALTED or null."""
    rows = commands.where(F.col("command_type") == "NEW")
    rows = rows.join(blocked.where(F.col("status") == "BLOCKED").select(F.col("account_id").alias("user_id"), F.lit(True).alias("_blocked")).distinct(), "user_id", "left")
    rows = rows.withColumn("_halted", F.lit(None).cast("boolean")) if halted is None else rows.join(halted.select("symbol", F.lit(True).alias("_halted")).distinct(), "symbol", "left")
    return rows.withColumn("reject", F.when(F.col("_blocked"), "ACCOUNT_BLOCKED").when(F.col("_halted"), "SYMBOL_HALTED")).select(*commands.columns, "reject")


def _in_turn(orders: DataFrame, user: str, order: tuple[str, ...], added: str, decide: Callable, *inputs: str) -> DataFrame:
    """orders with the columns added, which decide(state, micros, *inputs) -> (state, values) gives for each user's orders in turn.

    Rows are sorted by user and order and read in batches; a task has one batch and one user's state, not a user's history.
    The state before a user's first order is None.
    """
    names, n = orders.columns, len(orders.columns)
    given = [n, *[names.index(c) for c in (user, *inputs)]]
    types = [{"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[x.split()[1]] for x in added.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for batch in batches:
            out = []
            for at, who, *xs in zip(*[batch.column(i).to_pylist() for i in given]):
                if who != last:
                    last, state = who, None
                state, values = decide(state, at, *xs)
                out.append(values)
            columns = [pa.array([v[i] for v in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *columns], [*names, *[x.split()[0] for x in added.split(", ")]])

    timed = orders.withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")))
    return timed.repartition(user).sortWithinPartitions(user, *[F.col(c).asc_nulls_last() for c in order]).mapInArrow(run, _with(orders, added))


def _started(df: DataFrame, kept: list[str], *added: str) -> DataFrame:
    return df.select(*kept, F.timestamp_micros("_start").alias("window_start"), *added)


def window_starts(times: DataFrame, length: int) -> DataFrame:
    """(who, at): the times at which windows open, of different times (who, at) in microseconds: the first of each who, and from each
    start the first time that is at least length later.

    A time after a gap of length is a start whatever came before it, so chains of starts are followed only from gap to gap, all of
    them at once, by pointer doubling: each time points to the one at which the next window would open, and pointers are joined to
    themselves, so 2^k starts of a chain are known after k rounds. All of a who's times lie in buckets of length, and rows are
    dealt by (who, bucket) or (who, time); only the buckets themselves, of which a who has no more than its time span allows, are ordered
    for each who.
    """

    def bucket(at):
        return at - F.pmod(at, F.lit(length))

    times = stored(times.withColumn("bucket", bucket(F.col("at"))), "window-times")
    by_who = Window.partitionBy("who").orderBy("bucket")
    buckets = times.groupBy("who", "bucket").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    two = [F.lead(F.struct("bucket", "first"), k).over(by_who) for k in (1, 2)]
    buckets = stored(buckets.select("who", "bucket", "first", (F.col("first") - F.lag("last").over(by_who) < length).alias("near"), two[0].alias("one"), two[1].alias("two")), "window-buckets")
    reached = buckets.where("near IS NULL OR NOT near").select("who", F.col("first").alias("at"))

    # a time's next start is in the bucket after its own, or is the first time of the bucket that follows that one
    later = F.when(F.col("one.bucket") > F.col("bucket") + length, F.col("one.first")).otherwise(F.col("two.first"))
    asks = times.join(buckets.select("who", "bucket", later.alias("later")), ["who", "bucket"])
    asks = asks.select("who", (F.col("bucket") + length).alias("bucket"), (F.col("at") + length).alias("due"), "at", "later")
    points = times.select("who", "bucket", F.col("at").alias("due"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("later"))
    on = Window.partitionBy("who", "bucket").orderBy(F.desc("due"), F.asc_nulls_first("at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    soon = points.union(asks).withColumn("soon", F.min(F.when(F.col("at").isNull(), F.col("due"))).over(on)).where("at IS NOT NULL")
    jumps = soon.select("who", "at", F.coalesce("soon", "later").alias("to")).where("to IS NOT NULL")
    jumps = stored(jumps.join(reached.select("who", F.col("at").alias("to")), ["who", "to"], "left_anti").select("who", "at", "to"), "window-jumps")

    while True:
        new = stored(reached.join(jumps, ["who", "at"]).select("who", F.col("to").alias("at")), "window-starts")
        if new.isEmpty():
            return reached
        reached = reached.union(new)
        jumps = stored(jumps.join(jumps.select("who", F.col("at").alias("to"), F.col("to").alias("far")), ["who", "to"]).select("who", "at", F.col("far").alias("to")), "window-jumps")


def anchored_limit(orders: DataFrame, limit: int = RATE_LIMIT, seconds: int = 60, user: str = "account_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """orders with window_start, n_in_window and over: a counter opens at a user's first order after the last window's end.

    Starts come from window_starts(); an order is in the last window that started in its own bucket of time or the one before, and
    is counted within its window. So a user's history is many tasks, and the largest is the orders of one window. Orders without a
    time come last, in the last window; users without any time have a window without a start. The order begins with ts. A null user is a user.
    """
    length, names = seconds * 1_000_000, orders.columns
    rows = orders.withColumns({"_who": F.struct(F.col(user).alias("user")), "_at": F.unix_micros(F.col("ts").cast("timestamp"))})
    starts = stored(window_starts(rows.where("_at IS NOT NULL").select(F.col("_who").alias("who"), F.col("_at").alias("at")).distinct(), length), "window-starts")
    own = F.col("at") - F.pmod("at", F.lit(length))
    seen = starts.select("who", "at", F.explode(F.array(own, own + length)).alias("bucket")).groupBy("who", "bucket").agg(F.min("at").alias("early"), F.max("at").alias("late"))
    last = starts.groupBy("who").agg(F.max("at").alias("early")).select("who", F.lit(None).cast("long").alias("bucket"), "early", F.lit(None).cast("long").alias("late"))
    both = seen.union(last).select(F.col("who").alias("_who"), F.struct("bucket").alias("_bucket"), "early", "late").withColumnsRenamed({"early": "_early", "late": "_late"})
    placed = rows.withColumn("_bucket", F.struct((F.col("_at") - F.pmod("_at", F.lit(length))).alias("bucket"))).join(both, ["_who", "_bucket"], "left")
    placed = placed.withColumn("_start", F.when(F.col("_late") <= F.col("_at"), F.col("_late")).otherwise(F.col("_early")))
    turn = Window.partitionBy("_who", "_start").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    counted = placed.withColumn("n_in_window", F.row_number().over(turn).cast("long")).withColumn("over", F.col("n_in_window") > limit)
    return _started(counted, names, "n_in_window", "over")


def daily_order_limit(orders: DataFrame, limit: int = DAILY_LIMIT, seconds: int = 86400, block_seconds: int = 86400, user: str = "account_id",
    order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """orders with window_start, n_in_window and accepted: the anchored counter, with an order above the limit refused and the user
    blocked for block_seconds from it. Orders in a block are refused and do not count; they show the counter as it stands."""

    def decide(state, at):
        start, n, until = state or (at, 0, None)
        if until is not None and at is not None and at < until:
            return (start, n, until), (start, n, False)
        if at is not None and start is not None and at >= start + seconds * 1_000_000:
            start, n = at, 0
        n += 1
        if n > limit and at is not None:
            until = at + block_seconds * 1_000_000
        return (start, n, until), (start, n, n <= limit)

    return _started(_in_turn(orders, user, order, "_start long, n_in_window long, accepted boolean", decide), orders.columns, "n_in_window", "accepted")


def _with(df: DataFrame, added: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), added])


def tumbling_limit(orders: DataFrame, limit: int = RATE_LIMIT, length: str = "1 minute", user: str = "account_id") -> DataFrame:
    """(user, start, n): the built-in variant with windows fixed on the clock."""
    return orders.groupBy(user, F.window("ts", length).alias("w")).agg(F.count("*").alias("n")).where(F.col("n") > limit).select(user, F.col("w.start").alias("start"), "n")


def volume_sessions(orders: DataFrame, limit: int = VOLUME_LIMIT, gap: str = "24 hours", user: str = "account_id") -> DataFrame:
    """(user, start, end, volume, over): notional that adds up until a gap without orders; sessions are merged by partial sums."""
    found = orders.groupBy(user, F.session_window("ts", gap).alias("w")).agg(F.sum("notional").cast("decimal(38,8)").alias("volume"))
    return found.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "volume", (F.col("volume") > limit).alias("over"))


def volume_step(state: tuple | None, at: int | None, x: Decimal | None, limit: int) -> tuple[tuple, tuple[bool]]:
    """One order of volume_limit(): the state (accepted total, until when it counts, until when blocked) after it, and whether it is accepted."""
    total, until, blocked = state or (0, None, None)
    if blocked is not None and at is not None and at < blocked:
        return (total, until, blocked), (False,)
    if until is None or at is not None and at >= until:
        total = 0
    then = None if at is None else at + 86400 * 1_000_000
    if total + (x or 0) > limit:
        return (total, until, then), (False,)
    return (total + (x or 0), then, blocked), (True,)


def volume_limit(orders: DataFrame, limit: int = VOLUME_LIMIT, user: str = "account_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """orders with accepted: the exact rule. Accepted notional adds up, and lasts for 24 hours from the last accepted order; an order
    that would exceed the limit is refused, is not added, and blocks the user for 24 hours, in which all orders are refused. A null
    notional adds nothing."""
    return _in_turn(orders, user, order, "accepted boolean", lambda state, at, x: volume_step(state, at, x, limit), "notional")


def validate_risk(orders: DataFrame, volume: int = VOLUME_LIMIT, daily: int = DAILY_LIMIT, rate: int = RATE_LIMIT, user: str = "account_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """orders with refused: the chain of all checks for each user's orders in turn, null for an accepted order.

    BLOCKED while the user is blocked; then VOLUME, as in volume_limit; then DAILY, the count of a day from its first order; then RATE, the
    count of a minute from its first. A refused volume is not added and is not counted as an order; what a check has added stays added
    when a later one refuses. VOLUME and DAILY block the user for 24 hours, RATE does not. Orders without a time start no window.
    """
    second = 1_000_000
    day = 86400 * second

    def counted(window, at, length):
        start, n = window
        if start is None or at is not None and at >= start + length:
            start, n = at, 0
        return start, n + 1

    def decide(state, at, x):
        total, until, blocked, by_day, by_minute = state or (0, None, None, (None, 0), (None, 0))
        if blocked is not None and at is not None and at < blocked:
            return state, ("BLOCKED",)
        then = None if at is None else at + day
        if until is None or at is not None and at >= until:
            total = 0
        if total + (x or 0) > volume:
            return (total, until, then, by_day, by_minute), ("VOLUME",)
        total, until = total + (x or 0), then
        by_day = counted(by_day, at, day)
        if by_day[1] > daily:
            return (total, until, then, by_day, by_minute), ("DAILY",)
        by_minute = counted(by_minute, at, 60 * second)
        return (total, until, blocked, by_day, by_minute), ("RATE" if by_minute[1] > rate else None,)

    return _in_turn(orders, user, order, "refused string", decide, "notional")
