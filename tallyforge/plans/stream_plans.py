"""Registered queries that run the streaming jobs and the sinks, each to a table that is read back, with their oracles.

A view is laid down as files in three steps of time; after each step the stream takes what is new, from the checkpoint of the step before,
and ends. So each query also shows that a job goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import recon, recon_tree
from tallyforge.operators import ledger as led
from tallyforge.operators.storage import new_folder, stored
from tallyforge.plans import ledger_plans as lp
from tallyforge.plans import matching_sql
from tallyforge.plans import trading_plans as tp
from tallyforge.plans.ledger_plans import money, text
from tallyforge.plans.sql import LEDGER, RESULTS, out
from tallyforge.sources import events, tables, versions
from tallyforge.sources.views import ACTIVITY, EXECUTIONS, ORDER_COMMANDS, ORDER_UPDATES, oracle, view
from tallyforge.streaming import jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Where the steps are cut, for events of trading and for the activity of users.
CUTS = ("1997-01-01", "1999-06-01")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def in_steps(df: DataFrame, time: str, cuts: tuple[str, ...], run: Callable[[DataFrame, str], None]) -> str:
    """Lays df down step by step and calls run(stream, checkpoint) after each; returns the folder that run may write to, beside them."""
    spark = df.sparkSession
    folder = new_folder(spark, "stream")
    bounds = [None, *[F.lit(c).cast("timestamp") for c in cuts], None]
    at = F.col(time).cast("timestamp")
    for low, high in zip(bounds, bounds[1:]):
        step = F.lit(True) if low is None else at >= low
        step = step if high is None else step & (at < high)
        df.where(step).write.mode("append").parquet(f"{folder}/in")
        run(spark.readStream.schema(df.schema).parquet(f"{folder}/in"), folder)
    return folder


def by_batches(df: DataFrame, time: str, write: Callable[[str], Callable]) -> DataFrame:
    """The table that a job with its own writer makes of df."""
    folder = in_steps(df, time, CUTS, lambda stream, f: jobs.start(stream, write(f"{f}/out"), f"{f}/checkpoint").awaitTermination())
    return df.sparkSession.read.parquet(f"{folder}/out")


def appended(df: DataFrame, time: str, cuts: tuple[str, ...], job: Callable[[DataFrame], DataFrame], lists: bool = False) -> DataFrame:
    """The table that a stream in append mode writes."""

    def run(stream: DataFrame, folder: str) -> None:
        to = job(stream).writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        (jobs.keyed_state(df.sparkSession, to.trigger(availableNow=True).start) if lists else to.trigger(availableNow=True).start()).awaitTermination()

    return df.sparkSession.read.parquet(f"{in_steps(df, time, cuts, run)}/out")


@query(lp.ORACLES["post_ledger"])
def stream_post_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = by_batches(view(spark, sf_dir, EXECUTIONS), "executed_at", lambda path: jobs.post_ledger(path, lp.ORDER))
    return found.select("id", "account_id", "asset", money("amount").alias("amount"), "entry_type", "trade_id", "idempotency_key", text("created_at").alias("created_at"))


@query(tp.ORACLES["project_orders"])
def stream_project_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jobs.latest_orders(by_batches(view(spark, sf_dir, ORDER_UPDATES), "event_time", lambda path: jobs.project_orders(path, tp.TIE)))
    return found.select("order_id", "account_id", "client_order_id", "symbol", F.col("new_status").alias("status"), "event_seq",
        money("filled_quantity").alias("filled_quantity"), text("event_time").alias("event_time"))


@query(tp.ORACLES["project_orders"])
def stream_order_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same projection with the last update of each order as state."""

    def run(stream: DataFrame, folder: str) -> None:
        jobs.start(jobs.order_versions(stream, tp.TIE), jobs.keep_versions(f"{folder}/out"), f"{folder}/checkpoint", "update").awaitTermination()

    found = jobs.latest_orders(spark.read.parquet(f"{in_steps(view(spark, sf_dir, ORDER_UPDATES), 'event_time', CUTS, run)}/out"))
    return found.select("order_id", "account_id", "client_order_id", "symbol", F.col("new_status").alias("status"), "event_seq",
        money("filled_quantity").alias("filled_quantity"), text("event_time").alias("event_time"))


@query(tp.ORACLES["project_trades"])
def stream_project_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = view(spark, sf_dir, EXECUTIONS).withColumn("event_id", F.concat_ws(":", "trade_id", "symbol"))
    found = by_batches(x, "executed_at", lambda path: jobs.project_trades(path, tp.TRADE_ORDER)).drop("batch")
    return found.withColumns({c: money(c) for c in ("exec_quantity", "exec_price", "exec_value", "fee_amount")}).withColumn("exec_time", text("exec_time"))


STEP = f"CASE WHEN {{0}} < TIMESTAMP '{CUTS[0]}' THEN 0 WHEN {{0}} < TIMESTAMP '{CUTS[1]}' THEN 1 ELSE 2 END"


@query(f"""WITH {LEDGER}, moved AS (SELECT account_id, asset, {STEP.format("created_at")} AS step, sum(amount) AS amount FROM ledger GROUP BY 1, 2, 3),
held AS (SELECT account_id, asset, step, sum(amount) OVER (PARTITION BY account_id, asset ORDER BY step) AS available FROM moved)
SELECT account_id, 'BLOCK_ACCOUNT' AS command_type, 'Negative balance: ' || asset || ' = ' || CAST(CAST(available AS DECIMAL(38, 8)) AS STRING) AS reason FROM held WHERE available < 0 QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY step, asset) = 1""")
def stream_risk_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances kept as state; each account that turns negative is blocked once."""
    postings = lp.the_ledger(spark, sf_dir).select("id", "account_id", "asset", "amount", "created_at")

    def run(stream: DataFrame, folder: str) -> None:
        q = jobs.running_balances(stream).writeStream.outputMode("update").foreachBatch(jobs.risk_diffs(f"{folder}/out")).option("checkpointLocation", f"{folder}/checkpoint")
        q.trigger(availableNow=True).start().awaitTermination()

    return spark.read.parquet(f"{in_steps(postings, 'created_at', CUTS, run)}/out").drop("batch")


A = f"({oracle(ACTIVITY)})"
LATE = "2 days"


def activity_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple[str, ...]]:
    """The activity, and two times that part it in three."""
    a = view(spark, sf_dir, ACTIVITY).withColumn("ts", F.col("ts").cast("timestamp"))
    least, most = a.agg(F.min("ts"), F.max("ts")).first()
    return a, tuple(str(least + (most - least) * k / 3) for k in (1, 2))


@query(
    f"WITH new AS (SELECT * FROM {A} WHERE command_type = 'NEW') SELECT account_id, CAST({tp.DAY} + INTERVAL 1 DAY AS STRING) AS detected_at, count(*) AS n "
    f"FROM new GROUP BY account_id, {tp.DAY} HAVING count(*) > 1 AND {tp.DAY} + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM new)"
)
def stream_floods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed."""
    a, cuts = activity_of(spark, sf_dir)
    found = appended(a, "ts", cuts, lambda s: jobs.floods(jobs.anomaly_counts(s, "NEW", ["account_id"], LATE, "1 day"), 1))
    return found.select("account_id", text("detected_at").alias("detected_at"), "n")


CLOSED = f"<= (SELECT max(ts) - INTERVAL 2 DAY FROM {A} WHERE command_type = '{{0}}')"


@query(
    f"SELECT account_id, symbol, CAST({tp.DAY} + INTERVAL 1 DAY AS STRING) AS detected_at, count(*) AS n FROM {A} WHERE command_type = 'CANCEL' "
    f"GROUP BY account_id, symbol, {tp.DAY} HAVING {tp.DAY} + INTERVAL 1 DAY {CLOSED.format('CANCEL')}"
)
def stream_cancel_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed; the test events are sparse: more than 0 in a day."""
    a, cuts = activity_of(spark, sf_dir)
    found = appended(a, "ts", cuts, lambda s: jobs.cancel_repeats(jobs.anomaly_counts(s, "CANCEL", ["account_id", "symbol"], LATE, "1 day"), 0))
    return found.select("account_id", "symbol", text("detected_at").alias("detected_at"), "n")


@query(
    f"WITH {tp.FLOODS} SELECT account_id, symbol, CAST(seen_at AS STRING) AS detected_at, n_recent, CASE WHEN symbol IS NULL AND n_recent >= 3 THEN 'Account blocked' END AS action FROM (SELECT *, count(*) OVER "
    f"(PARTITION BY account_id ORDER BY seen_at RANGE BETWEEN INTERVAL 5 DAY PRECEDING AND CURRENT ROW) AS n_recent FROM log) WHERE seen_at {CLOSED.format('NEW')}"
)
def stream_escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floods of days with those of the five days before them, of windows that the watermark has closed."""
    a, cuts = activity_of(spark, sf_dir)
    found = appended(a, "ts", cuts, lambda s: jobs.escalations(jobs.flood_log(s, 1, LATE, "1 day"), 3, 5 * 86400), True)
    return found.select("account_id", "symbol", text("detected_at").alias("detected_at"), "n_recent", "action")


@query(f"SELECT v.event_id, v.account_id, accepted FROM ({tp.VOLUME}) v JOIN {A} e ON e.event_id = v.event_id WHERE e.ts <= (SELECT max(ts) - INTERVAL 2 DAY FROM {A})")
def stream_volume_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact daily volume of orders that the watermark has passed."""
    a, cuts = activity_of(spark, sf_dir)
    a = a.withColumn("notional", (F.col("quantity").cast("decimal(18,2)") * 7).cast("decimal(20,8)"))
    return appended(a, "ts", cuts, lambda s: jobs.volume_limit(s, LATE, 500), True).select("event_id", "account_id", "accepted")


@query(f"""WITH a AS (SELECT *, {tp.N} AS x, CASE WHEN ts >= lag(ts) OVER (PARTITION BY account_id ORDER BY ts, event_id) + INTERVAL 24 HOUR THEN 1 ELSE 0 END AS cut FROM {A}),
s AS (SELECT *, sum(cut) OVER (PARTITION BY account_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM a)
SELECT account_id, CAST(min(ts) AS STRING) AS start, {out("sum(x)")} AS volume FROM s GROUP BY account_id, session HAVING max(ts) + INTERVAL 24 HOUR <= (SELECT max(ts) - INTERVAL 2 DAY FROM a)""")
def stream_volume_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that the watermark has closed."""
    a, cuts = activity_of(spark, sf_dir)
    a = a.withColumn("notional", (F.col("quantity").cast("decimal(18,2)") * 7).cast("decimal(20,8)"))
    found = appended(a, "ts", cuts, lambda s: jobs.volume_sessions(s, LATE))
    return found.select("account_id", text("w.start").alias("start"), money("volume").alias("volume"))


@query(matching_sql.MATCH)
def stream_match_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return appended(view(spark, sf_dir, ORDER_COMMANDS), "received_at", CUTS, jobs.match_orders).withColumn("at", text("at"))


@query(
    f"{lp.EVENTS_SQL.replace('batch_id AS aggregate_id FROM r', 'batch_id AS aggregate_id, ' + STEP.format('business_date') + ' AS step FROM r')} "
    f"SELECT * EXCLUDE (step), {lp.FIXED} FROM e QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY step, payload) = 1"
)
def stream_settlement_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = lp.settlement_batches(spark, sf_dir)
    return by_batches(view(spark, sf_dir, RESULTS), "business_date", lambda path: jobs.settlement_events(path, batches)).drop("batch")


# --- sources and sinks -----------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def load_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load_table(spark, f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_nationkey")


X = f"({oracle(EXECUTIONS)})"


def executions_as_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value, executed_at): executions as JSON, with faults of each kind."""
    k = F.col("k1")
    x = view(spark, sf_dir, EXECUTIONS).withColumns({"trade_id": F.when(k % 7 == 0, " ").otherwise(F.col("trade_id")), "symbol": F.when(k % 11 == 0,
        "").otherwise(F.col("symbol")), "side": F.when(k % 13 == 0, "HOLD").otherwise(F.col("side")), "quantity": F.when(k % 17 == 0,
        0).otherwise(F.col("quantity")), "price": F.when(k % 19 == 0, -1).otherwise(F.col("price"))})
    value = F.to_json(F.struct("trade_id", "account_id", "symbol", "side", "quantity", "price", F.date_format("executed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("executed_at"), "k1", "k2",
        F.col("k1").alias("sourceOffset"), F.col("k2").cast("int").alias("sourcePartition")))
    return x.select(value.alias("value"), "executed_at")


SPLIT = f"""SELECT k1, k2, account_id, CASE WHEN k1 % 7 = 0 THEN 'tradeId' WHEN k1 % 11 = 0 THEN 'symbol' WHEN k1 % 13 = 0 THEN 'side' WHEN k1 % 17 = 0 THEN 'quantity' WHEN k1 % 19 = 0 THEN 'price' END AS reject FROM (SELECT k1, k2, account_id FROM {X})"""


@query(SPLIT)
def split_valid_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executions with faults of each kind: the valid ones, without a reason, and the quarantined ones with it."""
    value = executions_as_texts(spark, sf_dir)
    parsed = events.parse_executions(value.select("value")).withColumn("kept", F.from_json("raw", "k1 long, k2 long"))
    # stored, so that each text is parsed once: a filter on the reason would be pushed below the parse and repeat it for each rule, for each part
    valid, bad = events.split(stored(parsed.select("kept.*", "account_id", "reject"), "parsed"))
    parts = [df.select("k1", "k2", "account_id", reason.alias("reject")) for df, reason in ((valid, F.lit(None).cast("string")), (bad, F.col("reject")))]
    return parts[0].unionByName(parts[1])


@query(SPLIT)
def stream_split_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same split on a stream, both sinks read back; each text's offset and partition tell which it was."""
    folder = in_steps(executions_as_texts(spark, sf_dir), "executed_at", CUTS, lambda s, f: jobs.start(s, jobs.split_executions(f"{f}/out"), f"{f}/checkpoint").awaitTermination())
    valid, bad = (jobs.executions_in(spark, f"{folder}/out", sink) for sink in ("valid", "quarantine"))
    parts = [df.select(F.col("source_offset").alias("k1"), F.col("source_partition").cast("long").alias("k2"), "account_id",
        reason.alias("reject")) for df, reason in ((valid, F.lit(None).cast("string")), (bad, F.col("reject")))]
    return parts[0].unionByName(parts[1])


@query(f"""WITH r AS (SELECT * FROM ({oracle(RESULTS)}) QUALIFY row_number() OVER (PARTITION BY batch_id, account_id, upper(asset) ORDER BY id) = 1)
SELECT batch_id, account_id, upper(asset) AS asset, {out("CASE WHEN batch_id % 2 = 0 AND account_id % 3 = 0 THEN closing_balance + 1 ELSE closing_balance END")} AS closing_balance, CASE WHEN batch_id % 2 = 0 AND account_id % 3 = 0 THEN 'CORRECTED' ELSE status END AS status FROM r""")
def write_clearing_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written, then a third of the accounts of every other batch written again, with the asset in lower case."""
    path = f"{new_folder(spark, 'results')}/table"
    r = led.first_by(view(spark, sf_dir, RESULTS).withColumn("_asset", F.upper("asset")), ["batch_id", "account_id", "_asset"], ["id"]).drop("_asset")
    tables.write_clearing_results(r, path)
    again = r.where("batch_id % 2 = 0 AND account_id % 3 = 0").withColumns({"asset": F.lower("asset"),
        "closing_balance": (F.col("closing_balance") + 1).cast("decimal(20,8)"), "status": F.lit("CORRECTED")})
    tables.write_clearing_results(again, path)
    return versions.read(spark, path).select(F.col("batch_id").cast("long"), "account_id", F.upper("asset").alias("asset"), money("closing_balance").alias("closing_balance"), "status")


@query(
    f"{lp.WITH}{lp.BALANCES}{lp.DIFFS} SELECT CAST(b AS BIGINT) AS recon_batch_id, account_id, "
    f"asset, {out('e')} AS expected_value, {out('a')} AS actual_value FROM norm, (VALUES (1), (2)) AS t(b) WHERE b = 1 OR account_id % 2 = 0"
)
def write_recon_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of two batches, the second of which is run again and then has even accounts alone."""
    path = f"{new_folder(spark, 'diffs')}/table"
    diffs = lp.the_diffs(spark, sf_dir)
    for batch, rows in ((1, diffs), (2, diffs), (2, diffs.where("account_id % 2 = 0"))):
        tables.write_recon_diffs(rows, path, batch)
    return versions.read(spark, path).select(F.col("recon_batch_id").cast("long"), "account_id", "asset", money("expected_value").alias("expected_value"), money("actual_value").alias("actual_value"))


@query(lp.ORACLES["recon_compare"])
def recon_by_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's side is made of the postings before a date and then of the rest; only buckets that differ are joined."""
    led_, folder = lp.the_ledger(spark, sf_dir), new_folder(spark, "recon")
    early = F.col("created_at") < F.lit(CUTS[1]).cast("timestamp")
    for piece in (led_.where(early), led_.where(~early | early.isNull())):
        recon_tree.add(piece, "amount", f"{folder}/truth", "truth", 256)
    recon_tree.add(recon.totals(lp.the_balances(led_)), "total", f"{folder}/snapshot", "snapshot", 256)
    found = recon_tree.compare(spark, f"{folder}/truth", f"{folder}/snapshot")
    return found.select("account_id", "asset", "item_type", *[money(c).alias(c) for c in ("expected_value", "actual_value", "diff_value")], "severity")
