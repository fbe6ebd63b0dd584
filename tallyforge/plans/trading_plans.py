"""Registered queries on orders, trades, risk patterns, matching and event parsing, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import rules
from tallyforge.operators import balances as bal
from tallyforge.operators import matching, metrics, orders, risk
from tallyforge.operators.storage import stored
from tallyforge.plans.ledger_plans import HELD, WITH, money, text, the_sums
from tallyforge.plans import matching_sql
from tallyforge.plans.sql import VALUE, out
from tallyforge.sources import events
from tallyforge.sources.views import ACTIVITY, EXECUTIONS, ORDER_COMMANDS, ORDER_UPDATES, TRADING_ORDERS, oracle, table, view

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


X, C, U, A, T = (f"({oracle(v)})" for v in (EXECUTIONS, ORDER_COMMANDS, ORDER_UPDATES, ACTIVITY, TRADING_ORDERS))
TIE = ["event_time", "k1", "k2", "filled_quantity", "k3", "k4", "k5", "new_status"]
EVENT = "trade_id || ':' || symbol"
TRADE_ORDER = ["executed_at", "k1", "k2", "quantity", "price", "k3", "k4", "k5"]
TRADES = f"""x AS (SELECT *, {EVENT} AS event_id FROM {X}),
e AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY {", ".join(TRADE_ORDER)}) = 1),
trades AS (SELECT *, account_id AS user_id, {VALUE} AS exec_value, executed_at AS exec_time FROM e QUALIFY row_number() OVER (PARTITION BY trade_id, account_id ORDER BY {", ".join(TRADE_ORDER)}) = 1)"""


def the_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = view(spark, sf_dir, EXECUTIONS).withColumn("event_id", F.concat_ws(":", "trade_id", "symbol"))
    return orders.project_trades(x, TRADE_ORDER)


@query(
    f"SELECT order_id, account_id, client_order_id, symbol, new_status AS status, event_seq, {out('filled_quantity')} AS filled_quantity, "
    f"CAST(event_time AS STRING) AS event_time FROM {U} QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY event_seq DESC, {', '.join(TIE)}) = 1"
)
def project_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = orders.project_orders(view(spark, sf_dir, ORDER_UPDATES), TIE)
    return last.select("order_id", "account_id", "client_order_id", "symbol", F.col("new_status").alias("status"), "event_seq",
        money("filled_quantity").alias("filled_quantity"), text("event_time").alias("event_time"))


@query(
    f"SELECT order_id, new_status AS status, event_seq FROM {U} WHERE event_seq > order_id % 4 QUALIFY row_number() OVER (PARTITION BY order_id "
    f"ORDER BY event_seq DESC, {', '.join(TIE)}) = 1"
)
def project_orders_onto_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = view(spark, sf_dir, ORDER_UPDATES)
    stored = updates.select("order_id", (F.col("order_id") % 4).alias("last_event_seq")).distinct()
    return orders.project_orders(updates, TIE, stored).select("order_id", F.col("new_status").alias("status"), "event_seq")


@query(
    f"WITH {TRADES} SELECT event_id, trade_id, order_id, user_id, symbol, "
    f"side, {out('quantity')} AS exec_quantity, {out('price')} AS exec_price, {out('exec_value')} AS exec_value, 0.0::DOUBLE AS fee_amount, CASE "
    f"WHEN symbol LIKE '%USDT' THEN 'USDT' WHEN symbol LIKE '%KRW' THEN 'KRW' WHEN symbol LIKE '%BTC' THEN 'BTC' "
    f"WHEN symbol LIKE '%ETH' THEN 'ETH' ELSE symbol END AS fee_currency, liquidity AS liquidity_flag, CAST(exec_time AS STRING) AS exec_time FROM trades"
)
def project_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return the_trades(spark, sf_dir).withColumns({c: money(c) for c in ("exec_quantity", "exec_price", "exec_value", "fee_amount")}).withColumn("exec_time", text("exec_time"))


@query(
    f"WITH u AS (SELECT *, CASE WHEN event_seq % 2 = 0 THEN client_order_id ELSE 'other' END AS cid FROM {U}) SELECT u.order_id, u.event_seq, u.account_id, "
    f"u.cid AS client_order_id, u.new_status, coalesce(a.order_id, b.order_id) AS matched_order_id FROM u LEFT JOIN {T} a ON a.user_id = u.account_id "
    f"AND a.client_order_id = u.cid LEFT JOIN {T} b ON b.user_id = u.account_id AND b.order_id = u.order_id AND u.order_id % 3 = 0"
)
def attach_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of which every other has lost its client id; two thirds of the order ids are of other users. A match by client id shows
    the hidden, negative id as it is stored."""
    u = view(spark, sf_dir, ORDER_UPDATES).withColumn("client_order_id", F.when(F.col("event_seq") % 2 == 0, F.col("client_order_id")).otherwise("other"))
    stored = view(spark, sf_dir, TRADING_ORDERS)
    hidden = stored.withColumn("order_id", F.when(F.col("order_id") % 3 == 0, F.col("order_id")).otherwise(-F.col("order_id")))
    return orders.attach_order(u, hidden).select("order_id", "event_seq", "account_id", "client_order_id", "new_status", F.abs("matched_order_id").alias("matched_order_id"))


@query(
    f"SELECT order_id, user_id, symbol, status, CAST(created_at AS STRING) AS created_at FROM {T} WHERE symbol = 'BTCUSDT' AND status = 'NEW' "
    f"AND created_at >= TIMESTAMP '1996-01-01' AND created_at <= TIMESTAMP '1999-12-31' ORDER BY created_at DESC, order_id DESC LIMIT 20 OFFSET 20"
)
def search_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = orders.search_orders(view(spark, sf_dir, TRADING_ORDERS), symbol="BTCUSDT", status="NEW", start="1996-01-01", end="1999-12-31")
    return orders.page(found, [F.desc("created_at"), F.desc("order_id")], 20, 1).select("order_id", "user_id", "symbol", "status", text("created_at").alias("created_at"))


@query(
    f"SELECT order_id, user_id, CAST(created_at AS STRING) AS created_at FROM {T} WHERE created_at < TIMESTAMP '1998-01-01' "
    f"OR (created_at = TIMESTAMP '1998-01-01' AND order_id < 5000) ORDER BY {T[:0]}created_at DESC, order_id DESC LIMIT 30"
)
def orders_page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders.page_after(view(spark, sf_dir, TRADING_ORDERS), "created_at", "order_id", ("1998-01-01", 5000), 30).select("order_id", "user_id", text("created_at").alias("created_at"))


@query(f"SELECT order_id, user_id, symbol, status FROM {T} WHERE status = 'NEW'")
def pending_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all users."""
    return orders.pending_orders(view(spark, sf_dir, TRADING_ORDERS)).select("order_id", "user_id", "symbol", "status")


QUERIES["pending_orders_all"], ORACLES["pending_orders_all"] = pending_orders, ORACLES["pending_orders"]  # its name of old


@query(
    f"SELECT order_id, symbol, CAST(created_at AS STRING) AS created_at, (SELECT count(*) FROM {T} WHERE symbol = 'ETHUSDT') AS total_count, "
    f"(SELECT CAST(ceil(count(*) / 20.0) AS BIGINT) FROM {T} WHERE symbol = 'ETHUSDT') AS total_pages FROM {T} WHERE symbol = 'ETHUSDT' "
    f"ORDER BY created_at DESC, order_id DESC LIMIT 20 OFFSET 40"
)
def orders_page_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = orders.search_orders(view(spark, sf_dir, TRADING_ORDERS), symbol="ETHUSDT")
    return orders.page_with_total(found, [F.desc("created_at"), F.desc("order_id")], 20, 2).select("order_id", "symbol", text("created_at").alias("created_at"), "total_count", "total_pages")


@query(f"WITH {TRADES} SELECT event_id, trade_id, order_id, user_id FROM trades WHERE user_id = 37")
def trades_of_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders.trades_by(the_trades(spark, sf_dir), user_id=37).select("event_id", "trade_id", "order_id", "user_id")


@query(f"WITH {TRADES} SELECT event_id, trade_id, order_id, user_id FROM trades WHERE order_id = (SELECT max(order_id) FROM trades)")
def trades_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = the_trades(spark, sf_dir)
    return orders.trades_by(trades, order_id=trades.agg(F.max("order_id")).first()[0]).select("event_id", "trade_id", "order_id", "user_id")


@query(
    f"WITH {TRADES} SELECT trade_id, user_id, symbol, liquidity AS liquidity_flag, CAST(exec_time AS STRING) AS exec_time FROM trades "
    f"WHERE symbol = 'ETHUSDT' AND liquidity = 'MAKER' AND exec_time >= TIMESTAMP '1997-01-01' AND exec_time <= TIMESTAMP '1998-12-31' "
    f"ORDER BY exec_time DESC, trade_id DESC LIMIT 20"
)
def trades_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = orders.trades_by(the_trades(spark, sf_dir), symbol="ETHUSDT", start="1997-01-01", end="1998-12-31", liquidity="MAKER")
    return orders.page(found, [F.desc("exec_time"), F.desc("trade_id")]).select("trade_id", "user_id", "symbol", "liquidity_flag", text("exec_time").alias("exec_time"))


@query(f"SELECT user_id, symbol, count(*) AS n_pending FROM {T} WHERE status = 'NEW' GROUP BY 1, 2")
def pending_count_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders.pending_count_by_symbol(view(spark, sf_dir, TRADING_ORDERS))


@query(f"WITH {TRADES} SELECT order_id, {out('sum(quantity)')} AS exec_quantity FROM trades GROUP BY 1")
def exec_qty_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders.exec_qty_by_order(the_trades(spark, sf_dir)).withColumn("exec_quantity", money("exec_quantity"))


@query(
    f"WITH {TRADES}, s AS (SELECT order_id, sum(quantity) AS filled, sum(quantity * price) AS val FROM trades GROUP BY 1) SELECT t.order_id, "
    f"CAST(val AS DOUBLE) / CAST(filled AS DOUBLE) AS avg_price, {out('coalesce(filled, 0)')} AS filled, {out('greatest(t.quantity - coalesce(filled, 0), 0)')} AS remaining, "
    f"CASE WHEN coalesce(filled, 0) = 0 THEN 'NEW' WHEN filled < t.quantity THEN 'PARTIALLY_FILLED' ELSE 'FILLED' END AS status FROM {T} t LEFT "
    f"JOIN s ON s.order_id = t.order_id"
)
def order_state_from_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills = the_trades(spark, sf_dir).select("order_id", F.col("exec_quantity").alias("quantity"), F.col("exec_price").alias("price"))
    found = orders.order_state_from_fills(fills, view(spark, sf_dir, TRADING_ORDERS))
    return found.select("order_id", money("filled").alias("filled"), money("remaining").alias("remaining"), "status", "avg_price")


LIMITS = "(VALUES ('BTCUSDT', 0.01, 0.00001, 0.001, 1000, 10), ('ETHUSDT', 0.01, 0.0001, 0.01, 10000, 10)) AS l(symbol, tick, step, low, high, notional)"


@query(f"""SELECT seq, c.symbol, {out("p")} AS price, {out("q")} AS quantity, CASE WHEN p <= 0 THEN 'INVALID_PRICE' WHEN q <= 0 THEN 'INVALID_QUANTITY' WHEN l.symbol IS NULL THEN 'UNKNOWN_SYMBOL' WHEN p % tick <> 0 THEN 'INVALID_TICK' WHEN q % step <> 0 THEN 'INVALID_STEP' WHEN q < low OR q > high THEN 'QUANTITY_OUT_OF_RANGE' WHEN p * q < notional THEN 'NOTIONAL_TOO_SMALL' END AS reject
FROM (SELECT seq, symbol, CAST(CAST(price AS DECIMAL(18, 4)) - 110 + CASE WHEN seq % 11 = 0 THEN 0.001 ELSE 0 END AS DECIMAL(18, 4)) AS p, CAST(CAST(quantity AS DECIMAL(18, 6)) - 2 + CASE WHEN seq % 13 = 0 THEN 0.000001 ELSE 0 END AS DECIMAL(18, 6)) AS q FROM {C} WHERE command_type = 'NEW') c LEFT JOIN {LIMITS} ON l.symbol = c.symbol""")
def validate_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices and quantities are lowered, and some are off the tick or the step, so that each rule meets orders."""
    price = F.col("price") - 110 + F.when(F.col("seq") % 11 == 0, F.lit("0.001").cast("decimal(4,3)")).otherwise(0)
    quantity = F.col("quantity") - 2 + F.when(F.col("seq") % 13 == 0, F.lit("0.000001").cast("decimal(7,6)")).otherwise(0)
    new = view(spark, sf_dir, ORDER_COMMANDS).where(F.col("command_type") == "NEW").withColumns({"price": price.cast("decimal(20,8)"), "quantity": quantity.cast("decimal(20,8)")})
    return rules.validate_orders(new).select("seq", "symbol", money("price").alias("price"), money("quantity").alias("quantity"), "reject")


@query(f"SELECT client_order_id, regexp_full_match(client_order_id, '[A-Za-z0-9_-]{{5,64}}') AS valid FROM {T}")
def validate_client_order_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, TRADING_ORDERS).select("client_order_id", rules.valid_client_order_id(F.col("client_order_id")).alias("valid"))


DAY = "CAST(date_trunc('day', ts) AS TIMESTAMP)"


@query(
    f"SELECT account_id, 'ORDER_FLOOD' AS pattern_type, count(*) AS n, CAST({DAY} + INTERVAL 1 DAY AS STRING) AS detected_at FROM {A} "
    f"WHERE command_type = 'NEW' GROUP BY account_id, {DAY} HAVING count(*) > 1"
)
def order_flood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test events are sparse: more than 1 in a day."""
    return risk.order_flood(view(spark, sf_dir, ACTIVITY), 1, length="1 day").select("account_id", "pattern_type", "n", text("detected_at").alias("detected_at"))


@query(
    f"SELECT account_id, symbol, count(*) AS n, CAST({DAY} + INTERVAL 1 DAY AS STRING) AS detected_at FROM {A} WHERE command_type = 'NEW' "
    f"GROUP BY account_id, symbol, {DAY} HAVING count(*) > 1"
)
def order_flood_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.order_flood(view(spark, sf_dir, ACTIVITY), 1, True, "1 day").select("account_id", "symbol", "n", text("detected_at").alias("detected_at"))


@query(
    f"SELECT account_id, symbol, count(*) AS n, CAST({DAY} + INTERVAL 1 DAY AS STRING) AS detected_at FROM {A} WHERE command_type = 'CANCEL' "
    f"GROUP BY account_id, symbol, {DAY} HAVING count(*) > 0"
)
def cancel_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.cancel_repeat(view(spark, sf_dir, ACTIVITY), 0, "1 day").select("account_id", "symbol", "n", text("detected_at").alias("detected_at"))


FLOODS = (
    f"log AS (SELECT account_id, NULL AS symbol, {DAY} + INTERVAL 1 DAY AS seen_at FROM {A} WHERE command_type = 'NEW' GROUP BY account_id, {DAY} "
    f"HAVING count(*) > 1 UNION ALL SELECT account_id, symbol, {DAY} + INTERVAL 1 DAY FROM {A} WHERE command_type = 'NEW' GROUP BY account_id, "
    f"symbol, {DAY} HAVING count(*) > 1)"
)


@query(
    f"WITH {FLOODS} SELECT account_id, symbol, CAST(seen_at AS STRING) AS detected_at, n_recent, CASE WHEN symbol IS NULL "
    f"AND n_recent >= 3 THEN 'Account blocked' END AS action FROM (SELECT *, count(*) OVER (PARTITION BY account_id "
    f"ORDER BY seen_at RANGE BETWEEN INTERVAL 5 DAY PRECEDING AND CURRENT ROW) AS n_recent FROM log)"
)
def flood_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = view(spark, sf_dir, ACTIVITY)
    log = risk.order_flood(a, 1, length="1 day").unionByName(risk.order_flood(a, 1, True, "1 day"))
    return risk.flood_escalation(log, 3, 5 * 86400).select("account_id", "symbol", text("detected_at").alias("detected_at"), "n_recent", "action")


@query(f"WITH {FLOODS} SELECT account_id, 'ORDER_FLOOD' AS pattern_type, count(*) AS n FROM log GROUP BY 1")
def pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = view(spark, sf_dir, ACTIVITY)
    return risk.pattern_counts(risk.order_flood(a, 1, length="1 day").unionByName(risk.order_flood(a, 1, True, "1 day")))


@query(
    f"WITH {FLOODS} SELECT account_id, symbol, 'ORDER_FLOOD' AS pattern_type, count(*) AS n FROM log WHERE seen_at >= (SELECT max(seen_at) "
    f"FROM log) - INTERVAL 10 DAY GROUP BY 1, 2"
)
def pattern_counts_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the ten days before the last flood."""
    a = view(spark, sf_dir, ACTIVITY)
    log = risk.order_flood(a, 1, length="1 day").unionByName(risk.order_flood(a, 1, True, "1 day"))
    since = log.agg((F.max(F.col("detected_at").cast("timestamp")) - F.expr("INTERVAL 10 DAY")).cast("string")).first()[0]
    return risk.pattern_counts(log, since or "1970-01-01", True)


@query(f"WITH {FLOODS} SELECT account_id, symbol, CAST(seen_at AS STRING) AS detected_at FROM log WHERE symbol IS NOT NULL AND account_id % 2 = 0")
def anomaly_log_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = view(spark, sf_dir, ACTIVITY)
    log = risk.order_flood(a, 1, length="1 day").unionByName(risk.order_flood(a, 1, True, "1 day")).withColumn("action_taken", F.col("symbol").isNull() | (F.col("account_id") % 2 != 0))
    return risk.anomaly_log_by(log, pattern="ORDER_FLOOD", unactioned=True).select("account_id", "symbol", text("detected_at").alias("detected_at"))


@query(
    f"SELECT event_id, symbol, {out('quantity')} AS quantity, n_before FROM (SELECT *, coalesce(sum(quantity) OVER w, 0) AS s, "
    f"count(quantity) OVER w AS n_before FROM {A} WHERE command_type = 'NEW' WINDOW w AS (PARTITION BY symbol ORDER BY ts, "
    f"event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE n_before > 0 AND quantity * n_before > s * 3"
)
def large_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = view(spark, sf_dir, ACTIVITY).where(F.col("command_type") == "NEW")
    return risk.large_order(new, 3).select("event_id", "symbol", money("quantity").alias("quantity"), "n_before")


@query(
    f"{WITH}{HELD}, blocked AS (SELECT account_id FROM held GROUP BY 1 HAVING min(amount) < 0) SELECT client_order_id, CASE "
    f"WHEN b.account_id IS NOT NULL THEN 'ACCOUNT_BLOCKED' WHEN symbol = 'BTCKRW' THEN 'SYMBOL_HALTED' END AS reject FROM {C} c LEFT "
    f"JOIN blocked b ON b.account_id = c.user_id WHERE command_type = 'NEW'"
)
def block_precheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = bal.risk_state(bal.project_balances(the_sums(spark, sf_dir)))
    halted = spark.createDataFrame([("BTCKRW",)], "symbol string")
    return risk.block_precheck(view(spark, sf_dir, ORDER_COMMANDS), state, halted).select("client_order_id", "reject")


@query(f"SELECT account_id, CAST({DAY} AS STRING) AS start, count(*) AS n FROM {A} GROUP BY account_id, {DAY} HAVING count(*) > 2")
def tumbling_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.tumbling_limit(view(spark, sf_dir, ACTIVITY), 2, "1 day").select("account_id", text("start").alias("start"), "n")


ANCHORED = f"""
WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY ts, event_id) AS k FROM {A}),
w AS (
  SELECT account_id, event_id, k, ts, ts AS start, 1 AS n FROM a WHERE k = 1
  UNION ALL
  SELECT a.account_id, a.event_id, a.k, a.ts, CASE WHEN a.ts >= w.start + INTERVAL 7 DAY THEN a.ts ELSE w.start END, CASE WHEN a.ts >= w.start + INTERVAL 7 DAY THEN 1 ELSE w.n + 1 END
  FROM w JOIN a ON a.account_id = w.account_id AND a.k = w.k + 1
) SELECT event_id, account_id, CAST(start AS STRING) AS window_start, CAST(n AS BIGINT) AS n_in_window, n > 3 AS over FROM w"""


@query(ANCHORED)
def anchored_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a week from the first order, above 3."""
    return risk.anchored_limit(view(spark, sf_dir, ACTIVITY), 3, 7 * 86400).select("event_id", "account_id", text("window_start").alias("window_start"), "n_in_window", "over")


N = "CAST(quantity AS DECIMAL(18, 2)) * 7"


@query(f"""WITH a AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY account_id ORDER BY ts, event_id) + INTERVAL 24 HOUR THEN 1 ELSE 0 END AS cut FROM {A}),
s AS (SELECT *, sum(cut) OVER (PARTITION BY account_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM a)
SELECT account_id, CAST(min(ts) AS STRING) AS start, {out(f'sum({N})')} AS volume, sum({N}) > 500 AS over FROM s GROUP BY account_id, session""")
def volume_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = view(spark, sf_dir, ACTIVITY).withColumn("notional", (F.col("quantity").cast("decimal(18,2)") * 7).cast("decimal(20,8)"))
    return risk.volume_sessions(a, 500).select("account_id", text("start").alias("start"), money("volume").alias("volume"), "over")


VOLUME = f"""
WITH RECURSIVE a AS (SELECT *, {N} AS x, row_number() OVER (PARTITION BY account_id ORDER BY ts, event_id) AS k FROM {A}),
w AS (
  SELECT account_id, event_id, k, CASE WHEN x <= 500 THEN x ELSE 0 END AS total, CASE WHEN x <= 500 THEN ts + INTERVAL 1 DAY END AS upto, CASE WHEN x > 500 THEN ts + INTERVAL 1 DAY END AS blocked, x <= 500 AS accepted FROM a WHERE k = 1
  UNION ALL
  SELECT account_id, event_id, k, CASE WHEN ok THEN base + x ELSE total END, CASE WHEN ok THEN ts + INTERVAL 1 DAY ELSE upto END, CASE WHEN NOT held AND NOT ok THEN ts + INTERVAL 1 DAY ELSE blocked END, ok
  FROM (SELECT *, NOT held AND base + x <= 500 AS ok FROM (
    SELECT a.account_id, a.event_id, a.k, a.ts, a.x, w.total, w.upto, w.blocked, coalesce(a.ts < w.blocked, false) AS held, CASE WHEN w.upto IS NULL OR a.ts >= w.upto THEN 0 ELSE w.total END AS base
    FROM w JOIN a ON a.account_id = w.account_id AND a.k = w.k + 1))
) SELECT event_id, account_id, accepted FROM w"""


@query(VOLUME)
def volume_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential per user, with a block after a refusal."""
    a = view(spark, sf_dir, ACTIVITY).withColumn("notional", (F.col("quantity").cast("decimal(18,2)") * 7).cast("decimal(20,8)"))
    return risk.volume_limit(a, 500).select("event_id", "account_id", "accepted")


def the_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_orders(view(spark, sf_dir, ORDER_COMMANDS))


@query(matching_sql.MATCH)
def match_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return the_replay(spark, sf_dir).withColumn("at", text("at"))


@query(matching_sql.STATES)
def order_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.order_state(the_replay(spark, sf_dir))


@query(
    f"SELECT count(DISTINCT symbol || client_order_id) AS n_orders, count(DISTINCT symbol) AS n_symbols, CAST(0 AS BIGINT) AS crossed, "
    f"CAST(0 AS BIGINT) AS unbalanced FROM {C} WHERE command_type = 'NEW'"
)
def match_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is met once, no book is crossed after the replay, and orders' filled quantities are twice the fills' in each symbol."""
    events_ = stored(the_replay(spark, sf_dir), "events")
    states = matching.order_state(events_)
    best = matching.best_prices(matching.book_depth(states)).agg(F.count_if(F.col("best_bid") >= F.col("best_ask")).alias("crossed"))
    filled = states.groupBy("symbol").agg(F.sum("filled").alias("f"),
        F.count("*").alias("n")).join(events_.where(F.col("kind") == "FILL").groupBy("symbol").agg(F.sum("quantity").alias("q")), "symbol", "left")
    sums = filled.agg(F.sum("n").alias("n_orders"), F.count("*").alias("n_symbols"), F.count_if(F.col("f") != 2 * F.coalesce("q", F.lit(0))).alias("unbalanced"))
    return sums.withColumn("one", F.lit(1)).join(best.withColumn("one", F.lit(1)), "one").drop("one")


@query(matching_sql.DEPTH)
def book_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.book_depth(matching.order_state(the_replay(spark, sf_dir)))


@query(matching_sql.NESTED)
def nested_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth = matching.book_depth(matching.order_state(the_replay(spark, sf_dir)))
    return matching.nested_book(depth).select("symbol", F.to_json("bids").alias("bids"), F.to_json("asks").alias("asks"))


@query(matching_sql.EXECUTION_MESSAGES)
def emit_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.execution_messages(matching.emit_executions(the_replay(spark, sf_dir)))


@query(matching_sql.UPDATE_MESSAGES)
def emit_order_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.update_messages(the_replay(spark, sf_dir))


@query(
    f"SELECT symbol, user_id AS account_id, client_order_id, 'REJECTED' AS status, 0 AS remaining, CASE "
    f"WHEN user_id % 10 = 0 THEN 'ACCOUNT_BLOCKED' ELSE 'SYMBOL_HALTED' END AS reason FROM {C} WHERE command_type = 'NEW' AND (user_id % 10 = 0 "
    f"OR symbol = 'BTCKRW')"
)
def match_with_precheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The updates of refused orders: every tenth account is blocked and one symbol halted."""
    c = view(spark, sf_dir, ORDER_COMMANDS)
    blocked = c.where("user_id % 10 = 0").select(F.col("user_id").alias("account_id"), F.lit("BLOCKED").alias("status")).distinct()
    checked = risk.block_precheck(c, blocked, spark.createDataFrame([("BTCKRW",)], "symbol string"))
    found = matching.match_orders(checked.unionByName(c.where("command_type <> 'NEW'").withColumn("reject", F.lit(None).cast("string"))))
    return found.where("event_type = 'REJECTED'").select("symbol", "account_id", "client_order_id", "status", "remaining", "reason")


@query(
    f"SELECT user_id, client_order_id, symbol, side, time_in_force, {out('price')} AS price, {out('quantity')} AS quantity, 'TEST' AS source, "
    f"CAST(received_at AS STRING) AS received_at, CASE WHEN seq % 10 = 0 THEN 'quantity' END AS reject FROM (SELECT * REPLACE (CASE "
    f"WHEN seq % 10 = 0 THEN NULL ELSE quantity END AS quantity) FROM {C} WHERE command_type = 'NEW')"
)
def read_order_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, ORDER_COMMANDS).where(F.col("command_type") == "NEW")
    value = F.to_json(F.struct(F.col("command_type").alias("commandType"), F.col("user_id").alias("userId"),
        F.col("client_order_id").alias("clientOrderId"), "symbol", "side", F.col("order_type").alias("orderType"),
        F.col("time_in_force").alias("timeInForce"), "price", F.when(F.col("seq") % 10 != 0, F.col("quantity")).alias("quantity"),
        F.lit("TEST").alias("source"), F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("receivedAt")))
    p = events.parse_order_commands(c.select(value.alias("value")))
    return p.select("user_id", "client_order_id", "symbol", "side", "time_in_force", money("price").alias("price"),
        money("quantity").alias("quantity"), "source", text("received_at").alias("received_at"), "reject")


@query(
    f"SELECT order_id, account_id, symbol, new_status, event_seq, {out('filled_quantity')} AS filled_quantity, CAST(event_time AS STRING) AS event_time, "
    f"CAST(NULL AS STRING) AS reject FROM {U}"
)
def read_order_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other update in an envelope."""
    u = view(spark, sf_dir, ORDER_UPDATES)
    body = F.struct(F.col("order_id").alias("orderId"), F.col("account_id").alias("accountId"), "symbol", "side",
        F.col("new_status").alias("newStatus"), F.col("event_seq").alias("eventSeq"), F.col("filled_quantity").alias("filledQuantity"),
        F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'+09:00'").alias("eventTime"))
    value = F.when(F.col("event_seq") % 2 == 0, F.to_json(F.struct(body.alias("body")))).otherwise(F.to_json(body))
    p = events.parse_order_updates(u.select(value.alias("value")))
    return p.select("order_id", "account_id", "symbol", "new_status", "event_seq", money("filled_quantity").alias("filled_quantity"), text("event_time").alias("event_time"), "reject")


BAD = "CASE WHEN k1 % 50 = 0 THEN 0 ELSE quantity END"


@query(
    f"SELECT trade_id, account_id, symbol, side, {out(BAD)} AS quantity, {out('price')} AS price, {out('CASE WHEN k1 % 2 = 0 THEN 0 ELSE fee END')} AS fee, "
    f"CAST(executed_at AS STRING) AS executed_at, CASE WHEN k1 % 50 = 0 THEN 'quantity' END AS reject FROM {X}"
)
def read_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even parts in the worker's envelope, which has no fee, odd ones flat; every fiftieth with quantity 0."""
    x = view(spark, sf_dir, EXECUTIONS).withColumn("quantity", F.when(F.col("k1") % 50 == 0, 0).otherwise(F.col("quantity")).cast("decimal(20,8)"))
    at = F.date_format("executed_at", "yyyy-MM-dd'T'HH:mm:ss")
    body = F.struct(F.col("trade_id").alias("tradeId"), F.col("account_id").alias("userId"), "symbol", "side",
        F.col("quantity").alias("execQuantity"), F.col("price").alias("execPrice"), F.col("liquidity").alias("liquidityFlag"), at.alias("execTime"))
    flat = F.struct("trade_id", "account_id", "symbol", F.lower("side").alias("side"), "quantity", "price", "fee", at.alias("executed_at"))
    value = F.when(F.col("k1") % 2 == 0, F.to_json(F.struct(F.lit("trades.executed").alias("sourceTopic"), body.alias("body")))).otherwise(F.to_json(flat))
    p = events.parse_executions(x.select(value.alias("value")))
    return p.select("trade_id", "account_id", "symbol", "side", money("quantity").alias("quantity"), money("price").alias("price"),
        money("fee").alias("fee"), text("executed_at").alias("executed_at"), "reject")


@query(
    "SELECT event_id, greatest(0, event_id % 7 - 2) AS queue_ms, event_id % 5 AS engine_ms, event_id % 3 AS publish_ms, "
    "event_id % 5 + event_id % 3 AS total_ms, greatest(0, event_id % 7 - 2) + event_id % 5 + event_id % 3 AS end_to_end_ms FROM events"
)
def pipeline_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pipeline_latency(_times(spark, sf_dir)).select("event_id", "queue_ms", "engine_ms", "publish_ms", "total_ms", "end_to_end_ms")


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, received = F.col("event_id"), F.unix_millis(F.col("ts").cast("timestamp"))
    consumed = received + i % 7 - 2
    return table(spark, sf_dir, "events").select("event_id", "event_type", received.alias("received"), consumed.alias("consumed"),
        (consumed + i % 5).alias("matched"), (consumed + i % 5 + i % 3).alias("published"))


@query("""WITH v AS (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS x, row_number() OVER (PARTITION BY event_type ORDER BY round(value * 100)) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(n) AS n, min(x) AS min, max(x) FILTER (place = least(n - 1, CAST(floor(n * 0.5) AS BIGINT))) AS p50, max(x) FILTER (place = least(n - 1, CAST(floor(n * 0.95) AS BIGINT))) AS p95, max(x) AS max, round(sum(x) / max(n), 2) AS avg FROM v GROUP BY 1""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.round(F.col("value") * 100).cast("long").alias("x"))
    return metrics.latency_percentiles(e, "event_type", "x")


DAILY = f"""
WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY ts, event_id) AS k FROM {A} WHERE command_type = 'NEW'),
w AS (
  SELECT account_id, event_id, k, ts AS start, 1 AS n, CAST(NULL AS TIMESTAMP) AS blocked, true AS accepted FROM a WHERE k = 1
  UNION ALL
  SELECT account_id, event_id, k, CASE WHEN NOT held AND opens THEN ts ELSE start END, CASE WHEN held THEN n WHEN opens THEN 1 ELSE n + 1 END,
         CASE WHEN NOT held AND NOT opens AND n + 1 > 1 THEN CAST(ts + INTERVAL 24 HOUR AS TIMESTAMP) ELSE blocked END, NOT held AND (opens OR n + 1 <= 1)
  FROM (SELECT a.account_id, a.event_id, a.k, a.ts, w.start, w.n, w.blocked, coalesce(a.ts < w.blocked, false) AS held, a.ts >= w.start + INTERVAL 24 HOUR AS opens
    FROM w JOIN a ON a.account_id = w.account_id AND a.k = w.k + 1)
) SELECT event_id, account_id, CAST(start AS STRING) AS window_start, CAST(n AS BIGINT) AS n_in_window, accepted FROM w"""


@query(DAILY)
def daily_order_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily rule: windows of a day from the first order, refusals that block for 24 hours. The test events are sparse: above 1."""
    new = view(spark, sf_dir, ACTIVITY).where(F.col("command_type") == "NEW")
    return risk.daily_order_limit(new, 1).select("event_id", "account_id", text("window_start").alias("window_start"), "n_in_window", "accepted")


QUERIES["daily_order_block"], ORACLES["daily_order_block"] = daily_order_limit, ORACLES["daily_order_limit"]  # its name of old

CHAIN = f"""
WITH RECURSIVE a AS (SELECT *, {N} AS x, row_number() OVER (PARTITION BY account_id ORDER BY ts, event_id) AS k FROM {A} WHERE command_type = 'NEW'),
w AS (
  SELECT account_id, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS k, CAST(0 AS DECIMAL(38, 2)) AS total, CAST(NULL AS TIMESTAMP) AS upto, CAST(NULL AS TIMESTAMP) AS blocked, CAST(NULL AS TIMESTAMP) AS day_start, 0 AS n_day, CAST(NULL AS TIMESTAMP) AS minute_start, 0 AS n_minute, CAST(NULL AS VARCHAR) AS refused FROM a WHERE k = 1
  UNION ALL
  SELECT account_id, event_id, k, CASE WHEN why IN ('BLOCKED', 'VOLUME') THEN total ELSE base + x END, CASE WHEN why IN ('BLOCKED', 'VOLUME') THEN upto ELSE CAST(ts + INTERVAL 1 DAY AS TIMESTAMP) END, CASE WHEN why IN ('VOLUME', 'DAILY') THEN CAST(ts + INTERVAL 1 DAY AS TIMESTAMP) ELSE blocked END,
         CASE WHEN why IN ('BLOCKED', 'VOLUME') THEN day_start ELSE new_day END, CASE WHEN why IN ('BLOCKED', 'VOLUME') THEN n_day ELSE day_n END, CASE WHEN why IN ('BLOCKED', 'VOLUME', 'DAILY') THEN minute_start ELSE new_minute END, CASE WHEN why IN ('BLOCKED', 'VOLUME', 'DAILY') THEN n_minute ELSE minute_n END, why
  FROM (SELECT *, CASE WHEN coalesce(ts < blocked, false) THEN 'BLOCKED' WHEN base + x > 150 THEN 'VOLUME' WHEN day_n > 2 THEN 'DAILY' WHEN minute_n > 1 THEN 'RATE' END AS why FROM (
    SELECT a.account_id, a.event_id, a.k, a.ts, a.x, w.total, w.upto, w.blocked, w.day_start, w.n_day, w.minute_start, w.n_minute, CASE WHEN w.upto IS NULL OR a.ts >= w.upto THEN 0 ELSE w.total END AS base,
           CASE WHEN w.day_start IS NULL OR a.ts >= w.day_start + INTERVAL 1 DAY THEN a.ts ELSE w.day_start END AS new_day, CASE WHEN w.day_start IS NULL OR a.ts >= w.day_start + INTERVAL 1 DAY THEN 1 ELSE w.n_day + 1 END AS day_n,
           CASE WHEN w.minute_start IS NULL OR a.ts >= w.minute_start + INTERVAL 1 MINUTE THEN a.ts ELSE w.minute_start END AS new_minute, CASE WHEN w.minute_start IS NULL OR a.ts >= w.minute_start + INTERVAL 1 MINUTE THEN 1 ELSE w.n_minute + 1 END AS minute_n
    FROM w JOIN a ON a.account_id = w.account_id AND a.k = w.k + 1))
) SELECT event_id, account_id, refused FROM w WHERE k > 0"""


@query(CHAIN)
def validate_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of all order checks. The test events are sparse: above a volume of 150, 2 orders in a day, 1 in a minute."""
    a = view(spark, sf_dir, ACTIVITY).where("command_type = 'NEW'").withColumn("notional", (F.col("quantity").cast("decimal(18,2)") * 7).cast("decimal(20,8)"))
    return risk.validate_risk(a, 150, 2, 1).select("event_id", "account_id", "refused")
