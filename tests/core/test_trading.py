"""Golden cases of matching, projections, parsing and anomaly patterns, and streams that equal batches."""

import json
import random
from collections import defaultdict
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import matching, metrics, orders, risk, settlement
from tallyforge.plans.ledger_plans import ORDER
from tallyforge.plans.trading_plans import TIE, TRADE_ORDER
from tallyforge.sources import events, tables, versions
from tallyforge.sources.views import ACTIVITY, EXECUTIONS, ORDER_COMMANDS, ORDER_UPDATES, view
from tallyforge.streaming import jobs

D = Decimal
T0 = datetime(2026, 3, 11, 12)


def book_of(*commands):
    book, out = matching.Book(), []
    for c in commands:
        out += book.new(*c[1:]) if c[0] == "NEW" else book.cancel(*c[1:])
    return book, out


def fills(out):
    return [(e["quantity"], e["price"]) for e in out if e["kind"] == "FILL"]


def new(user, client, side, price, quantity, tif="GTC"):
    return ("NEW", user, client, side, price, quantity, tif)


def test_multi_level_cross():
    book, out = book_of(new(1, "a", "SELL", 50000, 2), new(2, "b", "SELL", 49500, 1), new(3, "c", "BUY", 51000, 3))
    assert fills(out) == [(1, 49500), (2, 50000)]
    assert book.orders[3]["status"] == "FILLED" and book.orders[3]["avg"] == (49500 + 2 * 50000) // 3


def test_fifo_in_a_level():
    book, out = book_of(new(1, "a", "SELL", 50000, 1), new(2, "b", "SELL", 50000, 1), new(3, "c", "BUY", 51000, 1))
    assert [e["maker_account_id"] for e in out if e["kind"] == "FILL"] == [1]
    assert book.orders[2]["status"] == "NEW"


def test_duplicate_new_is_ignored():
    _, out = book_of(new(1, "a", "BUY", 50000, 1), new(1, "a", "BUY", 50000, 1), new(2, "b", "SELL", 49000, 2))
    assert fills(out) == [(1, 50000)]


def test_cancels():
    book, out = book_of(new(1, "a", "SELL", 10, 5), new(2, "b", "BUY", 10, 2), ("CANCEL", 2, "ORDER_ID", "1"), ("CANCEL", 1, "ORDER_ID", "x"),
        ("CANCEL", 1, "CLIENT_ORDER_ID", "a"), ("CANCEL", 1, "CLIENT_ORDER_ID", "a"), new(3, "c", "BUY", 99, 1, "IOC"))
    assert [(e["order_id"], e["reason"]) for e in out if e.get("event_type") == "CANCELED"] == [(1, "USER_CANCEL"), (3, "TIME_IN_FORCE_EXPIRED")]
    assert (book.orders[1]["filled"], book.orders[1]["remaining"]) == (2, 0)


def test_market_orders_have_price_zero():
    _, out = book_of(new(1, "a", "SELL", 10, 1), new(2, "b", "BUY", 0, 1, "IOC"), new(3, "c", "BUY", 8, 1), new(4, "d", "SELL", 0, 1, "IOC"))
    assert fills(out) == [(1, 8)]


def test_update_order_and_sequence():
    _, out = book_of(new(1, "a", "SELL", 10, 2), new(2, "b", "BUY", 11, 3, "IOC"))
    assert [(e["kind"], e.get("order_id"), e.get("event_type"), e.get("event_seq")) for e in out] == [
        ("UPDATE", 1, "CREATED", 1), ("UPDATE", 2, "CREATED", 1), ("FILL", None, None, None), ("UPDATE", 2, "TRADE", 2), ("UPDATE", 1, "TRADE", 2), ("UPDATE", 2, "CANCELED", 3),
    ]


def slow_fills(commands):
    """All open orders are looked through at each step."""
    open_, seen, n, out = {}, set(), 0, []
    for kind, user, client, side, price, quantity, tif in commands:
        if kind == "CANCEL":
            for i in [i for i, o in open_.items() if o[0] == user and o[1] == client]:
                del open_[i]
            continue
        if (user, client) in seen:
            continue
        seen.add((user, client))
        n += 1
        left = quantity
        while left:
            other = [(o[3] if side == "BUY" else -o[3], i) for i, o in open_.items() if o[2] != side and (o[3] <= price if side == "BUY" else o[3] >= price)]
            if not other:
                break
            i = min(other)[1]
            q = min(left, open_[i][4])
            out.append((n, i, q, open_[i][3]))
            left -= q
            open_[i][4] -= q
            if not open_[i][4]:
                del open_[i]
        if left and tif == "GTC":
            open_[n] = [user, client, side, price, left]
    return out


def test_replay_equals_a_slow_book():
    rnd = random.Random(5)
    flow = [(rnd.choice(["NEW"] * 5 + ["CANCEL"]), rnd.randrange(5), f"c{rnd.randrange(150)}", rnd.choice(["BUY", "SELL"]), rnd.randrange(95, 106),
        rnd.randrange(1, 9), rnd.choice(["GTC", "GTC", "IOC"])) for _ in range(600)]
    book, out = matching.Book(), []
    for kind, user, client, *rest in flow:
        out += book.new(user, client, *rest) if kind == "NEW" else book.cancel(user, "CLIENT_ORDER_ID", client)
        book = matching.Book(book.state())  # a state that is stored and loaded goes on alike
    assert [(e["taker_order_id"], e["maker_order_id"], e["quantity"], e["price"]) for e in out if e["kind"] == "FILL"] == slow_fills(flow)


def test_slices_equal_the_whole(spark, sf):
    commands = view(spark, sf, ORDER_COMMANDS)
    key = ["symbol", "kind", "order_id", "event_seq", "match_id", "filled", "remaining", "status"]
    whole = sorted(map(str, matching.match_orders(commands).select(*key).collect()))
    cut = "received_at < '1997-01-01'"
    first = matching.match_slice(commands.where(cut), spark.createDataFrame([], "symbol string, state string"))
    states = first.where("kind = 'STATE'").select("symbol", F.col("reason").alias("state"))
    second = matching.match_slice(commands.where(f"not ({cut})"), states)
    assert sorted(map(str, first.union(second).where("kind <> 'STATE'").select(*key).collect())) == whole


def test_executions_of_fills_post_in_balance(spark, sf):
    out = matching.match_orders(view(spark, sf, ORDER_COMMANDS))
    e = matching.emit_executions(out)
    assert e.count() == 2 * out.where("kind = 'FILL'").count() == e.select("event_id").distinct().count() > 0
    sums = e.groupBy("symbol").agg(F.sum(F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))).alias("d")).collect()
    assert all(r.d == 0 for r in sums)
    parsed = events.parse_executions(matching.execution_messages(e))
    assert parsed.where("reject is null").count() == e.count()
    assert events.parse_order_updates(matching.update_messages(out)).where("reject is null").count() == out.where("kind = 'UPDATE'").count()


def test_parsing_rejects(spark):
    good = {"commandType": "NEW", "userId": 1, "clientOrderId": "abcde", "symbol": "S", "side": "BUY", "orderType": "LIMIT", "timeInForce": "LOC",
        "price": 1, "quantity": 2, "receivedAt": "2026-01-01T00:00:00Z"}
    cases = [(good, None), ({**good, "price": None}, "price"), ({**good, "orderType": "MARKET", "price": None}, None), ({**good,
        "clientOrderId": " "}, "clientOrderId"), ({**good, "commandType": "CANCEL"}, "cancelTarget.by"), ({**good, "commandType": "CANCEL",
        "cancelTarget": {"by": "ORDER_ID", "value": "7"}}, None), ({**good, "commandType": "CANCEL", "cancelTarget": {"by": "X", "value": "7"}},
        "cancelTarget.by")]
    texts = spark.createDataFrame([(json.dumps(c),) for c, _ in cases] + [("{nonsense",), (None,)], "value string")
    got = [r.reject for r in events.parse_order_commands(texts).collect()]
    assert got == [w for _, w in cases] + ["commandType", "commandType"]
    first = events.parse_order_commands(texts).first()
    assert (first.time_in_force, first.source) == ("IOC", "UNKNOWN")
    x = spark.createDataFrame([(json.dumps({"trade_id": "t", "account_id": 1, "symbol": "S", "side": "hold", "quantity": 1, "price": 1}),),
        (json.dumps({"body": {"tradeId": "t", "userId": 505, "symbol": "005930", "side": "BUY", "execQuantity": 1, "execPrice": 70000,
        "execTime": "2026-03-11T12:00:01+09:00"}}),)], "value string")
    rows = events.parse_executions(x).collect()
    assert rows[0].reject == "side" and rows[1].reject is None
    assert (rows[1].account_id, rows[1].fee, rows[1].executed_at) == (505, 0, datetime(2026, 3, 11, 12, 0, 1))
    valid, bad = events.split(events.parse_executions(x))
    assert valid.count() == bad.count() == 1


def test_projection_of_orders_and_trades(spark):
    u = spark.createDataFrame([(1, 2, "FILLED"), (1, 1, "NEW"), (2, 5, "NEW"), (2, None, "CANCELED")], "order_id long, event_seq long, new_status string")
    got = {r.order_id: r.new_status for r in orders.project_orders(u, ["new_status"]).collect()}
    assert got == {1: "FILLED", 2: "CANCELED"}
    stored = spark.createDataFrame([(1, 2), (2, 9)], "order_id long, last_event_seq long")
    assert {r.order_id: r.new_status for r in orders.project_orders(u, ["new_status"], stored).collect()} == {2: "CANCELED"}
    x = spark.createDataFrame([("e1", "t1", 505, 1), ("e1", "t1", 505, 2), ("e2", "t1", 505, 3), ("e3", "t1", 506, 4)],
        "event_id string, trade_id string, account_id long, n int").selectExpr("*", "1 AS order_id", "'BTCUSDT' AS symbol", "'BUY' AS side",
        "CAST(1 AS DECIMAL(20,8)) AS quantity", "CAST(2 AS DECIMAL(20,8)) AS price", "'TAKER' AS liquidity", "TIMESTAMP '2026-01-01' AS executed_at")
    assert {(r.event_id, r.user_id) for r in orders.project_trades(x, ["n"]).collect()} == {("e1", 505), ("e3", 506)}
    known = x.where("n = 1").select("event_id", "trade_id", "account_id")
    assert [r.event_id for r in orders.project_trades(x, ["n"], known).collect()] == ["e3"]


def test_attach_order(spark):
    stored = spark.createDataFrame([(1, 505, "client-505"), (2, 606, "z")], "order_id long, user_id long, client_order_id string")
    u = spark.createDataFrame([(9, 505, "client-505"), (1, 505, "other"), (2, 505, "other")], "order_id long, account_id long, client_order_id string")
    assert {r.order_id: r.matched_order_id for r in orders.attach_order(u, stored).collect()} == {9: 1, 1: 1, 2: None}


def test_outbox(spark):
    e = spark.createDataFrame([("k", "b"), ("k", "a"), ("j", "c")], "idempotency_key string, payload string")
    assert {(r.idempotency_key, r.payload) for r in settlement.append_outbox(e).collect()} == {("k", "a"), ("j", "c")}
    assert [r.idempotency_key for r in settlement.append_outbox(e, e.where("idempotency_key = 'k'")).collect()] == ["j"]


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_floods_are_strictly_above(spark):
    rows = [(1, "A", "NEW", at(i * 0.1), i) for i in range(101)] + [(2, "A", "NEW", at(i * 0.1), i) for i in range(100)] + [(3, "B", "CANCEL", at(i), i) for i in range(51)]
    c = spark.createDataFrame(rows, "account_id long, symbol string, command_type string, ts timestamp, event_id long")
    assert [(r.account_id, r.n) for r in risk.order_flood(c).collect()] == [(1, 101)]
    assert [(r.account_id, r.symbol) for r in risk.cancel_repeat(c).collect()] == [(3, "B")]
    log = spark.createDataFrame([(1, s, "ORDER_FLOOD", 101, at(m * 60)) for m, s in ((0, None), (10, "A"), (20, None), (90, None))],
        "account_id long, symbol string, pattern_type string, n long, detected_at timestamp")
    got = [(r.n_recent, r.action) for r in risk.flood_escalation(log).orderBy("detected_at").collect()]
    assert got == [(1, None), (2, None), (3, "Account blocked"), (1, None)]


def test_limits_equal_loops(spark):
    rnd = random.Random(3)
    rows = sorted((rnd.randrange(3), T0 + timedelta(hours=rnd.randrange(400)), i, D(rnd.randrange(1, 60))) for i in range(200))
    o = spark.createDataFrame(rows, "account_id long, ts timestamp, event_id long, notional decimal(20,8)")
    start, n, want = {}, {}, {}
    total, until, blocked, accept = defaultdict(int), {}, {}, {}
    for a, t, i, x in rows:
        if a not in start or t >= start[a] + timedelta(hours=5):
            start[a], n[a] = t, 0
        n[a] += 1
        want[i] = n[a] > 2
        if a in blocked and t < blocked[a]:
            accept[i] = False
            continue
        if a not in until or t >= until[a] + timedelta(days=1):
            total[a] = 0
        accept[i] = total[a] + x <= 150
        if accept[i]:
            total[a] += x
            until[a] = t
        else:
            blocked[a] = t + timedelta(days=1)
    assert {r.event_id: r.over for r in risk.anchored_limit(o, 2, 5 * 3600).collect()} == want
    assert {r.event_id: r.accepted for r in risk.volume_limit(o, 150).collect()} == accept


def test_percentiles(spark):
    xs = [5, 1, 4, 4, 9, 7, 7, 2, 3, 30]
    r = metrics.latency_percentiles(spark.createDataFrame([("m", x) for x in xs], "g string, x long"), "g", "x").first()
    s = sorted(xs)
    assert (r.n, r.min, r.p50, r.p95, r.max, r.avg) == (10, 1, s[5], s[9], 30, 7.2)


def test_precheck_and_pages(spark):
    c = spark.createDataFrame([("NEW", 1, "A", "x"), ("NEW", 2, "B", "y"), ("NEW", 2, "A", "z"), ("CANCEL", 1, "A", "x")], "command_type string, user_id long, symbol string, client_order_id string")
    state = spark.createDataFrame([(1, "BLOCKED"), (2, "NORMAL")], "account_id long, status string")
    halted = spark.createDataFrame([("B",)], "symbol string")
    assert {r.client_order_id: r.reject for r in risk.block_precheck(c, state, halted).collect()} == {"x": "ACCOUNT_BLOCKED", "y": "SYMBOL_HALTED", "z": None}
    rows = spark.range(45).withColumn("t", F.timestamp_seconds(F.col("id")))
    pages = [[r.id for r in orders.page(rows, [F.desc("t"), F.desc("id")], 20, k).collect()] for k in range(3)]
    assert sum(pages, []) == list(range(44, -1, -1))
    assert [r.id for r in orders.page_after(rows, "t", "id", ("1970-01-01 00:00:25", 25)).collect()] == pages[1]


# --- streams ------------------------------------------------------------------------------------------------------


@pytest.fixture
def pieces(spark, sf, tmp_path):
    """A function that lays a view down as files and reads them as a stream, a file at a time."""

    def lay(sql, time):
        df = view(spark, sf, sql)
        path = str(tmp_path / f"in{abs(hash(sql))}")
        for low, high in (("1900-01-01", "1997-01-01"), ("1997-01-01", "1999-06-01"), ("1999-06-01", "2999-01-01")):
            df.where((F.col(time) >= low) & (F.col(time) < high)).coalesce(1).write.mode("append").parquet(path)
        return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)

    return lay


def test_stream_of_executions_equals_batch(spark, pieces, tmp_path):
    from tallyforge.operators import ledger

    df, stream = pieces(EXECUTIONS, "executed_at")
    out = str(tmp_path / "ledger")
    jobs.start(stream, jobs.post_ledger(out, ORDER), str(tmp_path / "c1")).awaitTermination()
    got = spark.read.parquet(out)
    keys = {r.idempotency_key for r in ledger.post_ledger(df, ORDER).select("idempotency_key").collect()}
    rows = [(r.id, r.idempotency_key) for r in got.select("id", "idempotency_key").collect()]
    assert {k for _, k in rows} == keys and len(rows) == len(keys) and sorted(i for i, _ in rows) == list(range(1, len(rows) + 1))


def test_stream_projections_equal_batch(spark, pieces, tmp_path):
    df, stream = pieces(ORDER_UPDATES, "event_time")
    out = str(tmp_path / "orders")
    jobs.start(stream, jobs.project_orders(out, TIE), str(tmp_path / "c2")).awaitTermination()
    want = {r.order_id: r.event_seq for r in orders.project_orders(df, TIE).collect()}
    assert {r.order_id: r.event_seq for r in jobs.latest_orders(spark.read.parquet(out)).collect()} == want
    x, stream = pieces(f"SELECT *, trade_id || symbol AS event_id FROM ({EXECUTIONS})", "executed_at")
    out = str(tmp_path / "trades")
    jobs.start(stream, jobs.project_trades(out, TRADE_ORDER), str(tmp_path / "c3")).awaitTermination()
    assert spark.read.parquet(out).count() == orders.project_trades(x, TRADE_ORDER).count()


def test_stream_balances_and_risk(spark, pieces, tmp_path):
    from tallyforge.operators import balances, ledger

    df, stream = pieces(EXECUTIONS, "executed_at")
    postings = ledger.postings(stream, ORDER)
    out = str(tmp_path / "risk")
    q = jobs.running_balances(postings).writeStream.outputMode("update").foreachBatch(jobs.risk_diffs(out)).option("checkpointLocation", str(tmp_path / "c4")).trigger(availableNow=True).start()
    q.awaitTermination()
    blocked = [r.account_id for r in spark.read.parquet(out).collect()]
    final = balances.risk_state(balances.project_balances(ledger.postings(df, ORDER))).where("status = 'BLOCKED'")
    assert len(blocked) == len(set(blocked)) and {r.account_id for r in final.collect()} <= set(blocked)


def test_stream_matching_equals_batch_in_order(spark, sf, tmp_path):
    commands = view(spark, sf, ORDER_COMMANDS).where("command_type = 'NEW'")
    path = str(tmp_path / "cmd")
    for k, cut in enumerate(("received_at < '1996-06-01'", "received_at >= '1996-06-01' AND received_at < '1999-01-01'", "received_at >= '1999-01-01'")):
        commands.where(cut).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(commands.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)
    q = jobs.match_orders(stream).writeStream.format("memory").queryName("matched").outputMode("append").option("checkpointLocation", str(tmp_path / "c5")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = ["symbol", "match_id", "taker_order_id", "maker_order_id", "quantity", "price"]
    want = sorted(map(str, matching.match_orders(commands).where("kind = 'FILL'").select(*key).collect()))
    assert sorted(map(str, spark.table("matched").where("kind = 'FILL'").select(*key).collect())) == want


def test_stream_windows(spark, pieces, tmp_path):
    _, stream = pieces(ACTIVITY, "ts")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    counts = jobs.anomaly_counts(stream, "NEW", ["account_id"], "3650 days", "1 day")
    both = counts.select("account_id", F.col("w.start").alias("start"), "n")
    q = both.writeStream.format("memory").queryName("floods").outputMode("update").option("checkpointLocation", str(tmp_path / "c6")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for r in spark.table("floods").collect():
        last[r.account_id, r.start] = max(r.n, last.get((r.account_id, r.start), 0))
    assert last and all(n >= 1 for n in last.values())
    assert jobs.volume_sessions(stream.withColumn("notional", F.col("quantity"))).isStreaming
    kept = jobs.dedup_within(stream, ["event_id"], "ts", "1 day")
    assert kept.isStreaming


def test_partition_sinks_are_idempotent(spark, tmp_path):
    r = spark.createDataFrame([(1, 5, "USDT", D(1)), (2, 5, "USDT", D(2))], "batch_id long, account_id long, asset string, closing_balance decimal(36,18)")
    path = str(tmp_path / "results")
    for _ in range(2):
        tables.write_clearing_results(r, path)
    tables.write_clearing_results(r.where("batch_id = 2").withColumn("account_id", F.lit(6).cast("long")), path)
    assert {(x.batch_id, x.account_id) for x in versions.read(spark, path).collect()} == {(1, 5), (2, 5), (2, 6)}
    again = r.where("batch_id = 2").withColumns({"asset": F.lit("usdt"), "closing_balance": F.lit(9).cast("decimal(36,18)")})
    tables.write_clearing_results(again, path)
    assert sorted((x.batch_id, x.account_id, x.asset, int(x.closing_balance)) for x in versions.read(spark, path).collect()) == [(1, 5, "USDT", 1), (2, 5, "usdt", 9), (2, 6, "USDT", 2)]
    diffs = str(tmp_path / "diffs")
    tables.write_recon_diffs(r.select("account_id", "asset"), diffs, 7)
    tables.write_recon_diffs(r.select("account_id", "asset").limit(0), diffs, 7)
    assert versions.read(spark, diffs).count() == 0
