"""Golden cases of posting, clearing and reconciliation, and invariants on the small tables."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.functions import assets, rules
from tallyforge.operators import balances, clearing, ledger, recon
from tallyforge.plans import ledger_plans as plans
from tallyforge.sources.generate import bulk_seed, burst_orders

D = Decimal
RUN = "trade_id string, account_id long, symbol string, side string, quantity decimal(20,8), price decimal(20,8), fee decimal(20,8), fee_asset string, executed_at timestamp, n long"


def execs(spark, rows):
    return spark.createDataFrame([(t, a, s, side, D(q), D(p), None if f is None else D(f), fa, datetime(2026, 2, 23, 10), i) for i, (t, a, s, side, q, p, f, fa) in enumerate(rows)], RUN)


def posted(df):
    return {r.idempotency_key: r.amount for r in df.collect()}


def test_buy_sell_and_fee_postings(spark):
    rows = posted(ledger.post_ledger(execs(spark, [("TRD-001", 1, "BTCUSDT", "BUY", "0.1", "50000", "5", "USDT"), ("T2", 1, "ethusdc".upper(), "sell",
        "2", "3", None, None), ("T3", 2, "BTCKRW", "BUY", "1", "2", "1", None)]), ["executed_at", "n"]))
    assert rows == {
        "TRD-001:1:BTC:TRADE": D("0.1"), "TRD-001:1:USDT:TRADE": D(-5000), "TRD-001:1:USDT:FEE": D(-5), "T2:1:ETH:TRADE": D(-2), "T2:1:USDC:TRADE": D(6),
        "T3:2:BTC:TRADE": D(1), "T3:2:CKRW:TRADE": D(-2), "T3:2:CKRW:FEE": D(-1),
    }


def test_duplicates_are_skipped_whole(spark):
    e = execs(spark, [("T", 1, "BTCUSDT", "BUY", "1", "10", "1", None), ("T", 1, "BTCUSDT", "SELL", "7", "9", "2", "BNB"), ("T", 2, "BTCUSDT", "SELL", "1", "10", None, None)])
    rows = posted(ledger.post_ledger(e, ["executed_at", "n"]))
    assert rows == {"T:1:BTC:TRADE": D(1), "T:1:USDT:TRADE": D(-10), "T:1:USDT:FEE": D(-1), "T:2:BTC:TRADE": D(-1), "T:2:USDT:TRADE": D(10)}
    again = ledger.post_ledger(e, ["executed_at", "n"], ledger.post_ledger(e, ["executed_at", "n"]))
    assert again.count() == 0


def test_symbol_rules(spark):
    got = spark.createDataFrame([("BTCUSDT",), ("ABC",), ("USDUSD",), ("ETHBTC",), ("XKRW",)], "s string").select(assets.base_asset(F.col("s")),
        assets.quote_asset(F.col("s")), assets.fee_currency(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("BTC", "USDT", "USDT"), ("ABC", "ABC", "ABC"), ("", "USD", "USDUSD"), ("ETH", "HBTC", "BTC"), ("XKR", "XKRW", "KRW")]


def golden(spark):
    t = lambda d, h, s=0: datetime(2026, 2, d, h, 0, s)
    rows = [(1, 1001, "USDT", -100, "TRADE", "TR-1", t(23, 10)), (2, 1001, "USDT", -2, "FEE", "TR-1", t(23, 10, 1)), (3, 1001, "usdt", 40, "TRADE",
        "TR-2", t(23, 11)), (4, 2001, "USDT", 50, "DEPOSIT", None, t(22, 9)), (5, 1001, "USDT", 100, "DEPOSIT", None, t(22, 9)), (6, 1001, "USDT",
        999, "TRADE", "TR-FUTURE", t(24, 0))]
    return spark.createDataFrame([(i, a, s, D(x), k, tr, f"k{i}", at) for i, a, s, x, k, tr, at in rows], schemas.LEDGER)


def test_golden_clearing(spark):
    led = golden(spark)
    mark = ledger.watermark(led, "2026-02-23").first()[0]
    assert mark == 5
    assert ledger.watermark(led, "2020-01-01").first()[0] == 0
    got = {r.account_id: tuple(map(int, (r.opening_balance, r.net_change, r.closing_balance, r.fee_total, r.trade_count,
        r.trade_value))) for r in clearing.checked(clearing.clear(led, "2026-02-23", mark)).collect()}
    assert got == {1001: (100, -62, 38, 2, 2, 140), 2001: (50, 0, 50, 0, 0, 0)}
    only = clearing.clear(led, "2026-02-23", mark, "account:2000-2500")
    assert [r.account_id for r in only.collect()] == [2001]


def test_given_openings_and_violations(spark):
    led = golden(spark)
    openings = spark.createDataFrame([(1001, "USDT", D(150))], "account_id long, asset string, opening decimal(38,8)")
    bad = clearing.violations(clearing.clear(led, "2026-02-23", 5, openings=openings)).collect()
    assert [(r.account_id, r.violation) for r in bad] == [(1001, "OPENING_PLUS_NET")]
    with pytest.raises(ValueError, match="OPENING_PLUS_NET"):
        clearing.checked(clearing.clear(led, "2026-02-23", 5, openings=openings))


def test_previous_closings(spark):
    results = spark.createDataFrame([(1, 1, "2026-02-21", 1, "USDT", 90, "FINAL"), (2, 2, "2026-02-22", 1, "USDT", 100, "FINAL"), (3, 3, "2026-02-22",
        1, "usdt", 110, "FINAL"), (4, 4, "2026-02-22", 1, "USDT", 5, "FINAL"), (5, 2, "2026-02-22", 1, "USDT", 6, "PRELIMINARY"), (6, 2,
        "2026-02-23", 1, "USDT", 7, "FINAL")], "id long, batch_id long, d string, account_id long, asset string, c int, status string").selectExpr("id",
        "batch_id", "CAST(d AS DATE) AS business_date", "account_id", "asset", "CAST(c AS DECIMAL(36,18)) AS closing_balance", "status")
    batches = spark.createDataFrame([(1, "EOD"), (2, "EOD"), (3, "EOD"), (4, "INTRADAY")], "id long, batch_type string")
    got = clearing.previous_closings(results, batches, "2026-02-23").orderBy("place").collect()
    assert [int(r.closing_balance) for r in got] == [110, 100, 90]
    assert int(clearing.opening_asof(results, batches, "2026-02-23").first()["opening"]) == 110


@pytest.mark.parametrize("text, want", [("", ("all", 0, 0)), (None, ("all", 0, 0)), ("account:1-9", ("account", 1, 9)), ("chunk:0/3", ("chunk", 0, 3))])
def test_scopes(text, want):
    assert rules.parse_scope(text) == want


@pytest.mark.parametrize("text", ["account:0-9", "account:9-1", "chunk:3/3", "symbols:BTC", "x"])
def test_bad_scopes(text):
    with pytest.raises(ValueError):
        rules.parse_scope(text)


def test_recon_golden(spark):
    led = spark.createDataFrame([(1, 1001, "USDT", D(100)), (2, 1, "KRW", D(100)), (3, 2, "USDT", D("1.12345678")), (4, 3, "USDT", D(100)), (5, 9,
        "ETH", D(1))], "id long, account_id long, asset string, amount decimal(20,8)")
    held = spark.createDataFrame([(1001, "usdt", D(95), D(0)), (1, "KRW", D("100.4"), D(0)), (2, "USDT", D("1.12345678"), D(0)), (3, "usdt", D(50),
        D(0)), (3, "USDT", D(25), D(25)), (8, "USD", D(1), D(0))], "account_id long, asset string, available decimal(20,8), locked decimal(20,8)")
    got = {(r.account_id, r.asset): r.diff_value for r in recon.compare(led, held).collect()}
    assert got == {(1001, "USDT"): D(-5), (9, "ETH"): None, (8, "USD"): None}
    s = recon.summary(recon.compare(led, held)).first()
    assert (s.diff_count, s.high_severity_count, s.total_abs_diff) == (3, 3, D(5))
    empty = recon.summary(recon.compare(led.limit(0), held.limit(0))).first()
    assert tuple(empty) == (0, 0, D(0))


def test_severities(spark):
    diffs = spark.createDataFrame([("LOW", 1, "OPEN"), ("CRITICAL", 2, "OPEN"), ("HIGH", 3, "OPEN"), ("MEDIUM", 4, "OPEN"), ("HIGH", 5, "CLOSED")], "severity string, created_at int, status string")
    assert [r.severity for r in recon.open_diffs(diffs, 9).collect()] == ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
    assert [r.severity for r in recon.open_diffs(diffs, 2, alphabetical=True).collect()] == ["MEDIUM", "LOW"]


def test_ids_are_dense_and_in_order(spark, sf):
    rows = plans.the_ledger(spark, sf).select("id", "created_at").orderBy("id").collect()
    assert [r.id for r in rows] == list(range(1, len(rows) + 1))
    assert all(a.created_at <= b.created_at for a, b in zip(rows, rows[1:]))


def test_ledger_sums_equal_balances_and_recon_of_them_is_empty(spark, sf):
    led = plans.the_ledger(spark, sf)
    assert recon.compare(led, balances.project_balances(led)).count() == 0


def test_chain_of_closings(spark, sf):
    led = plans.the_ledger(spark, sf)
    first, second = ledger.watermark(led, "1998-06-29").first()[0], ledger.watermark(led, "1998-06-30").first()[0]
    before = {(r.account_id, r.asset): r.closing_balance for r in clearing.clear(led, "1998-06-29", first).collect()}
    for r in clearing.clear(led, "1998-06-30", second).collect():
        assert r.opening_balance == before.get((r.account_id, r.asset), 0)


def test_breaches_and_risk(spark):
    led = spark.createDataFrame([(1, 7, "A", D(5)), (2, 7, "A", D(-9)), (3, 7, "A", D(1)), (4, 7, "B", D(-1)), (5, 8, "A", D(1))], "id long, account_id long, asset string, amount decimal(20,8)")
    got = {(r.account_id, r.asset): (r.id, r.balance) for r in balances.first_breach(led).collect()}
    assert got == {(7, "A"): (2, D(-4)), (7, "B"): (4, D(-1))}
    state = balances.risk_state(balances.project_balances(led))
    assert {r.account_id: (r.status, r.block_reason) for r in state.collect()} == {7: ("BLOCKED", "Negative balance: A = -3.00000000"), 8: ("NORMAL", None)}
    old = spark.createDataFrame([(8, "BLOCKED", "manual"), (7, "NORMAL", None)], "account_id long, status string, block_reason string")
    kept = balances.risk_state(balances.project_balances(led), old)
    assert {r.account_id: r.block_reason for r in kept.collect()}[8] == "manual"
    assert [(r.account_id, r.command_type) for r in balances.risk_commands(old, kept).collect()] == [(7, "BLOCK_ACCOUNT")]


def test_generators(spark):
    led, held = bulk_seed(spark, "2026-03-17", 50, 5)
    assert (led.count(), held.count(), led.select("idempotency_key").distinct().count()) == (750, 100, 750)
    assert recon.compare(led, held).count() == 0
    assert clearing.violations(clearing.clear(led, "2026-03-17", 10**9)).count() == 0
    assert burst_orders(spark, 10, "BTCUSDT", "2026-03-17 10:00:00").where("side = 'BUY'").count() == 5


def test_empty_ledger(spark, sf):
    led = plans.the_ledger(spark, sf).limit(0)
    assert ledger.watermark(led, "1998-06-30").first()[0] == 0
    assert clearing.clear(led, "1998-06-30", 0).count() == ledger.holdings(led).count() == 0
    assert ledger.with_ids(led.drop("id"), [F.col("idempotency_key")]).count() == 0
