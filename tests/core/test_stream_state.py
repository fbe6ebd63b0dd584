import random
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from tallyforge.operators import balances, risk
from tallyforge.streaming import jobs

T0 = datetime(2026, 1, 1)
ORDERS = "event_id long, account_id long, ts timestamp, notional decimal(20,8)"


def streamed(spark, tmp_path, batches, schema, job):
    """What the job has written after taking each batch in a run of its own."""
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        to = job(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c")
        jobs.keyed_state(spark, to.trigger(availableNow=True).start).awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


def test_volume_limit_of_orders_out_of_order(spark, tmp_path):
    """Orders come up to five hours late, across batches; the last one closes all others."""
    r = random.Random(5)
    rows = [(i, i % 3, T0 + timedelta(minutes=37 * i), None if i % 11 == 0 else Decimal(r.randrange(60))) for i in range(150)]
    late = sorted(rows, key=lambda x: x[2] + timedelta(hours=r.uniform(0, 5)))
    end = [(999, 99, T0 + timedelta(days=30), Decimal(1))]
    found = streamed(spark, tmp_path, [late[:60], late[60:110], late[110:] + end], ORDERS, lambda s: jobs.volume_limit(s, "6 hours", 300))
    want = {x.event_id: x.accepted for x in risk.volume_limit(spark.createDataFrame(rows, ORDERS), 300).collect()}
    got = found.collect()
    assert len(got) == len(rows) and {x.event_id: x.accepted for x in got} == want and len(set(want.values())) == 2


def test_escalations_equal_those_of_the_table(spark, tmp_path):
    """Floods in minutes, counted over a trailing hour: at the third the account is blocked, at one that comes later it is not."""
    schema = "event_id long, account_id long, symbol string, command_type string, ts timestamp"
    minutes = {1: [0, 10, 20, 90, 150, 209], 2: [0, 61, 122], 3: [5, 5, 65]}
    rows = [(0, a, "XY"[k % 2], "NEW", T0 + timedelta(minutes=m, seconds=k)) for a, ms in minutes.items() for m in ms for k in range(4)]
    rows = sorted(rows, key=lambda x: x[4])
    end = [(0, 9, "X", "NEW", T0 + timedelta(days=2))]
    found = streamed(spark, tmp_path, [rows[:20], rows[20:40], rows[40:] + end], schema, lambda s: jobs.escalations(jobs.flood_log(s, 2, "10 minutes"), 3, 3600))
    table = spark.createDataFrame(rows, schema)
    want = risk.flood_escalation(risk.order_flood(table, 2).unionByName(risk.order_flood(table, 2, True)), 3, 3600)
    columns = ["account_id", "symbol", "detected_at", "n", "n_recent", "action"]
    assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert found.where(F.col("action").isNotNull()).count() == want.where(F.col("action").isNotNull()).count() > 0


def test_a_null_notional_adds_nothing(spark):
    rows = [(1, 1, T0, None), (2, 1, T0 + timedelta(hours=1), Decimal(9)), (3, 1, T0 + timedelta(hours=2), None), (4, 1, T0 + timedelta(hours=3), Decimal(2))]
    assert {x.event_id: x.accepted for x in risk.volume_limit(spark.createDataFrame(rows, ORDERS), 10).collect()} == {1: True, 2: True, 3: True, 4: False}


def test_first_breach_sums_an_asset_in_any_case(spark):
    rows = [(1, 7, "BTC", Decimal(9)), (2, 7, "btc", Decimal(-5)), (3, 7, "BTC", Decimal(3)), (4, 8, "eth", Decimal(1)), (5, 8, "ETH", Decimal(-2))]
    ledger = spark.createDataFrame(rows, "id long, account_id long, asset string, amount decimal(20,8)")
    assert [(x.account_id, x.asset, x.id, int(x.balance)) for x in balances.first_breach(ledger).collect()] == [(8, "ETH", 5, -1)]


def test_floods_of_a_hot_account_are_counted_in_parts(spark):
    rows = [(1, None if i % 3 else "X", "ORDER_FLOOD", 5, T0 + timedelta(seconds=(i * i * 7) % 40_000)) for i in range(400)] + [(1, None, "ORDER_FLOOD", 5, None)] * 2
    log = spark.createDataFrame(rows, "account_id long, symbol string, pattern_type string, n long, detected_at timestamp")
    found = risk.flood_escalation(log, 3, 3600)
    times = [r[4] for r in rows]
    count = lambda t: sum(x is None for x in times) if t is None else sum(x is not None and timedelta(0) <= t - x <= timedelta(hours=1) for x in times)
    want = sorted(str((r[1], r[4], count(r[4]), "Account blocked" if r[1] is None and count(r[4]) >= 3 else None)) for r in rows)
    assert sorted(str((r.symbol, r.detected_at, r.n_recent, r.action)) for r in found.collect()) == want
