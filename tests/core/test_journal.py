"""The journal gives the ledger that posting gives, and keeps little on disk."""

import random
import re
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from tallyforge.operators import balances, ledger, storage
from tallyforge.plans import ledger_plans as plans
from tallyforge.sources.views import EXECUTIONS, view

SCHEMA = "trade_id string, account_id long, symbol string, side string, quantity decimal(20,8), price decimal(20,8), fee decimal(20,8), fee_asset string, executed_at timestamp, k long"
COLUMNS = ["account_id", "asset", "amount", "entry_type", "trade_id", "idempotency_key", "created_at"]
ORDER = ["executed_at", "k"]


def executions(spark, n=400):
    """Repeated trades, of several symbols with one quote or with another's base as quote; equal times, and places that tie."""
    r, rows = random.Random(5), []
    for _ in range(n):
        at = datetime(2026, 1, 1) + timedelta(days=r.randrange(20))
        rows.append((f"T{r.randrange(n // 3)}", r.randrange(3), r.choice(["BTCUSDT", "ETHUSDT", "ETHBTC", "ethusdt", "USDUSDT", "USDTUSD", "BTCKRW"]), r.choice(["BUY", "SELL"]),
            Decimal(r.randrange(1, 9)), Decimal(r.randrange(1, 50)), Decimal(r.choice([0, 1, 2])), r.choice([None, None, "bnb"]), at, r.randrange(10**9)))
    tied = [(f"Z{i % 7}{i}", 1, "BTCUSDT", "BUY", Decimal(1), Decimal(2), Decimal(1), None, datetime(2026, 1, 9), 5) for i in range(20)]
    return spark.createDataFrame(rows + tied, SCHEMA)


def rows_of(df):
    return sorted(map(str, df.select(*COLUMNS).collect()))


def test_a_journal_posts_what_posting_posts(spark):
    x = executions(spark)
    want = rows_of(ledger.post_ledger(x, ORDER))
    assert rows_of(ledger.entries(ledger.journal(x, ORDER))) == want
    assert rows_of(ledger.entries(ledger.journal(x, ORDER, ("trade_id",)))) == want


def test_ids_are_in_order_of_place_leg_and_key(spark):
    x = executions(spark)
    rows = ledger.post_ledger(x, ORDER).collect()
    want = [r.idempotency_key for r in sorted(rows, key=lambda r: (*r.posted, r.leg, r.idempotency_key))]
    got = sorted(ledger.ledger_of(x, ORDER).collect(), key=lambda r: r.id)
    assert [r.id for r in got] == list(range(1, len(want) + 1)) and [r.idempotency_key for r in got] == want
    assert ledger.ledger_of(x.limit(0), ORDER).count() == 0


def test_a_null_time_is_posted_last_as_in_sql(spark):
    x = executions(spark, 30).withColumn("executed_at", F.when(F.col("k") % 3 > 0, F.col("executed_at")))
    got = [r.created_at for r in ledger.ledger_of(x, ORDER).orderBy("id").collect()]
    assert None in got and got[-1] is None and None not in got[: got.index(None)]
    led = ledger.ledger_of(x, ORDER)
    mark = ledger.watermark(led, "2026-01-10").first()[0]
    assert sorted(r.id for r in led.where(ledger.posted_by("2026-01-10")).collect()) == list(range(1, mark + 1))


def test_the_journal_moves_nothing_but_the_join(spark, sf):
    x = view(spark, sf, EXECUTIONS).hint("merge")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ledger.journal(x, plans.ORDER, plans.WITHIN)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(re.findall(r"hashpartitioning\((\w_orderkey)", plan)) == ["l_orderkey", "o_orderkey"] and len(re.findall(r"Exchange ", plan)) == 2


def test_shuffle_files_go_when_a_table_is_written(spark):
    disk = spark._jsc.sc().env().blockManager().diskBlockManager()
    count = lambda: disk.getAllFiles().mkString(",").count("shuffle_")
    before = count()
    found = storage.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3))
    assert count() <= before and found.count() == 7


def test_a_journal_of_one_ledger_does_not_stay(spark):
    before = len(storage._made)
    assert ledger.ledger_of(executions(spark), ORDER).count() > 0
    assert {p.rsplit("/", 1)[1].split("-")[0] for p in storage._made[before:]} == {"ledger"}


def test_hot_and_other_accounts_have_one_running_balance(spark, monkeypatch):
    monkeypatch.setattr(balances, "RUN", 10)
    rows = [(i + 1, None if i % 9 == 4 else 1 if i % 3 else i, "usdt" if i % 2 else "USDT", Decimal((i * 37) % 23 - 11)) for i in range(90)]
    led = spark.createDataFrame(rows, "id long, account_id long, asset string, amount decimal(20,8)")
    total, want, first = {}, {}, {}
    for i, a, _, v in rows:
        total[a] = total.get(a, 0) + v
        want[i] = total[a]
        if total[a] < 0:
            first.setdefault(a, (i, total[a]))
    assert {r.id: r.balance for r in balances.running_balance(led).collect()} == want
    assert {r.account_id: (r.id, r.balance) for r in balances.first_breach(led).collect()} == first


def test_shares_are_whole(spark):
    x = spark.range(100).select((F.col("id") % 13).alias("k"))
    found = spark.read.parquet(*storage.written_in_shares(lambda own: own.groupBy("k").count(), x, ["k"], "counts", 3))
    assert {r.k: r["count"] for r in found.collect()} == {k: len(range(k, 100, 13)) for k in range(13)}


def test_a_kept_table_that_was_removed_is_made_again(spark, sf):
    n = plans.the_sums(spark, sf).count()
    storage.forget()
    assert plans.the_sums(spark, sf).count() == n
