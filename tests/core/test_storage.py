import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import balances, ledger, storage
from tallyforge.operators.sums import running
from tallyforge.sources import tables


def test_tables_are_stored_and_can_be_removed(spark):
    df = storage.stored(spark.range(5), "five")
    assert sorted(r.id for r in df.collect()) == list(range(5))
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path)
    assert storage.forget() >= 1 and not os.path.exists(path) and storage.forget() == 0


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(session)


def test_first_by_keeps_the_first_row_and_null_keys(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 2, "b"), (None, 5, "e"), (None, 4, "d"), (2, None, "n"), (2, 1, "a")], "k long, o long, v string")
    assert sorted((str(r.k), r.v) for r in ledger.first_by(df, ["k"], ["o"]).collect()) == [("1", "b"), ("2", "n"), ("None", "d")]


def test_ids_go_on_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    rows = sorted((r.id, r.x) for r in ledger.with_ids(df, [F.col("x")], 50).collect())
    assert rows == [(51 + i, i) for i in range(1000)]
    assert ledger.with_ids(df.limit(0), [F.col("x")]).count() == 0


def test_running_sums_equal_one_window(spark, monkeypatch):
    rows = [(g, i, (i * 37) % 11) for g in (1, 2, None) for i in range(60)]
    df = spark.createDataFrame(rows, "g long, i long, v long").withColumn("b", F.floor(F.col("i") / 7))
    got = {(r.g, r.i): r.s for r in running(df, ["g"], "b", ["i"], F.col("v"), "s").collect()}
    assert got == {(g, i): sum((j * 37) % 11 for j in range(i)) for g, i, _ in rows}
    monkeypatch.setattr(balances, "RUN", 4)
    led = spark.createDataFrame([(i + 1, i % 3, "usdt" if i % 2 else "USDT", i - 20) for i in range(50)],
        "id long, account_id long, asset string, amount decimal(20,8)".replace("decimal(20,8)", "int")).withColumn("amount",
        F.col("amount").cast("decimal(20,8)"))
    want, total = {}, {}
    for i in range(50):
        total[i % 3] = total.get(i % 3, 0) + i - 20
        want[i + 1] = total[i % 3]
    assert {r.id: int(r.balance) for r in balances.running_balance(led).collect()} == want


def test_a_database_table_is_read_in_parts(spark):
    url = "jdbc:derby:memory:parts;create=true"
    spark.range(100).select("id", F.concat(F.lit("n"), "id").alias("name")).write.jdbc(url, "things")
    df = tables.load_jdbc(spark, url, "things", "id", 0, 100, 4)
    assert df.rdd.getNumPartitions() == 4 and sorted(r[0] for r in df.select("id").collect()) == list(range(100))


def test_floods_block_an_account(spark):
    held = spark.createDataFrame([(1, "USDT", 5), (2, "USDT", -1), (3, "USDT", -2)], "account_id long, asset string, available int").withColumn("available", F.col("available").cast("decimal(20,8)"))
    log = spark.createDataFrame([(1, 4, "2026-01-01 00:02:00", "Account blocked"), (1, 3, "2026-01-01 00:01:00", "Account blocked"), (2, 3,
        "2026-01-01 00:01:00", "Account blocked"), (4, 3, "2026-01-01 00:01:00", "Account blocked"), (5, 2, "2026-01-01 00:01:00", None)],
        "account_id long, n_recent long, detected_at string, action string")
    old = spark.createDataFrame([(3, "BLOCKED", "by hand"), (6, "NORMAL", None)], "account_id long, status string, block_reason string")
    got = {r.account_id: (r.status, r.block_reason) for r in balances.risk_state(held, old, log).collect()}
    assert got == {1: ("BLOCKED", "Order flood: 3 times"), 2: ("BLOCKED", "Negative balance: USDT = -1.00000000"), 3: ("BLOCKED", "by hand"),
        4: ("BLOCKED", "Order flood: 3 times"), 6: ("NORMAL", None)}
    assert [r.account_id for r in balances.accounts_by_status(balances.risk_state(held, old, log), "NORMAL").collect()] == [6]
