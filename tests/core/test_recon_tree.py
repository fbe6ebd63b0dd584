"""Recon by buckets equals recon by a full join, and reads what differs."""

from decimal import Decimal

import pytest

from tallyforge.operators import recon, recon_tree
from tallyforge.sources import versions

ROWS = "id long, account_id long, asset string, amount decimal(20,8)"
BALANCES = "account_id long, asset string, available decimal(20,8), locked decimal(20,8)"


def ledger_of(spark, rows):
    return spark.createDataFrame([(i, a, s, None if x is None else Decimal(x)) for i, (a, s, x) in enumerate(rows)], ROWS)


def balances_of(spark, rows):
    return spark.createDataFrame([(a, s, None if x is None else Decimal(x), Decimal(0)) for a, s, x in rows], BALANCES)


def found(df):
    return sorted(map(str, df.collect()))


def test_nulls_cases_repeats_and_keys_of_one_side(spark, tmp_path):
    left = [(1, "btc", 5), (1, "BTC", 2), (2, "KRW", "1.4"), (3, "KRW", 9), (None, "BTC", 1), (4, None, 1), (5, "BTC", None), (6, "ETH", None), (6, "eth", None)]
    right = [(1, "Btc", 7), (2, "KRW", "1.3"), (None, "BTC", 1), (4, None, 1), (5, "BTC", None), (6, "ETH", 0), (7, "BTC", 0)]
    truth, snapshot = str(tmp_path / "t"), str(tmp_path / "s")
    ledger, balances = ledger_of(spark, left), balances_of(spark, right)
    for piece in (ledger.where("id < 3"), ledger.where("id >= 3 AND id < 8"), ledger.where("id >= 8"), ledger.where("false")):
        recon_tree.add(piece, "amount", truth, "truth", 8)
    recon_tree.add(recon.totals(balances), "total", snapshot, "snapshot", 8)
    got = recon_tree.compare(spark, truth, snapshot)
    assert found(got) == found(recon.compare(ledger, balances)) and got.columns == recon.compare(ledger, balances).columns


def test_one_key_in_a_thousand_opens_few_buckets(spark, tmp_path):
    ledger = spark.range(20000).selectExpr("id", "id AS account_id", "'BTC' AS asset", "CAST(id AS decimal(20,8)) AS amount")
    balances = ledger.selectExpr("account_id", "asset", "CAST(amount + IF(account_id % 1000 = 7, 1, 0) AS decimal(20,8)) AS available", "CAST(0 AS decimal(20,8)) AS locked")
    truth, snapshot = str(tmp_path / "t"), str(tmp_path / "s")
    recon_tree.add(ledger, "amount", truth, "truth", 512)
    recon_tree.add(recon.totals(balances), "total", snapshot, "snapshot", 512)
    assert len(recon_tree.open_buckets(spark, truth, snapshot)) <= 20  # of 512: at most one for each wrong key
    got = recon_tree.compare(spark, truth, snapshot)
    assert found(got) == found(recon.compare(ledger, balances)) and got.count() == 20
    read = versions.read(spark, truth, recon_tree.open_buckets(spark, truth, snapshot)).count()
    assert read < 20000 / 20
    # later postings of one account write its bucket alone
    assert len(recon_tree.add(ledger.where("account_id = 7"), "amount", truth, "truth", 512)) == 1


def test_a_write_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    ledger, balances = ledger_of(spark, [(1, "BTC", 5), (2, "BTC", 6)]), balances_of(spark, [(1, "BTC", 5), (2, "BTC", 7)])
    truth, snapshot = str(tmp_path / "t"), str(tmp_path / "s")
    recon_tree.add(ledger, "amount", truth, "truth", 4)
    recon_tree.add(recon.totals(balances), "total", snapshot, "snapshot", 4)
    before = found(recon_tree.compare(spark, truth, snapshot))
    with monkeypatch.context() as m:
        m.setattr(versions, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            recon_tree.add(ledger, "amount", truth, "truth", 4)
    assert found(recon_tree.compare(spark, truth, snapshot)) == before and len(before) == 1
