"""Executions on a stream: valid and quarantined rows under one batch id."""

import pytest

from tallyforge.sources import versions
from tallyforge.streaming import jobs

GOOD = '{"trade_id":"%s","account_id":1,"symbol":"BTC-KRW","side":"BUY","quantity":1,"price":2,"executed_at":"2026-01-01T00:00:00"}'


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def kept(spark, path):
    return [sorted(str(r[0]) for r in jobs.executions_in(spark, path, s).select(c).collect()) for s, c in (("valid", "trade_id"), ("quarantine", "reject"))]


def test_a_batch_that_runs_again_repeats_neither_sink(spark, tmp_path):
    path = str(tmp_path / "x")
    write = jobs.split_executions(path)
    write(texts(spark, GOOD % "a", GOOD % " ", "no json", None), 0)
    write(texts(spark, GOOD % "b"), 1)
    assert kept(spark, path) == [["a", "b"], ["tradeId", "tradeId", "tradeId"]]
    write(texts(spark, GOOD % "b"), 1)
    assert kept(spark, path) == [["a", "b"], ["tradeId", "tradeId", "tradeId"]]
    bad = jobs.executions_in(spark, path, "quarantine")
    assert {r.raw for r in bad.collect()} == {GOOD % " ", "no json", None} and "raw" not in jobs.executions_in(spark, path, "valid").columns


def test_a_batch_that_dies_leaves_neither_sink(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "x")
    write = jobs.split_executions(path)
    write(texts(spark, GOOD % "a"), 0)
    with monkeypatch.context() as m:
        m.setattr(versions, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            write(texts(spark, GOOD % "b", "no json"), 1)
    assert kept(spark, path) == [["a"], []]
    write(texts(spark, GOOD % "b", "no json"), 1)
    assert kept(spark, path) == [["a", "b"], ["tradeId"]]
