import pytest

from tallyforge.plans import ledger_plans, stream_plans, trading_plans
from tests.oracle import canonical, connect

QUERIES = ledger_plans.QUERIES | trading_plans.QUERIES | stream_plans.QUERIES
ORACLES = ledger_plans.ORACLES | trading_plans.ORACLES | stream_plans.ORACLES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, sf, con, name):
    got, want = QUERIES[name](spark, sf).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry_imports_and_runs(spark):
    import __spark_entry__

    assert set(ORACLES) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
