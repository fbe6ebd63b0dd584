import pytest

from tallyforge.llm.queries import ORACLES, QUERIES
from tests.oracle import canonical, connect


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), connect(sf).sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_each_operator_is_registered_once():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
