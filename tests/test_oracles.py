import pytest

from engramix.plans import registry

from .oracles import SF, connect, same

registry.load()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_oracle(spark, con, name):
    same(registry.QUERIES[name](spark, SF), registry.ORACLES[name], con)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_oracle_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0
