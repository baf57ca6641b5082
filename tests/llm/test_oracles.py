import pytest

from engramix.llm import queries

from ..oracles import SF, connect, same


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_oracle(spark, con, name):
    same(queries.QUERIES[name](spark, SF), queries.ORACLES[name], con)


def test_ten_queries():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 11))
