import pytest
from oracle import connect, differences

from stratalake.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SMALL)
    if name in queries.SQL:
        assert differences(df, duck, queries.SQL[name]) == []
    else:
        assert df.count() > 0
