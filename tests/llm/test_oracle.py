import pytest

from labquarry.llm import queries
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_like_sql(spark, name):
    assert differences(spark, connect(SF), SF, queries.queries()[name], queries.oracle_sql()[name]) is None
