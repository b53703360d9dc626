import pytest

from labquarry.plans import registry

from .oracle import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_like_sql(spark, con, name):
    sql = registry.oracle_sql().get(name)
    run = registry.queries()[name]
    if sql is None:
        assert run(spark, SF).count() > 0
    else:
        assert differences(spark, con, SF, run, sql) is None
