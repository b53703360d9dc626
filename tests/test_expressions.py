import pytest

from labquarry.functions.expressions import ExpressionError
from labquarry.operators import tabular as t

ROWS = [(1, 2.0, "a", True), (2, None, "b", False), (3, -4.0, None, None), (4, 8.0, "it's", True)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id int, `my x` double, s string, b boolean")


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ("`my x` > 0", [1, 4]),
        ("`my x` != 2", [2, 3, 4]),
        ("not `my x` > 0", [2, 3]),
        ("~(`my x` > 0)", [2, 3]),
        ("1 < id <= 3", [2, 3]),
        ("s in ['a', \"it's\"]", [1, 4]),
        ("s not in ('a',)", [2, 3, 4]),
        ("id == 1 or id == 2 and `my x` > 0", [1]),
        ("(id == 1) | (id == 4) & (`my x` > 10)", [1]),
        ("id > id.mean()", [3, 4]),
        ("`my x` >= `my x`.max()", [4]),
        ("-id ** 2 == -4", [2]),
        ("2 ** 3 ** 0 == 2 and id % 2 == 1", [1, 3]),
        ("-7 % 3 == 2 and 7 // 2 == 3 and id / 0 != 1", [1, 2, 3, 4]),
        ("@np.sqrt(id) == 2", [4]),
        ("b", [1, 4]),
        ("s.isnull()", [3]),
        ("1 + 2 * id - 1 == 6 and id not in [-3]", [3]),
        ("", [1, 2, 3, 4]),
    ],
)
def test_filter(df, text, ids):
    assert sorted(r["id"] for r in t.filter_rows(df, text).collect()) == ids


@pytest.mark.parametrize("text", ["nope > 1", "id >", "__import__('os')", "id.apply(1)", "id = 1", "id ! 2", "s in a"])
def test_rejected(df, text):
    with pytest.raises(ExpressionError):
        t.filter_rows(df, text)


def test_comparisons_reach_the_scan(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = t.filter_rows(li, "l_quantity > 30 and l_returnflag == 'R'").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "l_quantity,30.0), EqualTo(l_returnfl" in plan and "l_extendedprice" not in plan


def test_flags_are_never_missing(df):
    assert [r["f"] for r in t.math_column(df, "f = `my x` > 0").orderBy("id").collect()] == [True, False, False, True]
