import pytest

from labquarry.operators import tabular as t


@pytest.fixture(scope="module")
def holes(spark):
    rows = [("a", 1, 1.0, "u", 0), ("a", 2, None, None, 1), ("b", 3, 5.0, "v", 2), (None, 4, 7.0, "v", 3), ("b", 5, None, "u", 4)]
    return spark.createDataFrame(rows, "g string, k int, x double, s string, ord long")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_aggregate_leaves_null_groups_out(holes):
    assert rows(t.aggregate(holes, "sum", ["g"], ["x"])) == [("a", 1.0), ("b", 5.0)]
    assert rows(t.aggregate(holes.where("x is null"), "sum", None, ["x"])) == [("sum", 0.0)]
    assert rows(t.aggregate(holes, "auc", ["g"], ["x"], "k")) == [("a", None), ("b", None)]
    with pytest.raises(t.OperatorError):
        t.aggregate(holes.select("g", "s"), "sum", ["g"])


def test_auc(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 2.0), (4.0, 2.0), (3.0, None)], "t double, y double")
    assert rows(t.aggregate(df, "auc", None, ["y"], "t")) == [("auc", 5.0)]


def test_fill(holes):
    assert [r["x"] for r in t.fill_missing(holes, "forward", ["x"], order_by=["ord"]).orderBy("ord").collect()] == [1.0, 1.0, 5.0, 7.0, 7.0]
    assert [r["x"] for r in t.fill_missing(holes, "back", ["x"], order_by=["ord"]).orderBy("ord").collect()] == [1.0, 5.0, 5.0, 7.0, None]
    assert [r["s"] for r in t.fill_missing(holes, "mode", ["s"]).orderBy("ord").collect()] == ["u", "u", "v", "v", "u"]
    assert [r["x"] for r in t.fill_missing(holes, "constant", ["x"], "none").orderBy("ord").collect()][1] == "none"
    assert t.fill_missing(holes, "drop", ["g"]).count() == 4


def test_title_zfill_extract(spark):
    df = spark.createDataFrame([("foo-bar o'neil x2y",), ("-5",), (" pad ",), ("",), (None,)], "s string")
    assert [r["s"] for r in t.string_column(df, "s", "title").collect()] == ["Foo-Bar O'Neil X2Y", "-5", " Pad ", "", "Nan"]
    assert [r["s"] for r in t.string_column(df, "s", "zfill").collect()][1] == "-005"
    assert [r["s"] for r in t.string_column(df, "s", "extract", r"\d").collect()] == ["2", "5", None, None, None]
    assert [r["r_left"] for r in t.string_column(df, "s", "split", "-", result="r").collect()][:2] == ["foo", ""]


def test_cast(spark):
    df = spark.createDataFrame([("2.5",), ("x",), ("nan",), ("false",), (None,)], "s string")
    assert [r["s"] for r in t.cast_columns(df, ["s"], "int").collect()] == [2, None, None, None, None]
    assert [r["s"] for r in t.cast_columns(df, ["s"], "bool").collect()] == [True, True, False, False, False]
    assert [r["s"] for r in t.cast_columns(df, ["s"], "str").collect()][4] == "nan"


def test_duplicates_and_top(holes):
    both = t.drop_duplicates(holes, ["g"], "last", ["ord"])
    assert sorted(r["ord"] for r in both["unique"].collect()) == [1, 3, 4] and both["dropped"].count() == 2
    top = t.top_n(holes, "x", 4, True, ["ord"])
    assert [r["ord"] for r in top["top_n"].collect()] == [3, 2, 0, 1] and [r["ord"] for r in top["rest"].collect()] == [4]


def test_sample_is_exact_and_reproducible(holes):
    a, b = t.random_sample(holes, 3, 5, ["ord"]), t.random_sample(holes.repartition(3), 3, 5, ["ord"])
    assert rows(a["sampled"]) == rows(b["sampled"]) and a["sampled"].count() == 3 and a["rest"].count() == 2


def test_joins_match_missing_keys(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(None, "z"), (3, "w")], "k int, v string")
    assert rows(t.join_tables(a, b, "k", how="outer")) == sorted([(None, "y", "z"), (1, "x", None), (3, None, "w")], key=str)


def test_concat_types_and_reference_rows(spark, holes):
    a, b = spark.createDataFrame([(1,)], "v int"), spark.createDataFrame([("x",)], "v string")
    assert rows(t.concat_rows(a, b)) == [("1",), ("x",)]
    assert rows(t.blank_subtract(holes, "g", "zz", ["x"]).select("ord", "x")) == rows(holes.select("ord", "x"))
    assert rows(t.row_normalize(holes, "g", "b", ["x"]).where("ord = 3").select("x")) == [(1.4,)]
    with pytest.raises(Exception, match="division by zero"):
        t.two_table_math(a, spark.createDataFrame([(0,)], "w int"), "/").collect()


def test_group_normalize_with_map(holes):
    got = {r["ord"]: r["x"] for r in t.group_normalize(holes, "g", {"a": "b"}, ["x"]).collect()}
    assert got == {0: 0.2, 1: None, 2: 5.0, 3: 7.0, 4: None}
