import duckdb
import pandas as pd

from labquarry.llm import quotes

ROWS = [
    (1, 0, "user", "Hello there\nsecond line\n\nBye now"),
    (1, 1, "assistant", "> hello   there\n> second line\nI agree."),
    (1, 2, "user", "On Monday x wrote:\n> > Hello there\n> I agree.\nThanks"),
    (1, 3, "assistant", "> nothing known\nok"),
    (1, 4, "user", "> Thanks\n>> I agree.\n"),
    (2, 0, "user", None),
    (2, 1, "user", ""),
    (2, 2, "user", "> \n>\n x"),
    (3, 0, "user", "a > b is no quote\n" + "word " * 20000),
    (3, 1, "user", "> a > b is no quote"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(df):
    return sorted(tuple(None if pd.isna(x) else x if isinstance(x, str) else int(x) for x in r) for r in df.itertuples(index=False))


def test_like_sql(spark):
    got = quotes.threads(spark.createDataFrame(ROWS, SCHEMA)).toPandas()
    conversations = pd.DataFrame(ROWS, columns=["conv_id", "turn", "role", "text"])  # noqa: F841
    assert plain(got) == plain(duckdb.sql(quotes.OP1_SQL).df()[list(got.columns)].astype(object))


def test_nulls_repeats_and_other_columns(spark):
    rows = [(None, 0, "u", "> x", 1), (1, None, "u", "x", 1), (1, 0, "u", "x", 2), (1, 0, "u", "x", 2), (1, 1, None, "> x", 3)]
    got = quotes.threads(spark.createDataFrame(rows, SCHEMA + ", position int")).toPandas()
    assert len(got) == 5
    kept = got[got["position"].notna()]
    assert sorted(kept["position"]) == [0, 1, 2] and (kept["root_turn"] == 0).all()
    assert quotes.threads(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_chain(spark):
    rows = [(7, k, "u", f"line {k}" + (f"\n> line {k - 1}" if k else "")) for k in range(40)]
    got = quotes.threads(spark.createDataFrame(rows, SCHEMA)).toPandas().set_index("turn")
    assert (got["depth"] == got.index).all() and (got["root_turn"] == 0).all() and (got["position"] == got.index).all()
