"""Queries of the tabular core, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tabular as t
from .registry import query, table


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_quantity > 30 AND l_returnflag = 'R') OR l_linestatus NOT IN ('O', 'F') OR l_discount > (SELECT avg(l_discount) + 0.04 FROM lineitem)")
def filter_expression(spark, d):
    li = table(spark, d, "lineitem")
    li = t.filter_rows(li, "l_quantity > 30 and l_returnflag == 'R' or l_linestatus not in ['O', 'F'] or l_discount > l_discount.mean() + 0.04")
    return li.select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue, ln(l_quantity) AS lq FROM lineitem")
def math_column(spark, d):
    li = t.math_column(table(spark, d, "lineitem"), "revenue = l_extendedprice * (1 - l_discount)")
    return t.math_column(li, "lq = @np.log(l_quantity)").select("l_orderkey", "l_linenumber", "revenue", "lq")


def _aggregates():
    sql = {"sum": "sum({})", "mean": "avg({})", "median": "median({})", "min": "min({})", "max": "max({})", "count": "count({})", "std": "stddev_samp({})", "var": "var_samp({})"}
    for name, form in sql.items():
        one, two = (f"round({form.format(c)}, 4)" for c in ("l_quantity", "l_extendedprice"))

        def run(spark, d, name=name):
            out = t.aggregate(table(spark, d, "lineitem"), name, ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"])
            return out.select("l_returnflag", "l_linestatus", *(F.round(c, 4).alias(c) if name != "count" else F.col(c) for c in ("l_quantity", "l_extendedprice")))

        query(f"SELECT l_returnflag, l_linestatus, {one} AS l_quantity, {two} AS l_extendedprice FROM lineitem GROUP BY 1, 2", f"aggregate_{name}")(run)


_aggregates()


@query("SELECT 'mean' AS stat, avg(o_totalprice) AS o_totalprice FROM orders")
def aggregate_no_group(spark, d):
    return t.aggregate(table(spark, d, "orders"), "mean", None, ["o_totalprice"])


@query("""SELECT user_id, round(sum((x - px) * (y + py) / 2), 3) AS value FROM (
  SELECT user_id, event_id AS x, value AS y, lag(event_id) OVER w AS px, lag(value) OVER w AS py FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) GROUP BY user_id""")
def aggregate_auc(spark, d):
    out = t.aggregate(table(spark, d, "events"), "auc", ["user_id"], ["value"], "event_id")
    return out.withColumn("value", F.round("value", 3))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def rename_group(spark, d):
    return t.rename_group(table(spark, d, "orders"), "o_orderstatus", {"F": "done", "O": "open"}).select("o_orderkey", "o_orderstatus")


@query("""SELECT c_custkey, try_cast(c_mktsegment AS DOUBLE) AS c_mktsegment, CAST(round_even(c_acctbal, 0) AS BIGINT) AS c_acctbal, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer""")
def type_cast(spark, d):
    c = table(spark, d, "customer")
    c = t.cast_columns(t.cast_columns(t.cast_columns(c, ["c_mktsegment"], "float"), ["c_acctbal"], "int"), ["c_nationkey"], "str")
    return c.select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")


@query("""SELECT p_partkey, upper(p_name) AS up, replace(p_brand, 'Brand', 'B') AS short, CASE WHEN regexp_matches(p_brand, '#(\\d)') THEN regexp_extract(p_brand, '#(\\d)', 1) END AS digit,
  CASE WHEN length(CAST(p_size AS VARCHAR)) >= 4 THEN CAST(p_size AS VARCHAR) ELSE lpad(CAST(p_size AS VARCHAR), 4, '0') END AS padded,
  split_part(p_type, ' ', 1) AS kind_left FROM part""")
def string_operations(spark, d):
    p = t.string_column(table(spark, d, "part"), "p_name", "upper", result="up")
    p = t.string_column(p, "p_brand", "replace", "Brand", "B", "short")
    p = t.string_column(p, "p_brand", "extract", r"#(\d)", result="digit", use_regex=True)
    p = t.string_column(p, "p_size", "zfill", result="padded")
    p = t.string_column(p, "p_type", "split", result="kind")
    return p.select("p_partkey", "up", "short", "digit", "padded", "kind_left")


@query("SELECT l_orderkey, l_linenumber, name AS \"Group\", v AS \"Value\" FROM lineitem UNPIVOT (v FOR name IN (l_quantity, l_discount, l_tax))")
def reshape_long(spark, d):
    return t.melt(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"), ["l_orderkey", "l_linenumber"])


@query("""SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS "F", round(avg(l_quantity) FILTER (l_linestatus = 'O'), 6) AS "O" FROM lineitem GROUP BY 1""")
def reshape_wide(spark, d):
    out = t.pivot(table(spark, d, "lineitem"), ["l_returnflag"], "l_linestatus", "l_quantity")
    return out.select("l_returnflag", *(F.round(c, 6).alias(c) for c in ("F", "O")))


@query("""SELECT max(v) FILTER (g = 'ASIA') AS "ASIA", max(v) FILTER (g = 'EUROPE') AS "EUROPE" FROM (
  SELECT r_name AS g, n_name AS v, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS k FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')) GROUP BY k""")
def collect_by_group(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.collect_by_group(n, "r_name", "n_name", ["n_nationkey"], ["ASIA", "EUROPE"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC")
def sort_table(spark, d):
    return t.sort_rows(table(spark, d, "orders"), ["o_totalprice", "o_orderkey"], True).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_n(spark, d):
    return t.top_n(table(spark, d, "orders"), "o_totalprice", 20, True, ["o_orderkey"])["top_n"].select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS r FROM orders) WHERE r > 20")
def top_n_rest(spark, d):
    return t.top_n(table(spark, d, "orders"), "o_totalprice", 20, False, ["o_orderkey"])["rest"].select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_type FROM part WHERE lower(p_type) LIKE 'standard%' OR lower(p_type) = 'promo'")
def split_matched(spark, d):
    return t.split_by_value(table(spark, d, "part"), "p_type", ["STANDARD*", "promo"], False)["matched"].select("p_partkey", "p_type")


@query("SELECT p_partkey, p_type FROM part WHERE NOT (lower(p_type) LIKE 'standard%' OR lower(p_type) = 'promo')")
def split_rest(spark, d):
    return t.split_by_value(table(spark, d, "part"), "p_type", ["STANDARD*", "promo"], False)["rest"].select("p_partkey", "p_type")


@query("SELECT l_orderkey, l_quantity, l_returnflag, l_linestatus FROM lineitem")
def select_glob(spark, d):
    return t.select_columns(table(spark, d, "lineitem"), ["l_orderkey", "l_q*", "l_*flag", "l_*status"])


@query("SELECT * EXCLUDE (c_name, c_nationkey) FROM customer")
def select_drop(spark, d):
    return t.select_columns(table(spark, d, "customer"), ["c_n*"], True)


@query("SELECT (SELECT p_retailprice FROM part ORDER BY p_partkey LIMIT 1) AS left_value, (SELECT s_acctbal FROM supplier ORDER BY s_suppkey LIMIT 1) AS right_value, 'p_retailprice / s_acctbal' AS operation, (SELECT p_retailprice FROM part ORDER BY p_partkey LIMIT 1) / (SELECT s_acctbal FROM supplier ORDER BY s_suppkey LIMIT 1) AS result")
def two_table_math(spark, d):
    return t.two_table_math(table(spark, d, "part"), table(spark, d, "supplier"), "/", "p_retailprice", "s_acctbal", (["p_partkey"], ["s_suppkey"]))


@query("SELECT p_name FROM (SELECT p_name, row_number() OVER (ORDER BY p_partkey) AS r FROM part) WHERE r = 7")
def extract_object(spark, d):
    return t.extract_object(table(spark, d, "part"), "p_name", 7, ["p_partkey"])


@query()
def random_sample(spark, d):
    return t.random_sample(table(spark, d, "orders"), 100, 42, ["o_orderkey"])["sampled"]


@query("SELECT s_suppkey AS k, s_name AS n, s_acctbal AS b, NULL::VARCHAR AS m FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def concat_vertical(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey AS k", "s_name AS n", "s_acctbal AS b")
    return t.concat_rows(s, table(spark, d, "customer").selectExpr("c_custkey AS k", "c_name AS n", "c_acctbal AS b", "c_mktsegment AS m"))


@query("SELECT s_suppkey AS k, s_name AS n FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def concat_common(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey AS k", "s_name AS n", "s_acctbal AS b")
    return t.concat_rows(s, table(spark, d, "customer").selectExpr("c_custkey AS k", "c_name AS n"), False)


@query("SELECT coalesce(s_suppkey, c_custkey) AS k, s_name, c_name FROM supplier FULL JOIN customer ON s_suppkey = c_custkey")
def concat_horizontal(spark, d):
    return t.concat_columns(table(spark, d, "supplier").selectExpr("s_suppkey AS k", "s_name"), table(spark, d, "customer").selectExpr("c_custkey AS k", "c_name"), "k")


def _joins():
    """Whole orders with whole customer: every key, odd and hot ones too."""
    for how, word in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):

        def run(spark, d, how=how):
            o = table(spark, d, "orders").selectExpr("o_custkey AS k", "o_orderkey", "o_totalprice AS v")
            return t.join_tables(o, table(spark, d, "customer").selectExpr("c_custkey AS k", "c_acctbal AS v"), "k", "", how)

        query(f"SELECT coalesce(o_custkey, c_custkey) AS k, o_orderkey, o_totalprice AS v_x, c_acctbal AS v_y FROM orders {word} customer ON o_custkey IS NOT DISTINCT FROM c_custkey", f"join_{how}")(run)


_joins()

_HOLES = "SELECT event_id, user_id, CASE WHEN event_id % 7 <> 3 THEN value END AS value, CASE WHEN event_id % 5 <> 1 THEN event_type END AS event_type FROM events"


def _holes(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", F.when(F.col("event_id") % 7 != 3, F.col("value")).alias("value"), F.when(F.col("event_id") % 5 != 1, F.col("event_type")).alias("event_type"))


@query(f"SELECT * FROM ({_HOLES}) WHERE value IS NOT NULL AND event_type IS NOT NULL")
def missing_drop(spark, d):
    return t.fill_missing(_holes(spark, d), "drop")


@query(f"SELECT event_id, user_id, coalesce(value, 1.5) AS value, coalesce(event_type, '1.5') AS event_type FROM ({_HOLES})")
def fill_constant(spark, d):
    return t.fill_missing(_holes(spark, d), "constant", ["value", "event_type"], "1.5")


def _fills():
    for name, sql in (("mean", "avg(value)"), ("median", "median(value)")):

        def run(spark, d, name=name):
            return t.fill_missing(_holes(spark, d), name, ["value"]).select("event_id", F.round("value", 6).alias("value"))

        query(f"WITH h AS ({_HOLES}) SELECT event_id, round(coalesce(value, (SELECT {sql} FROM h)), 6) AS value FROM h", f"fill_{name}")(run)
    for name, frame in (("forward", "last_value({0} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id)"), ("back", "first_value({0} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")):

        def run(spark, d, name=name):
            return t.fill_within(_holes(spark, d), name, ["value", "event_type"], ["user_id"], ["event_id"])

        query(f"SELECT event_id, user_id, {frame.format('value')} AS value, {frame.format('event_type')} AS event_type FROM ({_HOLES})", f"fill_{name}")(run)


_fills()


@query(f"WITH h AS ({_HOLES}), m AS (SELECT event_type FROM h WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1) SELECT event_id, coalesce(event_type, (SELECT event_type FROM m)) AS event_type FROM h")
def fill_mode(spark, d):
    return t.fill_missing(_holes(spark, d), "mode", ["event_type"]).select("event_id", "event_type")


def _norms():
    forms = {
        "minmax": "(l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ())",
        "zscore": "(l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER ()",
        "log10": "log10(l_quantity + 1)", "log2": "log2(l_quantity + 1)", "ln": "ln(l_quantity + 1)",
        "robust": "(l_quantity - (SELECT median(l_quantity) FROM lineitem)) / (SELECT quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) FROM lineitem)",
    }
    for name, form in forms.items():

        def run(spark, d, name=name):
            out = t.normalize(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), name, ["l_quantity"])
            return out.withColumn("l_quantity_norm", F.round("l_quantity_norm", 8))

        query(f"SELECT l_orderkey, l_linenumber, l_quantity, round({form}, 8) AS l_quantity_norm FROM lineitem", f"normalize_{name}")(run)


_norms()


@query("SELECT event_id, event_type, round(value / m, 8) AS value FROM events LEFT JOIN (SELECT avg(value) AS m FROM events WHERE event_type = 'view') ON true")
def group_normalize(spark, d):
    out = t.group_normalize(table(spark, d, "events").select("event_id", "event_type", "value"), "event_type", "view", ["value"])
    return out.withColumn("value", F.round("value", 8))


@query("SELECT n_nationkey, n_name, n_regionkey - (SELECT n_regionkey FROM nation WHERE n_name = 'NATION_3')::DOUBLE AS n_regionkey FROM nation")
def blank_subtract(spark, d):
    return t.blank_subtract(table(spark, d, "nation"), "n_name", "NATION_3", ["n_regionkey"])


@query("SELECT s_suppkey, s_name, round(s_acctbal / (SELECT s_acctbal FROM supplier WHERE s_suppkey = 3), 8) AS s_acctbal FROM supplier")
def row_normalize(spark, d):
    return t.row_normalize(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), "s_suppkey", "3", ["s_acctbal"]).withColumn("s_acctbal", F.round("s_acctbal", 8))


@query("SELECT event_type, count(*) AS count, round_even(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM events GROUP BY 1")
def value_counts(spark, d):
    return t.value_counts(table(spark, d, "events"), "event_type", True)


def _duplicates():
    for keep, test in (("first", "row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) = 1"), ("last", "row_number() OVER (PARTITION BY lang, source ORDER BY doc_id DESC) = 1"), ("none", "count(*) OVER (PARTITION BY lang, source) = 1")):

        def run(spark, d, keep=keep):
            return t.drop_duplicates(table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], keep, ["doc_id"])["unique"]

        query(f"SELECT doc_id, lang, source FROM documents QUALIFY {test}", f"duplicates_{keep}")(run)


_duplicates()


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) > 1")
def duplicates_dropped(spark, d):
    return t.drop_duplicates(table(spark, d, "documents").select("doc_id", "source"), ["source"], "first", ["doc_id"])["dropped"]


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'view')")
def drop_rows(spark, d):
    return t.drop_rows(table(spark, d, "events").select("event_id", "event_type"), "event_type", ["click", " view "])


@query("SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'X' ELSE r_name END AS r_name FROM region")
def edit_cells(spark, d):
    return t.edit_cells(table(spark, d, "region"), "r_regionkey", [(1, "r_name", "X")])


@query("SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders")
def script(spark, d):
    return t.run_script([table(spark, d, "orders")], lambda o: o.select("o_orderkey", (F.col("o_totalprice") * 2).alias("doubled")))["out_1"]
