"""Queries of figure tables, models, images, molecules, screening and windows over time, with SQL where it can tell."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import streaming
from ..operators import figures, images, models, molecules, screening
from . import graph
from .analysis_queries import _rounded
from .registry import query, table


def _bars():
    for error, form in (("se", "stddev_samp(value) / sqrt(count(*))"), ("sd", "stddev_samp(value)")):

        def run(spark, d, error=error):
            return _rounded(figures.bars(table(spark, d, "events"), "value", "event_type", error), 6)

        query(f'SELECT event_type AS "group", count(*) AS n, round(avg(value), 6) AS mean, round({form}, 6) AS error FROM events GROUP BY 1', f"bars_{error}")(run)


_bars()


@query('SELECT l_linenumber AS x, l_returnflag AS "group", count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_samp(l_quantity) / sqrt(count(*)), 6) AS sem FROM lineitem GROUP BY 1, 2')
def lines(spark, d):
    return _rounded(figures.lines(table(spark, d, "lineitem"), "l_linenumber", "l_quantity", "l_returnflag"), 6)


@query("""WITH s AS (SELECT event_type AS g, count(*) AS n, quantile_cont(value, 0.25) AS q1, median(value) AS m, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT g AS "group", n, round(q1, 6) AS q1, round(m, 6) AS median, round(q3, 6) AS q3, min(value) FILTER (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)) AS whisker_low,
max(value) FILTER (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)) AS whisker_high, CAST(count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS outliers FROM s JOIN events ON g = event_type GROUP BY ALL""")
def boxes(spark, d):
    out = figures.boxes(table(spark, d, "events"), "value", "event_type")
    return _rounded(out, 6, "whisker_low", "whisker_high")


@query("""WITH s AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem) SELECT CAST(least(9, floor((l_quantity - a) / ((b - a) / 10))) AS INTEGER) AS bin, count(*) AS count FROM lineitem, s GROUP BY 1""")
def histogram(spark, d):
    return figures.histogram(table(spark, d, "lineitem"), "l_quantity", 10).select("bin", "count")


@query("SELECT l_returnflag AS \"group\", count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem GROUP BY 1")
def regression_line(spark, d):
    out = figures.regression_line(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")
    return out.select("group", "n", F.round("slope", 5).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query("""WITH m AS (SELECT l_returnflag AS g, unnest(['l_quantity', 'l_discount', 'l_tax']) AS metric, unnest([avg(l_quantity), avg(l_discount), avg(l_tax)]) AS v FROM lineitem GROUP BY 1)
SELECT g AS "group", metric, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w), 6) AS value FROM m WINDOW w AS (PARTITION BY metric)""")
def radar(spark, d):
    return _rounded(figures.radar(table(spark, d, "lineitem"), "l_returnflag", ["l_quantity", "l_discount", "l_tax"]), 6)


@query("SELECT CAST(floor((value * 7 - 360 * floor(value * 7 / 360)) / 10) AS INTEGER) AS bin, count(*) AS count FROM events GROUP BY 1")
def angles(spark, d):
    ev = table(spark, d, "events").withColumn("a", F.col("value") * 7)
    return figures.angles(ev, "a", 36).select("bin", "count")


@query("SELECT c_mktsegment AS row, 'c_acctbal' AS \"column\", round(avg(c_acctbal), 6) AS value FROM customer GROUP BY 1")
def heatmap(spark, d):
    return _rounded(figures.heatmap(table(spark, d, "customer"), "c_mktsegment", ["c_acctbal"]), 6)


@query()
def density(spark, d):
    return figures.density(table(spark, d, "lineitem"), "l_quantity", 64)


# Models


@query("""WITH s AS (SELECT count(*) AS n, sum((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) ** 2) AS a, sum((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) * l_extendedprice) AS b, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem)
SELECT round(b / (a + 10), 4) AS slope, round(my - mx * b / (a + 10), 2) AS intercept FROM s""")
def ridge(spark, d):
    m = models.fit_regressor(table(spark, d, "lineitem"), "ridge", "l_extendedprice", ["l_quantity"], alpha=10.0)
    return spark.createDataFrame([(round(m.linear["l_quantity"], 4), round(m.linear["intercept"], 2))], "slope double, intercept double")


@query("SELECT round(1 + abs(corr(l_quantity, l_extendedprice)), 6) AS eigenvalue, 'pc1' AS component FROM lineitem UNION ALL SELECT round(1 - abs(corr(l_quantity, l_extendedprice)), 6), 'pc2' FROM lineitem")
def pca(spark, d):
    return _rounded(models.pca(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])["variance"].select("eigenvalue", "component"), 6)


def _vector_columns(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", (F.col("label") % 2).cast("string").alias("side"), *(F.col("embedding")[k].cast("double").alias(f"x{k}") for k in range(6)))


def _models():
    for kind in ("naive_bayes", "lda", "qda", "ridge", "logistic_regression", "decision_tree"):

        def run(spark, d, kind=kind):
            rows = _vector_columns(spark, d)
            out = models.fit_classifier(rows, kind, "side", [f"x{k}" for k in range(6)]).predict(rows)
            return out.select("vec_id", "side", "prediction")

        query(None, f"classifier_{kind}")(run)


_models()


@query()
def k_means(spark, d):
    return models.k_means(_vector_columns(spark, d), [f"x{k}" for k in range(6)], 3)[0].select("vec_id", "cluster")


@query()
def cross_validation(spark, d):
    rows = _vector_columns(spark, d)
    return models.cross_validate(rows, lambda x: models.fit_classifier(x, "lda", "side", ["x0", "x1"]), "side", ["vec_id"], 3)


# Images: a vector of 64 numbers as an image of 8 by 8


def _pictures(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("key"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.lit(1).alias("c"), F.transform("embedding", lambda x: x.cast("double")).alias("pixels"))


@query("SELECT vec_id::VARCHAR AS key, 0 AS ch, 64 AS n, round(list_avg(embedding::DOUBLE[]), 8) AS mean, round(list_stddev_pop(embedding::DOUBLE[]), 8) AS std, list_min(embedding::DOUBLE[]) AS min, list_max(embedding::DOUBLE[]) AS max, round(list_median(embedding::DOUBLE[]), 8) AS median FROM embeddings")
def image_statistics(spark, d):
    return _rounded(images.image_statistics(_pictures(spark, d)), 8, "min", "max")


@query("SELECT vec_id::VARCHAR AS key, 0 AS ch, CAST(least(7, floor((x + 1) / 2 * 8)) AS INTEGER) AS bin, count(*) AS count FROM (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x FROM embeddings) WHERE x BETWEEN -1 AND 1 GROUP BY 1, 3")
def image_histogram(spark, d):
    return images.histogram(_pictures(spark, d), 8, -1.0, 1.0)


@query("SELECT vec_id::VARCHAR AS key, CAST(list_sum(list_transform(embedding, lambda x: CASE WHEN x >= 0.05 THEN 1 ELSE 0 END)) AS DOUBLE) AS area FROM embeddings")
def image_threshold(spark, d):
    out = images.threshold(_pictures(spark, d), 0.05)
    return out.select("key", F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x).alias("area"))


@query()
def image_regions(spark, d):
    return images.region_properties(images.label_regions(images.threshold(_pictures(spark, d), 0.05), 8), _pictures(spark, d))


@query()
def image_texture(spark, d):
    return images.glcm(images.brightness_contrast(_pictures(spark, d), -0.5, 0.5), 1, 8)


def _filters():
    for name, f in (("gaussian", lambda x: images.gaussian(x, 1.0)), ("sobel", lambda x: images.edges(x, "sobel")), ("opening", lambda x: images.morphology(images.threshold(x, 0.0), "open")), ("ring", lambda x: images.distance_ring(images.threshold(x, 0.2), 1.5))):

        def run(spark, d, f=f):
            return f(_pictures(spark, d))

        query(None, f"image_{name}")(run)


_filters()


# Molecule tables, boxes, screening


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice <= 1200")
def property_filter(spark, d):
    return molecules.property_filter(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "<=", 1200)["matches"]


@query("SELECT p_partkey FROM part WHERE NOT (p_retailprice <= 500 AND p_size % 8 <= 5 AND p_size % 6 <= 5 AND p_size <= 10)")
def drug_likeness_rejects(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey", "p_retailprice AS mol_weight", "p_size % 8 AS logp", "p_size % 6 AS h_donors", "p_size AS h_acceptors")
    return molecules.drug_likeness(p, "lipinski")["rejects"].select("p_partkey")


@query("SELECT min(l_quantity) / 2 + max(l_quantity) / 2 AS center_x, (min(l_discount) + max(l_discount)) / 2 AS center_y, (min(l_tax) + max(l_tax)) / 2 AS center_z, max(l_quantity) - min(l_quantity) + 10 AS size_x, max(l_discount) - min(l_discount) + 10 AS size_y, max(l_tax) - min(l_tax) + 10 AS size_z FROM lineitem")
def docking_box(spark, d):
    return molecules.docking_box(table(spark, d, "lineitem").selectExpr("l_quantity AS x", "l_discount AS y", "l_tax AS z"))


@query("SELECT s_suppkey AS name, s_acctbal AS v FROM supplier UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def table_merge(spark, d):
    a, b = table(spark, d, "supplier").selectExpr("s_suppkey AS name", "s_acctbal AS v"), table(spark, d, "customer").selectExpr("c_custkey AS name", "c_acctbal AS v")
    return molecules.merge(a, b, "OR")


@query()
def screening_rank(spark, d):
    e = table(spark, d, "events").selectExpr("event_type AS `group`", "user_id AS file_stem", "event_id AS cell", "value AS a", "value * value AS b")
    return screening.rank_combinations(e, ["a", "b"], "click", "view", 4, 3)


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = streaming.windowed(e, "ts", "1 day", ["event_type"], "value")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM i GROUP BY user_id, k""")
def session_windows(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streaming.sessions(e, "ts", "6 hours", ["user_id"]).select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query("SELECT l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R' GROUP BY 1 ORDER BY revenue DESC LIMIT 5")
def operator_graph(spark, d):
    """A chain of operators declared as a graph: filter, formula, aggregate, top."""
    g = {
        "some": {"op": "tabular.filter_rows", "inputs": ["lineitem"], "params": {"query": "l_quantity > 30 and l_returnflag == 'R'"}},
        "priced": {"op": "tabular.math_column", "inputs": ["some"], "params": {"formula": "revenue = l_extendedprice * (1 - l_discount)"}},
        "summed": {"op": "tabular.aggregate", "inputs": ["priced"], "params": {"operation": "sum", "group_by": ["l_linestatus"], "columns": ["revenue"]}},
        "best": {"op": "tabular.top_n", "inputs": ["summed"], "params": {"column": "revenue", "n": 5, "order_by": ["l_linestatus"]}},
    }
    return graph.run(g, {"lineitem": table(spark, d, "lineitem")})["best"]["top_n"].withColumn("revenue", F.round("revenue", 2))
