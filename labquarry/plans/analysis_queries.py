"""Queries of statistics, evaluation, tracking and neighbours, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as e
from ..operators import neighbours as n
from ..operators import statistics as s
from ..operators import tracking as tr
from .registry import query, table


def _rounded(df, places, *keep):
    return df.select(*(F.round(c, places).alias(c) if t in ("double", "float") and c not in keep else F.col(c) for c, t in df.dtypes))


@query("""SELECT l_returnflag AS "group", 'l_quantity' AS "column", count(*) AS n, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS median, round(stddev_samp(l_quantity), 6) AS std,
  min(l_quantity) AS min, max(l_quantity) AS max, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3, round(skewness(l_quantity), 6) AS skewness, round(kurtosis(l_quantity), 6) AS kurtosis
  FROM lineitem GROUP BY 1""")
def descriptive_statistics(spark, d):
    out = s.describe(table(spark, d, "lineitem"), ["l_quantity"], "l_returnflag")
    return _rounded(out.select("group", "column", "n", "mean", "median", "std", "min", "max", "q1", "q3", "skewness", "kurtosis"), 6)


@query("""SELECT unnest(['count', 'mean', 'std', 'min', '25%', '50%', '75%', 'max']) AS stat,
  unnest([count(o_totalprice), round(avg(o_totalprice), 4), round(stddev_samp(o_totalprice), 4), min(o_totalprice), round(quantile_cont(o_totalprice, 0.25), 4), round(quantile_cont(o_totalprice, 0.5), 4), round(quantile_cont(o_totalprice, 0.75), 4), max(o_totalprice)]) AS o_totalprice FROM orders""")
def data_summary(spark, d):
    return _rounded(s.summary(table(spark, d, "orders"), ["o_totalprice"]), 4)


_MOMENTS = "SELECT event_type AS g, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1"


@query(f"""WITH g AS ({_MOMENTS}), t AS (SELECT count(*) AS groups, sum(n) AS n, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS b, sum((n - 1) * v) AS w FROM g)
SELECT groups, CAST(n AS BIGINT) AS n, round(b / (groups - 1) / (w / (n - groups)), 6) AS f FROM t""")
def anova_f(spark, d):
    return _rounded(s.anova(table(spark, d, "events"), "value", "event_type").select("groups", "n", "f"), 6)


@query("""WITH r AS (SELECT event_type AS g, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY value) AS t FROM events),
g AS (SELECT g, count(*) AS n, sum(r) AS r, sum(t * t - 1) AS t FROM r GROUP BY 1), a AS (SELECT count(*) AS groups, sum(n)::DOUBLE AS n, sum(r * r / n) AS s, sum(t) AS t FROM g)
SELECT groups, CAST(n AS BIGINT) AS n, round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (n ** 3 - n)), 6) AS h FROM a""")
def kruskal_h(spark, d):
    return _rounded(s.kruskal(table(spark, d, "events"), "value", "event_type").select("groups", "n", "h"), 6)


@query("""WITH x AS (SELECT event_type AS g, abs(value - median(value) OVER (PARTITION BY event_type)) AS z FROM events), g AS (SELECT g, count(*) AS n, avg(z) AS m, var_samp(z) AS v FROM x GROUP BY 1),
t AS (SELECT count(*) AS groups, sum(n) AS n, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS b, sum((n - 1) * v) AS w FROM g) SELECT groups, round(b / (groups - 1) / (w / (n - groups)), 6) AS f FROM t""")
def levene_f(spark, d):
    return _rounded(s.levene(table(spark, d, "events"), "value", "event_type").select("groups", "f"), 6)


@query(f"""WITH g AS ({_MOMENTS}), t AS (SELECT count(*) AS k, sum(n) - count(*) AS r, sum((n - 1) * v) AS a, sum((n - 1) * ln(v)) AS b, sum(1.0 / (n - 1)) AS c FROM g)
SELECT round((r * ln(a / r) - b) / (1 + (c - 1.0 / r) / (3 * (k - 1))), 6) AS statistic FROM t""")
def bartlett_statistic(spark, d):
    return _rounded(s.bartlett(table(spark, d, "events"), "value", "event_type").select("statistic"), 6)


def _pairwise():
    forms = {
        "welch": "(a.m - b.m) / sqrt(a.v / a.n + b.v / b.n)",
        "student": "(a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n))",
        "z": "(a.m - b.m) / sqrt(a.v / a.n + b.v / b.n)",
    }
    for name, form in forms.items():

        def run(spark, d, name=name):
            return _rounded(s.pairwise_t(table(spark, d, "events"), "value", "event_type", name).select("group1", "group2", "statistic"), 6)

        query(f"WITH g AS ({_MOMENTS}) SELECT a.g AS group1, b.g AS group2, round({form}, 6) AS statistic FROM g a JOIN g b ON a.g < b.g", f"pairwise_{name}")(run)


_pairwise()


@query(f"""WITH g AS ({_MOMENTS}), x AS (SELECT a.g AS group1, b.g AS group2, (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) AS d, a.n + b.n - 2 AS f, (a.m - b.m) / sqrt(b.v) AS gd FROM g a JOIN g b ON a.g < b.g)
SELECT group1, group2, round(d, 6) AS cohens_d, round(d * (1 - 3 / (4.0 * f - 1)), 6) AS hedges_g, round(gd, 6) AS glass_delta FROM x""")
def effect_sizes(spark, d):
    return _rounded(s.effect_sizes(table(spark, d, "events"), "value", "event_type"), 6)


@query("""WITH e AS (SELECT event_type AS g, value AS v FROM events), p AS (SELECT DISTINCT a.g AS g1, b.g AS g2 FROM e a JOIN (SELECT DISTINCT g FROM e) b ON a.g < b.g),
r AS (SELECT g1, g2, g, rank() OVER (PARTITION BY g1, g2 ORDER BY v) + (count(*) OVER (PARTITION BY g1, g2, v) - 1) / 2.0 AS r FROM p JOIN e ON g = g1 OR g = g2)
SELECT g1 AS group1, g2 AS group2, round(sum(r) FILTER (g = g1) - count(*) FILTER (g = g1) * (count(*) FILTER (g = g1) + 1) / 2.0, 3) AS u FROM r GROUP BY 1, 2""")
def mann_whitney_u(spark, d):
    return _rounded(s.mann_whitney(table(spark, d, "events"), "value", "event_type").select("group1", "group2", "u"), 3)


@query("""WITH e AS (SELECT event_type AS g, value AS v FROM events), p AS (SELECT a.g AS g1, b.g AS g2 FROM (SELECT DISTINCT g FROM e) a JOIN (SELECT DISTINCT g FROM e) b ON a.g < b.g),
c AS (SELECT g1, g2, v, count(*) FILTER (g = g1) AS x, count(*) FILTER (g = g2) AS y FROM p JOIN e ON g = g1 OR g = g2 GROUP BY 1, 2, 3), r AS (SELECT g1, g2, sum(x) OVER w AS x, sum(y) OVER w AS y, sum(x) OVER (PARTITION BY g1, g2) AS a, sum(y) OVER (PARTITION BY g1, g2) AS b FROM c WINDOW w AS (PARTITION BY g1, g2 ORDER BY v))
SELECT g1 AS group1, g2 AS group2, round(max(abs(x / a - y / b)), 8) AS d FROM r GROUP BY 1, 2""")
def kolmogorov_smirnov_d(spark, d):
    return _rounded(s.kolmogorov_smirnov(table(spark, d, "events"), "value", "event_type").select("group1", "group2", "d"), 8)


@query("""WITH k AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS c FROM lineitem GROUP BY 1, 2), r AS (SELECT a, sum(c) AS r FROM k GROUP BY 1), q AS (SELECT b, sum(c) AS q FROM k GROUP BY 1), n AS (SELECT sum(c) AS n FROM k)
SELECT round(sum((coalesce(c, 0) - r * q / n) ** 2 / (r * q / n)), 4) AS chi2, CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS BIGINT) AS df FROM r CROSS JOIN q CROSS JOIN n LEFT JOIN k USING (a, b)""")
def contingency_chi2(spark, d):
    return _rounded(s.contingency(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")["test"].select("chi2", "df"), 4)


_LIVES = "SELECT o_orderpriority AS g, CAST(o_custkey % 40 AS DOUBLE) AS t, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS e FROM orders"


def _lives(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderpriority AS g", "CAST(o_custkey % 40 AS DOUBLE) AS t", "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS e")


@query(f"""WITH k AS (SELECT g, t, sum(e) AS d, count(*) AS c FROM ({_LIVES}) GROUP BY 1, 2), n AS (SELECT *, sum(c) OVER (PARTITION BY g ORDER BY t DESC) AS n FROM k)
SELECT g AS "group", t AS time, CAST(n AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS events, round(product(1 - d / n) OVER (PARTITION BY g ORDER BY t), 8) AS survival FROM n""")
def kaplan_meier(spark, d):
    return _rounded(s.kaplan_meier(_lives(spark, d), "t", "e", "g").select("group", "time", "at_risk", "events", "survival"), 8)


@query(f"""WITH l AS ({_LIVES}), p AS (SELECT DISTINCT a.g AS g1, b.g AS g2 FROM l a JOIN (SELECT DISTINCT g FROM l) b ON a.g < b.g),
c AS (SELECT g1, g2, t, sum(e) AS d, count(*) AS c, sum(e) FILTER (g = g1) AS d1, count(*) FILTER (g = g1) AS c1 FROM p JOIN l ON g = g1 OR g = g2 GROUP BY 1, 2, 3),
n AS (SELECT *, sum(c) OVER w AS n, sum(c1) OVER w AS n1 FROM c WINDOW w AS (PARTITION BY g1, g2 ORDER BY t DESC))
SELECT g1 AS group1, g2 AS group2, CAST(sum(coalesce(d1, 0)) AS BIGINT) AS observed, round(sum(d * n1 / n), 6) AS expected FROM n WHERE d > 0 GROUP BY 1, 2""")
def log_rank(spark, d):
    return _rounded(s.log_rank(_lives(spark, d), "t", "e", "g").select("group1", "group2", "observed", "expected"), 6)


@query("""SELECT unnest(['intercept', 'l_quantity']) AS term, unnest([round(regr_intercept(l_extendedprice, l_quantity), 3), round(regr_slope(l_extendedprice, l_quantity), 5)]) AS coefficient FROM lineitem""")
def linear_regression(spark, d):
    out = s.ols(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice")["coefficients"]
    return out.select("term", F.when(F.col("term") == "intercept", F.round("coefficient", 3)).otherwise(F.round("coefficient", 5)).alias("coefficient"))


@query("""SELECT 'l_quantity' AS a, 'l_discount' AS b, round(corr(l_quantity, l_discount), 8) AS value FROM lineitem UNION ALL SELECT 'l_discount', 'l_quantity', round(corr(l_quantity, l_discount), 8) FROM lineitem
UNION ALL SELECT 'l_quantity', 'l_quantity', 1.0 UNION ALL SELECT 'l_discount', 'l_discount', 1.0""")
def correlation_matrix(spark, d):
    return _rounded(s.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_discount"]), 8)


@query("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS x, rank() OVER (ORDER BY l_tax) + (count(*) OVER (PARTITION BY l_tax) - 1) / 2.0 AS y FROM lineitem)
SELECT 'l_quantity' AS a, 'l_tax' AS b, round(corr(x, y), 8) AS value FROM r UNION ALL SELECT 'l_tax', 'l_quantity', round(corr(x, y), 8) FROM r UNION ALL SELECT 'l_quantity', 'l_quantity', 1.0 UNION ALL SELECT 'l_tax', 'l_tax', 1.0""")
def spearman(spark, d):
    return _rounded(s.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_tax"], "spearman"), 8)


@query("""WITH s AS (SELECT round(sum(abs(l_quantity - l_tax)), 3) AS v FROM lineitem) SELECT 'l_quantity' AS a, 'l_tax' AS b, v AS value FROM s UNION ALL SELECT 'l_tax', 'l_quantity', v FROM s UNION ALL SELECT 'l_quantity', 'l_quantity', 0.0 UNION ALL SELECT 'l_tax', 'l_tax', 0.0""")
def cityblock(spark, d):
    return _rounded(s.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_tax"], "cityblock"), 3)


@query("SELECT l_returnflag AS \"group\", round((CASE WHEN max(l_extendedprice) - avg(l_extendedprice) >= avg(l_extendedprice) - min(l_extendedprice) THEN max(l_extendedprice) - avg(l_extendedprice) ELSE avg(l_extendedprice) - min(l_extendedprice) END) / stddev_samp(l_extendedprice), 6) AS g FROM lineitem GROUP BY 1")
def grubbs_g(spark, d):
    return _rounded(s.grubbs(table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag").select("group", "g"), 6)


@query("SELECT count(*) AS n, round(avg(l_discount - l_tax), 8) AS bias, round(stddev_samp(l_discount - l_tax), 8) AS sd, round(avg(l_discount - l_tax) - 1.96 * stddev_samp(l_discount - l_tax), 8) AS loa_low, round(avg(l_discount - l_tax) + 1.96 * stddev_samp(l_discount - l_tax), 8) AS loa_high FROM lineitem")
def bland_altman(spark, d):
    return _rounded(s.bland_altman(table(spark, d, "lineitem"), "l_discount", "l_tax"), 8)


@query("SELECT l_orderkey, l_linenumber, l_quantity - 25 AS fc, l_discount AS p, -log10(l_discount) AS neg_log10_p FROM lineitem WHERE l_discount > 0 AND abs(l_quantity - 25) >= 10 AND l_discount <= 0.05")
def volcano_significant(spark, d):
    li = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity - 25 AS fc", "l_discount AS p")
    return s.volcano(li, "fc", "p", 10.0, 0.05)


# Evaluation

_PREDICTED = "SELECT quality AS y, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS h, CAST(n_chars AS DOUBLE) AS s FROM labels JOIN documents USING (doc_id)"


def _predicted(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").selectExpr("quality AS y", "CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS h", "CAST(n_chars AS DOUBLE) AS s")


@query(f"WITH p AS ({_PREDICTED}), l AS (SELECT y::VARCHAR AS x FROM p UNION SELECT h::VARCHAR FROM p) SELECT a.x AS true, b.x AS predicted, (SELECT count(*) FROM p WHERE y::VARCHAR = a.x AND h::VARCHAR = b.x)::DOUBLE AS value FROM l a, l b")
def confusion_matrix(spark, d):
    return e.confusion(_predicted(spark, d), "y", "h")


@query(f"""WITH p AS ({_PREDICTED}), l AS (SELECT DISTINCT y AS x FROM p), c AS (SELECT x::VARCHAR AS label, count(*) FILTER (y = x AND h = x) / count(*) FILTER (h = x) AS precision, count(*) FILTER (y = x AND h = x) / count(*) FILTER (y = x) AS recall, CAST(count(*) FILTER (y = x) AS DOUBLE) AS support FROM l, p GROUP BY x)
SELECT label, round(precision, 8) AS precision, round(recall, 8) AS recall, round(2 * precision * recall / (precision + recall), 8) AS f1, support FROM c""")
def classification_report(spark, d):
    return _rounded(e.classification_report(_predicted(spark, d), "y", "h").where("label in ('0', '1')"), 8)


@query(f"""WITH k AS (SELECT s AS score, count(*) FILTER (y = 1) AS a, count(*) FILTER (y <> 1) AS b FROM ({_PREDICTED}) GROUP BY 1)
SELECT score, round(sum(a) OVER w / sum(a) OVER (), 8) AS tpr, round(sum(b) OVER w / sum(b) OVER (), 8) AS fpr FROM k WINDOW w AS (ORDER BY score DESC)""")
def roc_curve(spark, d):
    return _rounded(e.roc_curve(_predicted(spark, d), "y", "s"), 8, "score")


@query(f"""WITH p AS ({_PREDICTED}), x AS (SELECT s FROM p WHERE y = 1), z AS (SELECT s FROM p WHERE y <> 1) SELECT round(avg(CASE WHEN x.s > z.s THEN 1.0 WHEN x.s = z.s THEN 0.5 ELSE 0 END), 8) AS auc FROM x, z""")
def roc_auc(spark, d):
    return _rounded(e.roc_auc(_predicted(spark, d), "y", "s"), 8)


@query(f"""WITH k AS (SELECT s AS score, count(*) FILTER (y = 1) AS a, count(*) AS c FROM ({_PREDICTED}) GROUP BY 1)
SELECT score, round(sum(a) OVER w / sum(c) OVER w, 8) AS precision, round(sum(a) OVER w / sum(a) OVER (), 8) AS recall FROM k WINDOW w AS (ORDER BY score DESC)""")
def pr_curve(spark, d):
    return _rounded(e.pr_curve(_predicted(spark, d), "y", "s"), 8, "score")


@query("SELECT o_orderkey, round(coalesce((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders), 0), 8) AS o_totalprice FROM orders")
def standard_scaler(spark, d):
    return _rounded(e.scale(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"])["scaled"], 8)


@query("SELECT o_orderkey, round((o_totalprice - (SELECT min(o_totalprice) FROM orders)) / (SELECT max(o_totalprice) - min(o_totalprice) FROM orders), 8) AS o_totalprice FROM orders")
def minmax_scaler(spark, d):
    return _rounded(e.scale(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], "minmax")["scaled"], 8)


@query("SELECT o_orderkey, o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS o_orderpriority_encoded FROM orders")
def label_encoder(spark, d):
    return e.label_encode(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"])


@query("SELECT o_orderstatus, CAST(round(count(*) * 0.2) AS BIGINT) AS n FROM orders GROUP BY 1")
def stratified_split(spark, d):
    test = e.train_test_split(table(spark, d, "orders"), ["o_orderkey"], 0.2, 42, "o_orderstatus")["test"]
    return test.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT unnest(['mse', 'rmse', 'mae', 'max_error']) AS metric, unnest([round(avg(x * x), 6), round(sqrt(avg(x * x)), 6), round(avg(abs(x)), 6), max(abs(x))]) AS value FROM (SELECT l_quantity - 25 AS x FROM lineitem)""")
def regression_scores(spark, d):
    li = table(spark, d, "lineitem").selectExpr("l_quantity AS y", "25.0D AS h")
    return _rounded(e.regression_scores(li, "y", "h").where("metric in ('mse', 'rmse', 'mae', 'max_error')"), 6)


@query("""WITH g AS (SELECT event_type AS g, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1), t AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS b, sum((n - 1) * v) AS w FROM g)
SELECT 'value' AS feature, round(b / (k - 1) / (w / (n - k)), 6) AS score FROM t""")
def feature_selection(spark, d):
    return _rounded(e.feature_scores(table(spark, d, "events"), "event_type", ["value"]).select("feature", "score"), 6)


_PSI = "CASE WHEN {m} < 10 THEN coalesce(list_sum(list_transform(range(1, CAST({m} AS BIGINT)), lambda i: 1.0::DOUBLE / i)), 0) - 0.57721566490153286 ELSE ln({m}) - 1 / (2 * {m}::DOUBLE) - 1 / (12 * {m}::DOUBLE ** 2) + 1 / (120 * {m}::DOUBLE ** 4) - 1 / (252 * {m}::DOUBLE ** 6) END"


@query(f"""WITH e AS (SELECT event_type AS g, unnest(['cents', 'user_id']) AS feature, unnest([CAST(floor(value * 100) AS BIGINT), user_id]) AS v FROM events WHERE event_type IS NOT NULL),
c AS (SELECT *, count(*) OVER (PARTITION BY feature, g) AS n FROM e WHERE v IS NOT NULL QUALIFY count(*) OVER (PARTITION BY feature, g) > 1),
d AS (SELECT *, list_sort(list_filter([v - lag(v, 1) OVER w, v - lag(v, 2) OVER w, v - lag(v, 3) OVER w, lead(v, 1) OVER w - v, lead(v, 2) OVER w - v, lead(v, 3) OVER w - v], lambda x: x IS NOT NULL))[least(3, n - 1)] AS r FROM c WINDOW w AS (PARTITION BY feature, g ORDER BY v)),
m AS (SELECT *, count(*) OVER (PARTITION BY feature ORDER BY v RANGE BETWEEN greatest(r - 1, 0) PRECEDING AND greatest(r - 1, 0) FOLLOWING) AS m, CASE WHEN r = 0 THEN count(*) OVER (PARTITION BY feature, g, v) ELSE least(3, n - 1) END AS k FROM d)
SELECT feature, round(greatest(0, {_PSI.format(m='count(*)')} + avg({_PSI.format(m='k')}) - avg({_PSI.format(m='n')}) - avg({_PSI.format(m='m')})), 6) AS score FROM m GROUP BY feature""")
def mutual_information(spark, d):
    df = table(spark, d, "events").selectExpr("event_type", "floor(value * 100) AS cents", "user_id")
    return _rounded(e.feature_scores(df, "event_type", ["cents", "user_id"], "mutual_information").select("feature", "score"), 6)


# Trajectories: users are tracks, and their events in turn the frames

_TRACKS = "SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS frame, value AS centroid_x, CAST(event_id % 50 AS DOUBLE) AS centroid_y FROM events"


def _tracks(spark, d):
    table(spark, d, "events").createOrReplaceTempView("_events")
    return spark.sql(_TRACKS.replace("FROM events", "FROM _events"))


@query(f"""WITH t AS ({_TRACKS}), s AS (SELECT *, sqrt((centroid_x - lag(centroid_x) OVER w) ** 2 + (centroid_y - lag(centroid_y) OVER w) ** 2) AS step FROM t WINDOW w AS (PARTITION BY track_id ORDER BY frame))
SELECT track_id, count(*) AS n_points, min(frame) AS first_frame, max(frame) AS last_frame, round(coalesce(sum(step), 0), 4) AS path_length, round(avg(step), 6) AS mean_speed, round(max(step), 6) AS max_speed,
round(sqrt((arg_max(centroid_x, frame) - arg_min(centroid_x, frame)) ** 2 + (arg_max(centroid_y, frame) - arg_min(centroid_y, frame)) ** 2), 6) AS displacement FROM s GROUP BY 1""")
def track_properties(spark, d):
    out = tr.track_properties(_tracks(spark, d)).drop("straightness")
    return _rounded(out.withColumn("path_length", F.round("path_length", 4)), 6)


@query(f"""WITH t AS ({_TRACKS}), m AS (SELECT greatest(2, CAST(floor(median(n) / 2) AS BIGINT)) AS most FROM (SELECT count(*) AS n FROM t GROUP BY track_id))
SELECT CAST(b.frame - a.frame AS INTEGER) AS lag, round(avg((b.centroid_x - a.centroid_x) ** 2 + (b.centroid_y - a.centroid_y) ** 2), 4) AS msd, count(*) AS n FROM t a JOIN t b ON a.track_id = b.track_id JOIN m ON b.frame - a.frame BETWEEN 1 AND most GROUP BY 1""")
def msd(spark, d):
    return _rounded(tr.mean_squared_displacement(_tracks(spark, d)), 4)


@query(f"WITH t AS ({_TRACKS}) SELECT * FROM t WHERE track_id IN (SELECT track_id FROM t GROUP BY 1 HAVING count(*) >= 60 AND count(*) <= 75)")
def track_filter(spark, d):
    return tr.filter_tracks(_tracks(spark, d), 60, 75)


@query()
def particle_linker(spark, d):
    points = table(spark, d, "events").selectExpr("event_type AS video", "user_id AS frame", "value AS centroid_x", "CAST(event_id % 50 AS DOUBLE) AS centroid_y")
    return tr.link_particles(points, "video", 20.0)


# Neighbours


@query("""WITH q AS (SELECT vec_id AS key, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), t AS (SELECT vec_id AS neighbour, embedding::DOUBLE[] AS w FROM embeddings),
d AS (SELECT key, neighbour, list_distance(v, w) AS distance FROM q, t WHERE key <> neighbour) SELECT key, neighbour, CAST(row_number() OVER (PARTITION BY key ORDER BY distance, neighbour) AS INTEGER) AS rank, round(distance, 6) AS distance FROM d QUALIFY rank <= 5""")
def knn(spark, d):
    v = table(spark, d, "embeddings")
    return n.knn(v, v.where("vec_id % 50 = 0"), "vec_id", "vec_id", "embedding", 5, leave_own=True).withColumn("distance", F.round("distance", 6))


@query("""WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings), p AS (SELECT x.vec_id AS a, y.vec_id AS b, list_dot_product(x.b::DOUBLE[], y.b::DOUBLE[]) AS z, list_sum(x.b) AS m, list_sum(y.b) AS n FROM b x JOIN b y ON x.vec_id < y.vec_id)
SELECT a, b, round(z / (m + n - z), 8) AS similarity FROM p WHERE z / (m + n - z) >= 0.55""")
def similarity_pairs(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", n.bits(F.col("embedding")).alias("fp"))
    return n.similarity_pairs(v, "vec_id", "fp", 64, 0.55).withColumn("similarity", F.round("similarity", 8))


@query("""WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings), o AS (SELECT b AS c FROM b WHERE vec_id = 0), z AS (SELECT vec_id, list_dot_product(b::DOUBLE[], c::DOUBLE[]) AS z, list_sum(b) AS m, list_sum(c) AS n FROM b, o)
SELECT vec_id, round_even(2 * z / (m + n), 4) AS similarity FROM z WHERE round_even(2 * z / (m + n), 4) >= 0.6""")
def similarity_search(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", n.bits(F.col("embedding")).alias("fp"))
    return n.similarity_search(v, v.where("vec_id = 0"), "fp", 64, "dice", 0.6).select("vec_id", "similarity")


@query()
def dbscan(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return n.dbscan(c, "c_custkey", ["x", "y"], 0.3, 3)


@query()
def leader_clusters(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", n.bits(F.col("embedding")).alias("fp"))
    return n.leader_clusters(v, "vec_id", "fp", 64, 0.45)
