"""Queries of curves fitted by sums, of normality, of boosted trees and their Shapley values, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import special
from ..operators import curves, models, normality 
from .registry import query, table

# Parameters of each curve for the flag A; those of N and R are a tenth and two tenths larger. The rows of lineitem have x from 1 to 50.
_CURVES = {
    "4pl": (1.0, 9.0, 12.0, 1.6), "hill": (8.0, 11.0, 2.0), "one_phase_decay": (9.0, 2.0, 0.12), "two_phase_decay": (5.0, 0.6, 4.0, 0.05, 1.0), "exponential_growth": (2.0, 0.06),
    "michaelis_menten": (10.0, 9.0), "gompertz": (9.0, 3.0, 0.15), "sigmoid": (9.0, 20.0, 0.25),
}
_FLAG = "CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 1.1 ELSE 1.2 END"


def _on_curve(spark, d, model):
    """lineitem with y exactly on the flag's curve."""
    own = [F.lit(p) * F.expr(_FLAG).cast("double") for p in _CURVES[model]]
    return table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("x"), curves.CURVES[model].f(F.col("l_quantity").cast("double"), *own).alias("y"))


def _curves():
    for model, own in _CURVES.items():

        def run(spark, d, model=model):
            fits = curves.nonlinear_fit(_on_curve(spark, d, model), "x", "y", model, "l_returnflag")
            return fits.select("group", "parameter", F.round("value", 3).alias("value"), F.round("r_squared", 6).alias("r_squared"), "n")

        rows = " UNION ALL ".join(f"SELECT l_returnflag AS \"group\", '{name}' AS parameter, round(({p} * {_FLAG})::DOUBLE, 3) AS value, 1.0::DOUBLE AS r_squared, count(*) AS n FROM lineitem GROUP BY l_returnflag" for name, p in zip(curves.CURVES[model].names, own, strict=True))
        query(rows, f"curve_{model}")(run)


_curves()


@query(f"SELECT l_returnflag AS \"group\", x, round((10 * {_FLAG} * x / (9 * {_FLAG} + x))::DOUBLE, 4) AS fit FROM (SELECT DISTINCT l_returnflag FROM lineitem), (SELECT unnest([1.0, 13.25, 25.5, 37.75, 50.0])::DOUBLE AS x)")
def curve_band(spark, d):
    fits = curves.fit_curves(_on_curve(spark, d, "michaelis_menten"), "x", "y", "michaelis_menten", "l_returnflag")
    return curves.curve_band(fits, "michaelis_menten", 1.0, 50.0, 5).select("group", "x", F.round("fit", 4).alias("fit"))


@query('SELECT l_returnflag AS "group", l_quantity::DOUBLE AS x, count(*) AS n FROM lineitem GROUP BY 1, 2')
def curve_inverse(spark, d):
    rows = _on_curve(spark, d, "hill")
    fits = curves.fit_curves(rows, "x", "y", "hill", "l_returnflag")
    found = curves.inverse_predict(rows, fits, "hill", "y", "l_returnflag").withColumn("x", F.round("x_of_y", 3))
    return found.groupBy(F.col("l_returnflag").alias("group"), "x").agg(F.count(F.lit(1)).alias("n"))


_M = special.quantile_normal_sql("(i - 0.375) / (n + 0.25)")


@query(f"""WITH v AS (SELECT n_name AS g, c_acctbal::DOUBLE AS v FROM customer JOIN nation ON c_nationkey = n_nationkey), r AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY v)::DOUBLE AS i, count(*) OVER (PARTITION BY g)::DOUBLE AS n FROM v),
m AS (SELECT *, {_M} AS m FROM r), s AS (SELECT g, n, sum(m * m) AS mm, max(m) FILTER (i = n) AS m1, max(m) FILTER (i = n - 1) AS m2, avg(v) AS mean, 1 / sqrt(n) AS u FROM m GROUP BY g, n HAVING n > 5),
a AS (SELECT *, m1 / sqrt(mm) + 0.221157 * u - 0.147981 * u ** 2 - 2.071190 * u ** 3 + 4.434685 * u ** 4 - 2.706056 * u ** 5 AS a1, m2 / sqrt(mm) + 0.042981 * u - 0.293762 * u ** 2 - 1.752461 * u ** 3 + 5.682633 * u ** 4 - 3.582633 * u ** 5 AS a2 FROM s),
w AS (SELECT m.g, m.v, a.mean, CASE WHEN i = a.n THEN a1 WHEN i = 1 THEN -a1 WHEN i = a.n - 1 THEN a2 WHEN i = 2 THEN -a2 ELSE m / sqrt((mm - 2 * m1 ** 2 - 2 * m2 ** 2) / (1 - 2 * a1 ** 2 - 2 * a2 ** 2)) END AS weight FROM m JOIN a USING (g))
SELECT g AS "group", count(*) AS n, round(sum(weight * (v - mean)) ** 2 / sum((v - mean) ** 2), 7) AS w FROM w GROUP BY 1""")
def shapiro_wilk(spark, d):
    rows = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # nation: 25 rows
    return normality.shapiro_wilk(rows, "c_acctbal", "n_name").where("n > 5").select("group", "n", F.round("w", 7).alias("w"))


# Boosting: a target that two turns tell exactly, so that any right search finds the same tree.
_STEP = "CASE WHEN l_quantity > 24 THEN CASE WHEN l_linenumber > 3 THEN 8.0 ELSE 2.0 END ELSE CASE WHEN l_linenumber > 2 THEN -1.0 ELSE -6.0 END END"


@query(f"SELECT l_quantity, l_linenumber, count(*) AS n, round(({_STEP})::DOUBLE, 4) AS prediction FROM lineitem GROUP BY 1, 2")
def hist_boosting(spark, d):
    rows = table(spark, d, "lineitem").withColumn("y", F.expr(_STEP).cast("double"))
    model = models.fit_regressor(rows, "xgboost", "y", ["l_quantity", "l_linenumber"], n_estimators=1, max_depth=3, learning_rate=1.0, reg_lambda=0.0, min_child_weight=0.0)
    return model.predict(rows).groupBy("l_quantity", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("prediction"), 4).alias("prediction"))


_CLASS = "CASE WHEN l_quantity > 30 THEN 'high' WHEN l_linenumber > 4 THEN 'late' ELSE 'plain' END"


@query(f"SELECT {_CLASS} AS prediction, count(*) AS n FROM lineitem GROUP BY 1")
def hist_boosting_classes(spark, d):
    rows = table(spark, d, "lineitem").withColumn("y", F.expr(_CLASS))
    model = models.fit_classifier(rows, "hist_gradient_boosting", "y", ["l_quantity", "l_linenumber"], n_estimators=3, max_depth=3)
    return model.predict(rows).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH r AS (SELECT l_quantity > 24 AS a, l_linenumber, ({_STEP})::DOUBLE AS y FROM lineitem), s AS (SELECT *, avg(y) OVER () AS m FROM r), v AS (SELECT *, avg(y) OVER (PARTITION BY a) AS ya FROM s),
t AS (SELECT sum(CASE WHEN a THEN 1.0 ELSE 0 END) / count(*) AS pa FROM r),
w AS (SELECT v.*, pa * CASE WHEN l_linenumber > 3 THEN 8.0 ELSE 2.0 END + (1 - pa) * CASE WHEN l_linenumber > 2 THEN -1.0 ELSE -6.0 END AS yl FROM v, t)
SELECT count(*) AS n, round(sum(abs((ya - m + y - yl) / 2)), 2) AS size_quantity, round(sum(abs((yl - m + y - ya) / 2)), 2) AS size_line, round(max(m), 6) AS base FROM w""")
def tree_shapley(spark, d):
    """Of a tree that turns by quantity, then by line: both orders in which the two features can become known, halved."""
    rows = table(spark, d, "lineitem").withColumn("y", F.expr(_STEP).cast("double"))
    model = models.fit_regressor(rows, "xgboost", "y", ["l_quantity", "l_linenumber"], n_estimators=1, max_depth=2, learning_rate=1.0, reg_lambda=0.0, min_child_weight=0.0)
    shap = models.shap_values(model, rows)
    size = lambda c: F.round(F.sum(F.abs(f"shap_{c}")), 2)
    return shap.agg(F.count(F.lit(1)).alias("n"), size("l_quantity").alias("size_quantity"), size("l_linenumber").alias("size_line"), F.round(F.max("shap_base"), 6).alias("base"))
