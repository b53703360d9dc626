"""The tables behind figures: what is drawn is computed here; drawing it is the client's matter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import special
from .tabular import OperatorError, numeric, q


def bars(df: DataFrame, value: str, group: str, error: str = "se") -> DataFrame:
    """(group, n, mean, error) with the error se, sd or ci (95 %)."""
    s = df.where(q(value).isNotNull() & q(group).isNotNull()).groupBy(q(group).alias("group")).agg(F.count(F.lit(1)).alias("n"), F.avg(q(value)).alias("mean"), F.stddev_samp(q(value)).alias("sd"))
    se = F.col("sd") / F.sqrt("n")
    if error == "ci":
        t = special._column(lambda n: [special.t_quantile(0.975, x) if x > 0 else float("nan") for x in n], F.col("n") - 1)
        s = s.withColumn("_t", t)
        return s.withColumn("error", F.col("_t") * se).drop("sd", "_t")
    return s.withColumn("error", se if error == "se" else F.col("sd")).drop("sd")


def lines(df: DataFrame, x: str, y: str, group: str | None = None) -> DataFrame:
    """(x, [group,] n, mean, sd, sem) at each x."""
    keys = [q(x).alias("x"), *([q(group).alias("group")] if group else [])]
    s = df.where(q(x).isNotNull() & q(y).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(q(y)).alias("mean"), F.stddev_samp(q(y)).alias("sd"))
    return s.withColumn("sem", F.col("sd") / F.sqrt("n"))


def boxes(df: DataFrame, value: str, group: str, reach: float = 1.5) -> DataFrame:
    """(group, n, q1, median, q3, whisker_low, whisker_high, outliers): whiskers end at the last values within reach quartile ranges."""
    k = df.where(q(value).isNotNull() & q(group).isNotNull()).select(q(group).alias("group"), q(value).cast("double").alias("v"))
    s = k.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.percentile("v", 0.25).alias("q1"), F.median("v").alias("median"), F.percentile("v", 0.75).alias("q3"))
    low, high = F.col("q1") - reach * (F.col("q3") - F.col("q1")), F.col("q3") + reach * (F.col("q3") - F.col("q1"))
    inside = F.col("v").between(low, high)
    w = k.join(s, "group").groupBy("group").agg(F.min(F.when(inside, F.col("v"))).alias("whisker_low"), F.max(F.when(inside, F.col("v"))).alias("whisker_high"), F.sum((~inside).cast("long")).alias("outliers"))
    return s.join(w, "group")


def histogram(df: DataFrame, value: str, bins: int = 20, group: str | None = None) -> DataFrame:
    """([group,] bin, low, high, count) over equal bins from the smallest to the largest value; the last bin is closed."""
    k = df.where(q(value).isNotNull()).select(*([q(group).alias("group")] if group else []), q(value).cast("double").alias("v"))
    span = k.agg(F.min("v").alias("a"), F.max("v").alias("b"))
    k = k.crossJoin(F.broadcast(span))  # one row
    width = (F.col("b") - F.col("a")) / bins
    at = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("a"), width)), F.lit(0))).cast("int")
    out = k.groupBy(*(["group"] if group else []), at.alias("bin"), "a", "b").agg(F.count(F.lit(1)).alias("count"))
    return out.select(*(["group"] if group else []), "bin", (F.col("a") + F.col("bin") * width).alias("low"), (F.col("a") + (F.col("bin") + 1) * width).alias("high"), "count")


def density(df: DataFrame, value: str, points: int = 100) -> DataFrame:
    """(x, density): a Gaussian kernel estimate with Scott's width on a grid; equal values are summed first."""
    k = df.where(q(value).isNotNull()).select(q(value).cast("double").alias("v"))
    s = k.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd"), F.min("v").alias("a"), F.max("v").alias("b"))
    s = s.withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), -0.2))
    step = (F.col("b") - F.col("a") + 6 * F.col("h")) / (points - 1)
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("a") - 3 * F.col("h") + i * step)
    # Each value becomes a fixed number of rows, summed before the shuffle.
    values = k.groupBy("v").agg(F.count(F.lit(1)).alias("m")).crossJoin(F.broadcast(s.withColumn("x", grid)))
    e = values.select("v", "m", "n", "h", F.explode("x").alias("x"))
    z = (F.col("x") - F.col("v")) / F.col("h")
    return e.groupBy("x").agg((F.sum(F.col("m") * F.exp(-z * z / 2)) / (F.first("n") * F.first("h") * 2.5066282746310002)).alias("density"))


def radar(df: DataFrame, group: str, columns: list[str] | None = None) -> DataFrame:
    """(group, metric, value): group means, each metric from 0 to 1 over the groups (0 if all are equal)."""
    columns = columns or [c for c in numeric(df) if c != group]
    m = df.where(q(group).isNotNull()).groupBy(q(group).alias("group")).agg(*(F.avg(q(c)).alias(c) for c in columns)).unpivot(["group"], columns, "metric", "v")
    by = Window.partitionBy("metric")
    return m.select("group", "metric", F.coalesce(F.try_divide(F.col("v") - F.min("v").over(by), F.max("v").over(by) - F.min("v").over(by)), F.lit(0.0)).alias("value"))


def angles(df: DataFrame, column: str, bins: int = 36) -> DataFrame:
    """(bin, from_degrees, count) of directions in degrees."""
    at = F.floor(F.pmod(q(column).cast("double"), F.lit(360.0)) / (360.0 / bins)).cast("int")
    return df.where(q(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("count")).withColumn("from_degrees", F.col("bin") * (360.0 / bins))


def heatmap(df: DataFrame, row: str, columns: list[str] | None = None) -> DataFrame:
    """(row, column, value): the means that the cells show."""
    columns = columns or [c for c in numeric(df) if c != row]
    return df.groupBy(q(row).cast("string").alias("row")).agg(*(F.avg(q(c)).alias(c) for c in columns)).unpivot(["row"], columns, "column", "value")


def regression_line(df: DataFrame, x: str, y: str, group: str | None = None) -> DataFrame:
    """([group,] n, slope, intercept, r2)."""
    keys = [q(group).alias("group")] if group else []
    return df.groupBy(*keys).agg(F.regr_count(q(y), q(x)).alias("n"), F.regr_slope(q(y), q(x)).alias("slope"), F.regr_intercept(q(y), q(x)).alias("intercept"), F.regr_r2(q(y), q(x)).alias("r2"))


def scatter(df: DataFrame, x: str, y: str, hue: str | None = None, regression: bool = False) -> dict[str, DataFrame]:
    """points (x, y[, hue]) where both are known, and with regression the line through all of them (without a hue)."""
    points = df.where(q(x).isNotNull() & q(y).isNotNull()).select(q(x).alias("x"), q(y).alias("y"), *([q(hue).alias("hue")] if hue else []))
    return {"points": points} | ({"line": regression_line(points, "x", "y")} if regression and not hue else {})


def joint(df: DataFrame, x: str, y: str, bins: int = 20, hue: str | None = None) -> dict[str, DataFrame]:
    """points as scatter() has them; marginals (axis, [group,] bin, low, high, count); cells (x_bin, y_bin, count) of the plane."""
    points = scatter(df, x, y, hue)["points"]
    sides = [histogram(points, c, bins, "hue" if hue else None).select(F.lit(c).alias("axis"), "*") for c in ("x", "y")]
    s = points.agg(*(f(c).cast("double").alias(f"{n}{c}") for n, f in (("a", F.min), ("b", F.max)) for c in ("x", "y")))

    def at(c):
        place = F.try_divide((F.col(c) - F.col(f"a{c}")) * bins, F.col(f"b{c}") - F.col(f"a{c}"))
        return F.least(F.lit(bins - 1), F.coalesce(F.floor(place), F.lit(0))).cast("int").alias(f"{c}_bin")

    cells = points.crossJoin(F.broadcast(s)).groupBy(at("x"), at("y")).agg(F.count(F.lit(1)).alias("count"))  # one row
    return {"points": points, "marginals": sides[0].union(sides[1]), "cells": cells}


def regression_scatter(df: DataFrame, true: str, predicted: str) -> dict[str, DataFrame]:
    """points (true, predicted, residual), and fit: n, r2 (0 if the true values are all equal) and the ends of the identity line."""
    t, p = q(true).cast("double"), q(predicted).cast("double")
    points = df.where(t.isNotNull() & p.isNotNull()).select(t.alias("true"), p.alias("predicted"), (t - p).alias("residual"))
    rest = F.sum(F.col("residual") ** 2)
    low, high = F.least(F.min("true"), F.min("predicted")), F.greatest(F.max("true"), F.max("predicted"))
    fit = points.agg(F.count(F.lit(1)).alias("n"), rest.alias("rest"), (F.var_pop("true") * F.count(F.lit(1))).alias("total"), low.alias("low"), high.alias("high"))
    margin = (F.col("high") - F.col("low")) * 0.05
    r2 = F.when(F.col("total") > 0, 1 - F.col("rest") / F.col("total")).otherwise(0.0)
    return {"points": points, "fit": fit.select("n", r2.alias("r2"), (F.col("low") - margin).alias("line_low"), (F.col("high") + margin).alias("line_high"))}


def cluster_scatter(df: DataFrame, x: str, y: str, cluster: str | None = None, label: str | None = None) -> dict[str, DataFrame]:
    """points (x, y, cluster, class), and centers (cluster, class, n, x, y) of what is drawn in one colour and marker."""
    points = df.where(q(x).isNotNull() & q(y).isNotNull()).select(q(x).alias("x"), q(y).alias("y"), (q(cluster) if cluster else F.lit(None)).cast("string").alias("cluster"), (q(label) if label else F.lit(None)).cast("string").alias("class"))
    return {"points": points, "centers": points.groupBy("cluster", "class").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))}


def double_variable(df: DataFrame, x: str, y: str, kind: str = "scatter", hue: str | None = None) -> dict[str, DataFrame]:
    """The tables of a plot of two columns: scatter; box and violin of y by x; pairplot, all pairs of numeric columns."""
    if kind == "scatter":
        return scatter(df, x, y, hue)
    if kind in ("box", "violin"):
        return {"boxes": boxes(df, y, x)}
    if kind != "pairplot":
        raise OperatorError(f"no plot {kind!r}")
    columns = [c for c in numeric(df) if c != hue]
    keep = [q(hue).alias("hue")] if hue else []
    pairs = F.array(*(F.struct(F.lit(a).alias("x_column"), F.lit(b).alias("y_column"), q(a).cast("double").alias("x"), q(b).cast("double").alias("y")) for i, a in enumerate(columns) for b in columns[i + 1 :]))
    return {"points": df.select(*keep, F.explode(pairs).alias("p")).select(*(["hue"] if hue else []), "p.*").where("x is not null and y is not null")}
