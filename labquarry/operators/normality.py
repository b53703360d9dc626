"""Shapiro and Wilk's test by Royston's approximation, over ranks that no single task has to hold."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..storage import drop_stored, stored
from .running import accumulated
from .statistics import _known

# Royston's polynomials (1992, 1995), by rising power: corrections of the two outer weights in 1 / sqrt(n),
# and mean and log deviation of the transformed statistic in n (4 to 11) or ln n (12 and more).
OUTER = ([0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056], [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633])
SMALL_MEAN, SMALL_LOG_SD, SMALL_GAMMA = [0.5440, -0.39978, 0.025054, -0.0006714], [1.3822, -0.77857, 0.062767, -0.0020322], [-2.273, 0.459]
LARGE_MEAN, LARGE_LOG_SD = [-1.5861, -0.31082, -0.083751, 0.0038915], [-0.4803, -0.082676, 0.0030302]


def _poly(powers: list[float], x: Column) -> Column:
    out = F.lit(powers[-1])
    for c in reversed(powers[:-1]):
        out = out * x + c
    return out


def shapiro_wilk(df: DataFrame, value: str, group: str | None = None, alpha: float = 0.05) -> DataFrame:
    """(group, n, w, p, is_normal) of groups of 3 values or more that differ.

    Ranks are running sums over the distinct values of each group, by range partitions; the expected normal values and
    the weights follow from the rank alone. Missing values are left out; a null group is none. The p-values were fitted for
    up to 5,000 values and are only a guide beyond.
    """
    known = _known(df, value, group) if group else _known(df, value).withColumn("g", F.lit("all"))
    cells = known.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    cells = stored(cells)
    sums = cells.groupBy("g").agg(F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"), F.count(F.lit(1)).alias("different")).where("n >= 3 and different > 1").drop("different")
    ranked = accumulated(cells, "v", {"hi": "c"}, ["g"]).join(sums, "g")
    ranked = ranked.withColumn("i", F.explode(F.sequence(F.col("hi") - F.col("c") + 1, F.col("hi"))))
    p = "(CAST(i AS DOUBLE) - 0.375) / (CAST(n AS DOUBLE) + 0.25)"
    ranked = stored(ranked.select("g", "v", "i", "n", "mean", F.expr(special.quantile_normal_sql(p)).alias("m")))
    n, last, next_ = F.col("n").cast("double"), F.col("i") == F.col("n"), F.col("i") == F.col("n") - 1
    told = ranked.groupBy("g").agg(F.sum(F.col("m") * F.col("m")).alias("mm"), F.max(F.when(last, F.col("m"))).alias("m1"), F.max(F.when(next_, F.col("m"))).alias("m2"), F.sum((F.col("v") - F.col("mean")) ** 2).alias("ss"))
    rows = ranked.join(told, "g")
    u = 1 / F.sqrt(n)
    a1, a2 = (F.col(f"m{k + 1}") / F.sqrt("mm") + _poly(OUTER[k], u) for k in range(2))
    a1 = F.when(F.col("n") == 3, math.sqrt(0.5)).otherwise(a1)
    small = F.col("n") <= 5
    phi = F.when(small, (F.col("mm") - 2 * F.col("m1") ** 2) / (1 - 2 * a1**2)).otherwise((F.col("mm") - 2 * F.col("m1") ** 2 - 2 * F.col("m2") ** 2) / (1 - 2 * a1**2 - 2 * a2**2))
    inner = F.when(F.col("n") == 3, 0.0).otherwise(F.col("m") / F.sqrt(phi))
    weight = F.when(last, a1).when(F.col("i") == 1, -a1).when(~small & next_, a2).when(~small & (F.col("i") == 2), -a2).otherwise(inner)
    out = rows.groupBy("g").agg(F.first("n").alias("n"), F.sum(weight * (F.col("v") - F.col("mean"))).alias("b"), F.first("ss").alias("ss"))
    w = F.least(F.col("b") ** 2 / F.col("ss"), F.lit(1.0))
    out = out.withColumn("w", w)
    rest, ln = F.log(1 - F.col("w")), F.log(n)
    gamma = _poly(SMALL_GAMMA, n)
    z = F.when(n >= 12, (rest - _poly(LARGE_MEAN, ln)) / F.exp(_poly(LARGE_LOG_SD, ln))).otherwise((-F.log(gamma - rest) - _poly(SMALL_MEAN, n)) / F.exp(_poly(SMALL_LOG_SD, n)))
    three = F.greatest(6 / math.pi * (F.asin(F.sqrt("w")) - F.asin(F.sqrt(F.lit(0.75)))), F.lit(0.0))
    far = (n < 12) & (rest >= gamma)  # beyond what the approximation reaches
    p = F.when(F.col("n") == 3, three).when(far, 1e-19).when(F.col("w") >= 1, 1.0).otherwise(special.p_normal(z, "greater"))
    out = out.select(F.col("g").alias("group"), "n", "w", p.alias("p"))
    out = stored(out.withColumn("is_normal", F.col("p") > alpha))
    drop_stored(cells, ranked)
    return out
