"""Mutual information of numbers and a class, from distances to neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import special
from .running import accumulated
from .tabular import OperatorError, numeric, q

#: Places of a sorted class that are looked at together.
BLOCK = 4096
#: Distances that differ by less than this share of a value are equal: sums and differences of doubles are off by less.
ROUNDING = 1e-15


def _radii(cells: DataFrame, neighbours: int) -> DataFrame:
    """cells (f, g, v, c, n, k: distinct values of a feature and class, counted) with r, the distance to the k-th neighbour in the class.

    Values are numbered in order, and blocks of places are taken apart, each with `neighbours` values from both sides.
    """
    cells = accumulated(cells.withColumn("_one", F.lit(1)), "v", {"place": "_one"}, ["f", "g"])
    within, block = F.pmod(F.col("place") - 1, F.lit(BLOCK)), F.floor((F.col("place") - 1) / BLOCK)
    goes = F.array_compact(F.array(block, F.when(within < neighbours, block - 1), F.when(within >= BLOCK - neighbours, block + 1)))
    placed = cells.withColumn("_block", block).withColumn("_at", F.explode(goes))
    order = Window.partitionBy("f", "g", "_at").orderBy("v")

    def gaps(value, count):
        return F.when(value.isNotNull(), F.array_repeat(F.abs(F.col("v") - value), F.least(count, F.lit(neighbours)).cast("int"))).otherwise(F.array().cast("array<double>"))

    sides = [gaps(side("v", i).over(order), side("c", i).over(order)) for side in (F.lag, F.lead) for i in range(1, neighbours + 1)]
    own = F.array_repeat(F.lit(0.0), F.least(F.col("c") - 1, F.lit(neighbours)).cast("int"))
    near = placed.withColumn("_near", F.array_sort(F.concat(own, *sides))).where("_at = _block")
    return near.select("f", "g", "v", "c", "k", F.element_at("_near", F.col("k").cast("int")).alias("r"))


def mutual_information(df: DataFrame, target: str, columns: list[str] | None = None, neighbours: int = 3) -> DataFrame:
    """(feature, score): the nearest-neighbour estimate of the mutual information of each column and the classes of target, in nats.

    A row's radius is the distance to its k-th neighbour in its class, k being `neighbours` or all others of a smaller
    class; m counts the rows of all classes nearer than that by more than rounding, itself included (at radius 0: the rows
    of its value). The score is psi(n) + mean psi(k) - mean psi(rows of the class) - mean psi(m), 0 if negative. Rows without a class or value
    and classes of one row take no part; a feature without rows has a null score. Equal values are not told apart by noise:
    where the k-th neighbour has the row's own value, k is the number of the class's rows of that value, itself included.

    Equal values of a class are counted first and do as one row. Neighbours come from blocks of sorted places, and m is a
    difference of running counts at both ends of the radius, so that no task holds a class or a feature.
    """
    if neighbours < 1:
        raise OperatorError("at least one neighbour is needed")
    columns = columns or [c for c in numeric(df) if c != target]
    long = df.where(q(target).isNotNull()).select(q(target).cast("string").alias("g"), *(q(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)))
    long = long.unpivot(["g"], [f"_{i}" for i in range(len(columns))], "f", "v").where("v is not null and not isnan(v)")
    cells = long.groupBy("f", "g", "v").agg(F.count(F.lit(1)).alias("c"))
    classes = cells.groupBy("f", "g").agg(F.sum("c").alias("n")).where("n > 1").withColumn("k", F.least(F.col("n") - 1, F.lit(neighbours)))
    cells = _radii(cells.join(classes, ["f", "g"]), neighbours).withColumn("k", F.when(F.col("r") == 0, F.col("c")).otherwise(F.col("k")))

    # Running counts at both ends: a lower end stands before the points at its place, an upper one behind them.
    at = lambda x, side: F.struct(x.alias("x"), F.lit(side).alias("side"))
    inner = F.greatest(F.lit(0.0), F.col("r") - ROUNDING * (F.abs("v") + F.col("r")))
    points = cells.groupBy("f", "v").agg(F.sum("c").alias("_w")).select("f", at(F.col("v"), 1).alias("_at"), "_w", F.lit(0).alias("sign"), F.lit(0).alias("c"), F.lit(0).alias("k"), F.lit(None).cast("string").alias("g"), F.lit(None).cast("double").alias("v"))
    ends = F.array(F.struct(at(F.col("v") + inner, 2).alias("_at"), F.lit(1).alias("sign")), F.struct(at(F.col("v") - inner, 0).alias("_at"), F.lit(-1).alias("sign")))
    asked = cells.withColumn("e", F.explode(ends)).select("f", "e._at", F.lit(0).alias("_w"), "e.sign", "c", "k", "g", "v")
    counted = accumulated(points.unionByName(asked), "_at", {"upto": "_w"}, ["f"]).where("sign <> 0")
    m = counted.groupBy("f", "g", "v").agg(F.first("c").alias("c"), F.first("k").alias("k"), F.sum(F.col("sign") * F.col("upto")).alias("m"))
    near = m.groupBy("f").agg(F.sum(F.col("c") * (special.digamma(F.col("m")) - special.digamma(F.col("k")))).alias("near"))
    total = classes.groupBy("f").agg(F.sum("n").alias("n"), F.sum(F.col("n") * special.digamma(F.col("n"))).alias("own"))
    score = F.greatest(F.lit(0.0), special.digamma(F.col("n")) - (F.col("own") + F.col("near")) / F.col("n"))
    found = total.join(near, "f").select("f", score.alias("score"))
    names = df.sparkSession.createDataFrame([(f"_{i}", c) for i, c in enumerate(columns)], "f string, feature string")
    return names.join(found, "f", "left").select("feature", "score")
