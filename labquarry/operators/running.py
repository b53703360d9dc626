"""Running sums over ordered rows that no single task has to hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import stored


def accumulated(df: DataFrame, order: str, columns: dict[str, str], by: list[str] | None = None, descending: bool = False, how: str = "sum") -> DataFrame:
    """df with, for each {name: column}, the sum (or how: min, max) of the column over the rows up to this one (included) by order, inside `by`.

    Rows are range-partitioned by group and order, summed inside each partition, and given their group's sums in earlier
    partitions: one row a partition and group. Order should be distinct inside a group; the rows are stored once.
    """
    by = by or []
    fold, joined = {"sum": (F.sum, lambda a, b: a + F.coalesce(b, F.lit(0))), "min": (F.min, F.least), "max": (F.max, F.greatest)}[how]
    keys = [F.col(c).asc() for c in by] + [F.col(order).desc() if descending else F.col(order).asc()]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *by).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, 0)
    parts = placed.groupBy("_part", *by).agg(*(fold(c).alias(f"_s{k}") for k, c in enumerate(columns.values())))
    earlier = Window.partitionBy(*(by or [F.lit(1)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("_part").alias("_p"), *(F.col(c).alias(f"_of{k}") for k, c in enumerate(by)), *(fold(f"_s{k}").over(earlier).alias(f"_b{k}") for k in range(len(columns))))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of{k}")) for k, c in enumerate(by)], F.col("_part") == F.col("_p"))
    out = placed.withColumns({f"_i{k}": fold(c).over(inside) for k, c in enumerate(columns.values())}).join(parts, on)
    return out.select(*df.columns, *(joined(F.col(f"_i{k}"), F.col(f"_b{k}")).alias(name) for k, name in enumerate(columns)))


def percentiles(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """One row (a group): by, p0, p1, ...: the exact percentiles of the column at `shares`, between two values by proportion; nulls are left out.

    As F.percentile gives them, but that sends all distinct values to one task; here values are counted and the counts
    summed in order by range partitions. Groups of `by` should have no nulls.
    """
    by = by or []
    known = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null")
    upto = accumulated(known.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")), "_v", {"_upto": "_n"}, by)
    total = upto.groupBy(*by).agg(F.max("_upto").alias("_all"))
    upto = upto.join(total, by) if by else upto.crossJoin(F.broadcast(total))
    at = [(F.col("_all") - 1) * F.lit(float(p)) for p in shares]
    ends = [F.min(F.when(F.col("_upto") > end(x), F.col("_v"))).alias(f"_{name}{k}") for k, x in enumerate(at) for name, end in (("low", F.floor), ("high", F.ceil))]
    found = upto.groupBy(*by).agg(F.max("_all").alias("_all"), *ends)
    low, high = ([F.col(f"_{name}{k}") for k in range(len(shares))] for name in ("low", "high"))
    between = [(F.ceil(x) - x) * a + (x - F.floor(x)) * b for x, a, b in zip(at, low, high, strict=True)]
    return found.select(*by, *(F.when(a == b, a).otherwise(v).alias(f"p{k}") for k, (a, b, v) in enumerate(zip(low, high, between, strict=True))))
