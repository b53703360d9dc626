"""Plate and cell screening tables: cells by group with a background row, quality control, blanks, and ranking of thresholds."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import statistics
from .tabular import q


def exclude_cells(cells: DataFrame, excluded: str, stem: str = "file_stem", cell: str = "cell") -> DataFrame:
    """Cells less those of a JSON object {stem: [cells]}; a text that is none excludes nothing."""
    try:
        found = json.loads(excluded)
        rows = [(str(s), int(c)) for s, cs in found.items() for c in cs]
    except (ValueError, AttributeError, TypeError):
        rows = []
    if not rows:
        return cells
    gone = cells.sparkSession.createDataFrame(rows, "_stem string, _cell int")
    return cells.join(F.broadcast(gone), (q(stem) == F.col("_stem")) & (q(cell) == F.col("_cell")), "left_anti")  # a list made by hand


def blank_normalize(cells: DataFrame, background: DataFrame, value: str, reference: str = "", normalize: bool = True, stem: str = "file_stem", group: str = "group", cell: str = "cell") -> DataFrame:
    """(group, stem, cell, value): less the file's background, then over the reference group's mean if it is known and not 0.

    A file is known by its group and stem. Of several background rows of a file the smallest value counts.
    """
    b = background.groupBy(q(group).alias("_group"), q(stem).alias("_stem")).agg(F.min(q(value)).alias("_blank"))
    out = cells.join(b, (q(stem) == F.col("_stem")) & (q(group).eqNullSafe(F.col("_group"))), "left").select(q(group), q(stem), q(cell), (q(value) - F.coalesce("_blank", F.lit(0.0))).alias(value))
    if not normalize:
        return out
    mean = out.where(q(group) == reference).agg(F.avg(q(value)).alias("_mean"))
    out = out.crossJoin(F.broadcast(mean))  # one row
    return out.withColumn(value, F.when(F.coalesce("_mean", F.lit(0.0)) == 0, q(value)).otherwise(q(value) / F.col("_mean"))).drop("_mean")


def rank_combinations(cells: DataFrame, columns: list[str], reference: str, compared: str, folds: int = 5, seeds: int = 5, least_fold_change: float = 1.0, group: str = "group", stem: str = "file_stem") -> DataFrame:
    """(column, worst_p, mean_neglog10p, fold_change, passes_filter): columns by how well they part two groups in every fold.

    Files, not cells, are dealt into folds, anew for each seed, by hash; each fold is left out once and Welch's test is
    taken of the rest. Folds of all seeds and columns are one aggregate.
    """
    k = cells.where(q(group).isin(reference, compared)).select(q(group).alias("g"), q(stem).cast("string").alias("s"), *(q(c).cast("double").alias(c) for c in columns))
    long = k.unpivot(["g", "s"], columns, "column", "v").where("v is not null")
    deals = long.withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(seeds)))).withColumn("own", F.pmod(F.xxhash64("s", "seed"), F.lit(folds)))
    left = deals.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("own <> fold")
    m = left.groupBy("column", "seed", "fold").agg(*(x for name, g in (("a", reference), ("b", compared)) for x in (F.count(F.when(F.col("g") == g, 1)).alias(f"n{name}"), F.avg(F.when(F.col("g") == g, F.col("v"))).alias(f"m{name}"), F.var_samp(F.when(F.col("g") == g, F.col("v"))).alias(f"v{name}"))))
    a, b = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    m = m.withColumns({"t": F.try_divide(F.col("mb") - F.col("ma"), F.sqrt(a + b)), "df": F.try_divide((a + b) ** 2, a**2 / (F.col("na") - 1) + b**2 / (F.col("nb") - 1))})
    m = m.withColumn("p", statistics.special.p_t(F.col("t"), F.col("df")))
    s = m.groupBy("column").agg(F.max("p").alias("worst_p"), F.avg(-F.log10(F.greatest("p", F.lit(1e-300)))).alias("mean_neglog10p"), F.avg(F.try_divide("mb", "ma")).alias("fold_change"))
    return s.withColumn("passes_filter", F.coalesce(F.col("fold_change") >= least_fold_change, F.lit(False))).orderBy(F.desc("passes_filter"), "worst_p", F.desc("mean_neglog10p"))
