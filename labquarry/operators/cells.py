"""Cells cut out of images, and what is measured on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tabular import _need, q


def cell_pairs(images: DataFrame, masks: DataFrame, key: str | None = None) -> DataFrame:
    """(cell_key, image, cell_mask) of the cells that have an image, masks null where there is none; one cell if a key is given."""
    a = images.select(F.col("key").alias("cell_key"), F.struct(*(q(c) for c in images.columns if c != "key")).alias("image"))
    b = masks.select(F.col("key").alias("_key"), F.struct(*(q(c) for c in masks.columns if c != "key")).alias("cell_mask"))
    a = a if key is None else a.where(F.col("cell_key") == key)
    return a.join(b, F.col("cell_key") == F.col("_key"), "left").drop("_key")


def filopodia_summary(df: DataFrame, cell: str | None = None, order: str | None = None) -> DataFrame:
    """One row a cell, or one of the whole table: filopodia_count, mean, total and edge lengths in pixels and micrometres, density.

    The edge is a property of the cell that its branches repeat: the first by `order` (any, without one). density is
    branches per edge length, in micrometres where that is positive, else in pixels, else 0. Nulls are left out of lengths.
    """
    units = [u for u in ("px", "um") if f"edge_length_{u}" in df.columns]
    _need(df, "filopodia_length_px", "filopodia_length_um")
    number = lambda c: F.nanvl(q(c).cast("double"), F.lit(None).cast("double"))
    first = lambda c: F.min_by(number(c), q(order)) if order else F.any_value(number(c), True)
    sums = [f.alias(n) for u in ("px", "um") for f, n in ((F.round(F.avg(number(f"filopodia_length_{u}")), 2), f"mean_length_{u}"), (F.round(F.coalesce(F.sum(number(f"filopodia_length_{u}")), F.lit(0.0)), 2), f"total_length_{u}"))]
    edges = [(first(f"edge_length_{u}") if u in units else F.lit(None).cast("double")).alias(f"_edge_{u}") for u in ("px", "um")]
    keys = [q(cell).alias("cell_key")] if cell else []
    s = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("filopodia_count"), *sums, *edges)
    by = [F.when(F.col(f"_edge_{u}") > 0, F.col("filopodia_count") / F.col(f"_edge_{u}")) for u in ("um", "px")]
    s = s.withColumns({"edge_length_px": F.round("_edge_px", 2), "edge_length_um": F.round("_edge_um", 2), "density": F.round(F.coalesce(*by, F.lit(0.0)), 4)})
    return s.drop("_edge_px", "_edge_um")
