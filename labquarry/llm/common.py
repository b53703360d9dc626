"""What the operators of this subpackage share: tables in the shared folder, gapless numbering, components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import drop_stored, shared_folder, stored

__all__ = ["components", "drop_stored", "join_by_key", "local_forest", "numbered", "partitions", "parts_for", "read", "runs", "shared_folder", "sieve", "stored", "text_bytes", "whole_groups"]

#: A key with more than one in so many of all rows is hot; there are no more hot keys than that.
HOT = 1000
#: Bits of a sieve for each key, and at most in all (128 MB as a broadcast). Beyond that it only lets more rows through.
SIEVE_BITS = 16
MOST_SIEVE_BITS = 1 << 30


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder; any path Spark can read will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def parts_for(spark: SparkSession, rows: int, per: int) -> int:
    """Partitions of about `per` rows, no fewer than the session's own number."""
    return max(partitions(spark), -(-rows // per))


def join_by_key(rows: DataFrame, table: DataFrame, keys: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with table, which has one row a key and in n how many of the `total` rows have it.

    Rows of hot keys stay where they are, as the HOT rows of the table at most that they need are broadcast; only the
    others are shuffled by key. Both sides should be stored: they are read twice.
    """
    is_hot = F.col(n) * HOT > total
    hot = F.broadcast(table.where(is_hot))
    rest = rows.join(F.broadcast(table.where(is_hot).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(table.where(~is_hot).hint("merge"), keys, how))


def sieve(rows: DataFrame, h: Column, wanted: DataFrame, wanted_h: Column) -> tuple[Column, DataFrame]:
    """(condition, rows): the rows beside a bitmap of the wanted hashes; rows without the condition surely have none of them.

    The bitmap has SIEVE_BITS bits for each wanted row (stored, counted here) and MOST_SIEVE_BITS at most; it is
    made of blocks of 4 KB by partial aggregation and broadcast. A row that passes by chance costs work, never an answer.
    """
    bits = 1 << 15
    needed = max(1, wanted.count()) * SIEVE_BITS
    while bits < min(needed, MOST_SIEVE_BITS):
        bits *= 2
    place = lambda x: F.pmod(x, F.lit(bits)) + 1
    at = wanted.select(place(wanted_h).alias("_at"))
    blocks = at.groupBy(F.bitmap_bucket_number("_at").alias("_block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    joined = rows.withColumn("_at", place(h)).join(F.broadcast(blocks), F.bitmap_bucket_number(F.col("_at")) == F.col("_block"), "left")
    bit = F.bitmap_bit_position(F.col("_at"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(_at) % 8 as int))")) != 0, F.lit(False)), joined


def numbered(df: DataFrame, group: list[str], order: list[str], name: str = "number") -> DataFrame:
    """Adds name: each row's place in its group, gapless from 0, by the order given.

    No task holds a whole group: rows are range-partitioned by group and order (a hot group spans many
    partitions), numbered inside each partition, and a group's counts in earlier partitions are added.
    Rows equal in group and order get different numbers, in no set order among themselves.
    df should be cheap to read twice, as range partitioning samples it first.
    """
    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    placed = (
        df.repartitionByRange(partitions(spark), *keys)
        .sortWithinPartitions(*keys)
        .withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    )
    placed = stored(placed)
    cells = placed.groupBy("_part", *group).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    cells = cells.select(F.col("_part").alias("_p"), "_first", "_before", *(F.col(g).alias(f"_of_{g}") for g in group))
    on = [F.col("_part") == F.col("_p"), *(F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in group)]
    return placed.join(cells, on).select(
        *df.columns, (F.col("_row") - F.col("_first") + F.col("_before")).cast("long").alias(name)
    )


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for each id of the edges (a long, b long), the smallest id it is connected with.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every step is a grouped minimum
    and a join, so neither a hub nor a component has to fit in a task; each step's result is stored.
    """
    spark = edges.sparkSession
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(low, "a")
        small = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        after = stored(small.where("a <> b").distinct())
        drop_stored(now)
        now = after
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == (row["n"], row["s"]):
            break
        state = (row["n"], row["s"])
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (id, smallest id of its component) of the graph with edges a-b; at most one for each id."""
    if not len(a):
        return a, b
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        nxt = label.copy()
        np.minimum.at(nxt, label[x], low)
        np.minimum.at(nxt, label[y], low)
        np.minimum.at(nxt, x, low)
        np.minimum.at(nxt, y, low)
        while (jump := nxt[nxt]).tolist() != nxt.tolist():
            nxt = jump
        if (nxt == label).all():
            break
        label = nxt
    keep = label != np.arange(len(ids))
    return ids[keep], ids[label[keep]]


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes; none for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each run of equal values."""
    if not len(values):
        return []
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    bounds = [0, *cuts.tolist(), len(values)]
    return list(zip(bounds, bounds[1:], strict=False))


def whole_groups(batches, key: str):
    """Frames that each hold whole groups of key, from batches that come sorted by it."""
    import pandas as pd

    kept = None
    for pdf in batches:
        if not len(pdf):
            continue
        if kept is not None:
            pdf = pd.concat([kept, pdf], ignore_index=True)
        k = pdf[key].to_numpy()
        cut = int(np.searchsorted(k == k[-1], True)) if len(k) else 0
        if cut:
            yield pdf.iloc[:cut].reset_index(drop=True)
        kept = pdf.iloc[cut:]
    if kept is not None and len(kept):
        yield kept.reset_index(drop=True)
