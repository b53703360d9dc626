"""Aggregates of all batches at once, from bitmasks of the batches that rows live in.

A row's lifetime is a mask: bit t is set if the row is there after batch t. Different items are counted by OR-ing the
masks of each item; counts and sums come from the few different masks. For extrema, ranks and medians, values are
scanned ascending: masks of a sorted run are added up by bit-sliced vertical counters (plane k holds bit k of every
batch's count, so that one addition of words counts for all batches), kept as a tree of partial sums, in which a rank is
found for all batches together.

Runs are range partitions of the histogram (group, value, mask), so a group of any size is scanned by many tasks; only
counts for each run and batch are added up across them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_stored, parts_for, read, runs, stored

BATCHES = 20
#: Rows of the histogram in a range partition, about.
RUN = 500_000
#: Rows of a run's block, as a power of 2: the rows among which a median is looked for at last.
BLOCK_BITS = 7
MEASURES = ["n_rows", "n_distinct", "total", "least", "greatest", "median"]


def _added(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Bit-sliced sums: planes of a plus planes of b, of equal number, with one plane more for the carry."""
    carry, out = np.zeros_like(a[0]), []
    for x, y in zip(a, b, strict=True):
        both = x ^ y
        out.append(both ^ carry)
        carry = (x & y) | (both & carry)
    return [*out, carry]


class VerticalCounters:
    """Counts of masks by lane, as a tree: at level k, place i has the bit-sliced sums of rows i * 2**k to (i + 1) * 2**k - 1."""

    def __init__(self, masks: np.ndarray, weights: np.ndarray) -> None:
        weights = weights.astype(np.uint64)
        planes = [np.where((weights >> np.uint64(k)) & np.uint64(1), masks.astype(np.uint64), np.uint64(0)) for k in range(max(1, int(weights.max(initial=0)).bit_length()))]
        self.levels = [planes]
        while len(planes[0]) > 1:
            planes = [np.append(p, np.uint64(0)) if len(p) % 2 else p for p in planes]
            self.levels[-1] = planes
            planes = _added([p[0::2] for p in planes], [p[1::2] for p in planes])
            while len(planes) > 1 and not planes[-1].any():
                planes = planes[:-1]
            self.levels.append(planes)

    @staticmethod
    def _at(planes: list[np.ndarray], places: np.ndarray, lanes: np.ndarray) -> np.ndarray:
        return sum(((p[places] >> lanes) & np.uint64(1)).astype(np.int64) << k for k, p in enumerate(planes))

    def counts(self, lanes: np.ndarray) -> np.ndarray:
        return self._at(self.levels[-1], np.zeros(len(lanes), np.int64), lanes.astype(np.uint64))

    def select(self, lanes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """For each lane, the row in which its count reaches the rank (from 1, at most its count)."""
        lanes, ranks, at = lanes.astype(np.uint64), ranks.astype(np.int64).copy(), np.zeros(len(lanes), np.int64)
        for planes in reversed(self.levels[:-1]):
            left = self._at(planes, 2 * at, lanes)
            right = ranks > left
            ranks -= np.where(right, left, 0)
            at = 2 * at + right
        return at


def _by_batch(masks: DataFrame, sums: dict[str, str], batches: int) -> DataFrame:
    """Sums over the rows whose mask has the batch's bit; masks has few rows, one for each group and mask."""
    spread = masks.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1)))).where(F.expr("shiftright(mask, batch) & 1 = 1"))
    return spread.groupBy("group", "batch").agg(*(F.sum(c).cast("long").alias(name) for name, c in sums.items()))


def _orders(rows: DataFrame, batches: int) -> tuple[DataFrame, list[DataFrame]]:
    """(group, batch, least, greatest, median) of rows (group, value, mask), and the tables it reads.

    A median is looked for in its run's counts, then in the counts of blocks of that run, then in the rows of one block.
    """
    spark = rows.sparkSession
    histogram = stored(rows.where("value is not null").groupBy("group", "value", "mask").agg(F.count(F.lit(1)).alias("w")))
    placed = histogram.repartitionByRange(parts_for(spark, histogram.count(), RUN), "group", "value").sortWithinPartitions("group", "value", "mask")
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = stored(placed.withColumns({"part": F.spark_partition_id(), "block": F.shiftright(at, BLOCK_BITS)}))
    lanes = np.arange(batches)
    names = ["part", "group", "block"]

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            new = (pdf[names] != pdf[names].shift()).any(axis=1).cumsum().to_numpy()
            masks, weights, value = (pdf[c].to_numpy() for c in ("mask", "w", "value"))
            for a, b in runs(new):
                counters = VerticalCounters(masks[a:b], weights[a:b])
                n = counters.counts(lanes)
                there = lanes[n > 0]
                low, high = counters.select(there, np.ones(len(there))), counters.select(there, n[there])
                first = pdf.iloc[a]
                out.append(pd.DataFrame({**{c: [first[c]] * len(there) for c in names}, "batch": there, "n": n[there], "least": value[a:b][low], "greatest": value[a:b][high]}))
            if out:
                yield pd.concat(out, ignore_index=True)

    blocks = placed.mapInPandas(measure, "part int, group string, block long, batch int, n long, least long, greatest long")
    blocks = stored(blocks.groupBy(*names, "batch").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest")))

    def sought(found: DataFrame, rank: Column, within: list[str], order: str) -> DataFrame:
        """The rows of found in which the count by `order` reaches the rank, which is then one among theirs."""
        earlier = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        found = found.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        return found.withColumn("rank", rank - F.col("before")).where("rank between 1 and n")

    whole = F.sum("n").over(Window.partitionBy("group", "batch"))
    parts = blocks.groupBy("part", "group", "batch").agg(F.sum("n").alias("n")).withColumn("half", F.floor(whole / 2) + 1)
    parts = sought(parts, F.col("half"), ["group", "batch"], "part").select("part", "group", "batch", F.col("rank").alias("half"))
    wanted = sought(blocks.join(parts, ["part", "group", "batch"]), F.col("half"), ["part", "group", "batch"], "block").select(*names, "batch", "rank")
    wanted = stored(wanted)

    def pick(pdf: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value", kind="stable")
        at = VerticalCounters(pdf["mask"].to_numpy(), pdf["w"].to_numpy()).select(asked["batch"].to_numpy(), asked["rank"].to_numpy())
        return pd.DataFrame({"group": asked["group"], "batch": asked["batch"], "median": pdf["value"].to_numpy()[at]})

    own = placed.join(wanted.select(*names).distinct(), names, "left_semi")
    middle = stored(own.groupBy(*names).cogroup(wanted.groupBy(*names)).applyInPandas(pick, "group string, batch int, median long"))
    ends = blocks.groupBy("group", "batch").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    return ends.unionByName(middle, allowMissingColumns=True), [histogram, placed, blocks, wanted, middle]


def aggregates_by_batch(rows: DataFrame, keys: list[str], item: str = "item", value: str = "value", mask: str = "mask", batches: int = BATCHES) -> DataFrame:
    """Per group and batch (keys, batch from 0): n_rows, n_distinct, total, least, greatest, median, old_ and new_ of each,
    where any of them changes with the batch.

    rows: one for each lifetime, with its group, an item (any text or binary; null: not counted as different), a long
    value (null: in n_rows only) and a mask of at most 62 batches (null or 0: never there). The lifetimes of one record
    are rows of their own, and their masks should not overlap. median: position floor(n / 2) + 1 of all n values
    ascending. Before batch 0 there is nothing; without rows n_rows, n_distinct and total are 0 and the others null.
    Null keys are a group. Items are told apart by SHA-256, so long texts are not moved; ties and repeated rows count
    each; other columns are not read; an empty table gives no rows.
    """
    if not 0 < batches <= 62:
        raise ValueError("1 to 62 batches")
    ks = [f"_k{p}" for p in range(len(keys))]
    group = F.to_json(F.struct(*ks)) if keys else F.lit("")  # one text for the keys, null or not
    rows = rows.select(*(F.col(f"`{k}`").alias(x) for k, x in zip(keys, ks, strict=True)), F.col(f"`{item}`").alias("item"), F.col(f"`{value}`").cast("long").alias("value"), F.col(f"`{mask}`").cast("long").alias("mask"))
    rows = rows.where("mask != 0").withColumn("group", group)
    sums = rows.groupBy("group", *ks, "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    sums = stored(sums)
    every = _by_batch(sums, {"n_rows": "n", "total": "total"}, batches)
    items = rows.where("item is not null").groupBy("group", F.unhex(F.sha2(F.col("item").cast("binary"), 256)).alias("item")).agg(F.bit_or("mask").alias("mask"))
    different = _by_batch(items.groupBy("group", "mask").agg(F.count(F.lit(1)).alias("n")), {"n_distinct": "n"}, batches)
    ordered, tables = _orders(rows, batches)
    groups = sums.select("group", *ks).distinct()
    grid = groups.select("group", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"))
    found = grid.unionByName(every, allowMissingColumns=True).unionByName(different, allowMissingColumns=True).unionByName(ordered, allowMissingColumns=True)
    found = found.groupBy("group", "batch").agg(*(F.max(m).alias(m) for m in MEASURES))
    zero = ["n_rows", "n_distinct", "total"]
    found = found.withColumns({m: F.coalesce(m, F.lit(0)) for m in zero})
    before = Window.partitionBy("group").orderBy("batch")
    old = {f"old_{m}": F.coalesce(F.lag(m).over(before), F.lit(0)) if m in zero else F.lag(m).over(before) for m in MEASURES}
    found = found.withColumns(old)
    changed: Column = F.lit(False)
    for m in MEASURES:
        changed = changed | ~F.col(f"old_{m}").eqNullSafe(F.col(m))
    sides = [F.col(c).cast("long").alias(name) for m in MEASURES for c, name in ((f"old_{m}", f"old_{m}"), (m, f"new_{m}"))]
    found = found.where(changed).join(groups, "group")
    out = stored(found.select("batch", *(F.col(x).alias(k) for k, x in zip(keys, ks, strict=True)), *sides))
    drop_stored(sums, *tables)
    return out


def lifetimes(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(source, lang, item, value, mask): the one or two lifetimes of each document, by the crc32 of its id; null ids never enter."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    docs = docs.select(
        F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), F.col("n_chars").cast("long").alias("n_chars"),
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("item"), (h % batches).cast("int").alias("b"), F.expr(f"cast(crc32(encode(cast(doc_id as string), 'UTF-8')) div {batches} % 4 as int)").alias("q"),
    )
    docs = docs.withColumn("leave", F.least(F.col("b") + F.col("q"), F.lit(batches)))
    first = "named_struct('value', n_chars, 'mask', shiftleft(1L, leave) - shiftleft(1L, b))"
    second = f"named_struct('value', n_chars + q, 'mask', if(q % 3 = 0, shiftleft(1L, {batches}) - shiftleft(1L, leave), 0L))"
    return docs.select("source", "lang", "item", F.expr(f"inline(array({first}, {second}))")).where("mask != 0")


def op12_batch_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each batch changes in the aggregates of documents by source and lang (null: empty string)."""
    return aggregates_by_batch(lifetimes(read(spark, sf_dir, "documents")), ["source", "lang"])


_CRC = """list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, c: list_reduce(list_concat([xor(crc, c)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))"""

OP12_SQL = f"""
WITH h AS (SELECT *, xor({_CRC}, 4294967295::BIGINT) AS h FROM documents WHERE doc_id IS NOT NULL),
docs AS (SELECT coalesce(source, '') AS source, coalesce(lang, '') AS lang, text, n_chars, h % 20 AS b, (h // 20) % 4 AS q FROM h),
lives AS (
  SELECT source, lang, text, n_chars AS v, b AS enters, b + q AS leaves FROM docs WHERE q > 0
  UNION ALL SELECT source, lang, text, n_chars + q, b + q, 99 FROM docs WHERE q IN (0, 3)),
there AS (SELECT t.batch, l.* FROM lives l JOIN (SELECT unnest(range(20)) AS batch) t ON t.batch >= enters AND t.batch < leaves),
grid AS (SELECT batch, source, lang FROM (SELECT DISTINCT source, lang FROM lives), (SELECT unnest(range(20)) AS batch)),
aggregates AS (
  SELECT batch, source, lang, count(*) AS n_rows, count(DISTINCT text) AS n_distinct, coalesce(sum(v), 0)::BIGINT AS total,
    min(v) AS least, max(v) AS greatest, list_sort(list(v) FILTER (v IS NOT NULL))[count(v) // 2 + 1] AS median
  FROM there GROUP BY 1, 2, 3),
filled AS (
  SELECT batch, source, lang, coalesce(n_rows, 0) AS n_rows, coalesce(n_distinct, 0) AS n_distinct, coalesce(total, 0) AS total, least, greatest, median
  FROM grid LEFT JOIN aggregates USING (batch, source, lang)),
both_sides AS (
  SELECT batch::INTEGER AS batch, source, lang, {", ".join(f"{f'coalesce(lag({m}) OVER w, 0)' if m in ('n_rows', 'n_distinct', 'total') else f'lag({m}) OVER w'}::BIGINT AS old_{m}, {m}::BIGINT AS new_{m}" for m in MEASURES)}
  FROM filled WINDOW w AS (PARTITION BY source, lang ORDER BY batch))
SELECT * FROM both_sides WHERE {" OR ".join(f"old_{m} IS DISTINCT FROM new_{m}" for m in MEASURES)}
"""
