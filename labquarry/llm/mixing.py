"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every document of a source starts with the same real number of copies, target over size of the source. Whole copies
are kept; the fractional rests are rounded by pairs: mass (probability times size) moves at random from one document
to the other, in such proportions that expectations hold, until one of the two is integral. What is left of a block of
documents, one fractional document at most, goes up a reduction tree to be paired with the rests of other blocks.

The one fractional document that the tree leaves may be long. It is settled with a reserve of the source's shorter
documents, RESERVE of them or half of them if that is fewer, which did not go up the tree: longest first, mass moves
to the nearer side instead of at random, so that expectations hold for the tree and only nearly for the reserve. The source's mass is kept exactly until the last document of all, which goes to
the nearer side, so that the words taken miss the target by half its size at most: a few words, unless the reserve is
too small to take up a document that is long beside all of it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_stored, numbered, read, stored

#: Documents in a block of the reduction tree.
FAN_IN = 64
#: Documents of a source that settle the last of the tree, about.
RESERVE = 1024
WEIGHTS = (3.0, 1.0, 2.0)
#: Up to so many sources, their table is broadcast; beyond it, Spark joins it by a shuffle.
BROADCAST_SOURCES = 10_000


def words(text: Column) -> Column:
    """Words of a text, split at white space; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, total_share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, n, target) of sizes (source, size): water-filling in closed form.

    Targets share total_share of all sizes by weight (weights repeat over the sources by code point, null last);
    none exceeds cap times its source's size, and the excess is shared by weight among the others until none does.
    So target = min(cap * size, level * weight) for one level, found by running sums over the sources.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * cap)
    by = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_level", (F.sum("source_size").over(everything) * total_share - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # The first source, by rising cap a weight, whose cap the level does not exceed sets the level for all.
    s = s.withColumn("_at", F.row_number().over(by))
    first = F.min(F.when(F.col("_level") <= F.col("most") / F.col("weight"), F.struct("_at", "_level"))).over(everything)
    s = s.withColumn("_level", first["_level"])
    return s.select("source", "source_size", "n", F.least(F.col("most"), F.coalesce("_level", F.lit(math.inf)) * F.col("weight")).alias("target"))


def _uniform(*of: Column) -> Column:
    """A number in [0, 1) fixed by its arguments."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 40)) / F.lit(float(1 << 40))


_UNIT = "struct<id:bigint,alike:bigint,size:bigint,p:double>"


def _unit(id_: Column, alike: Column, size: Column, p: Column) -> Column:
    return F.struct(id_.alias("id"), alike.alias("alike"), size.alias("size"), p.alias("p"))


def _fold(units: Column, seed: int | None) -> Column:
    """struct(rest, up): the fractional unit left of an array of units, and those rounded up; the others are rounded down.

    A unit of mass p * size meets the rest so far; either the rest gains what it needs or the other has, or the other
    way: at random, or without a seed to the rest's nearer side.
    """
    start = F.struct(F.lit(None).cast(_UNIT).alias("rest"), F.array().cast(f"array<{_UNIT}>").alias("up"))

    def step(state: Column, u: Column) -> Column:
        r = state["rest"]
        gain = F.least((1 - r["p"]) * r["size"], u["p"] * u["size"])  # the rest may gain
        lose = F.least(r["p"] * r["size"], (1 - u["p"]) * u["size"])  # the rest may lose
        to_rest = r["p"] >= 0.5 if seed is None else _uniform(r["id"], r["alike"], u["id"], u["alike"], F.lit(seed)) * (gain + lose) < lose
        rest_fills = (1 - r["p"]) * r["size"] <= u["p"] * u["size"]
        rest_empties = r["p"] * r["size"] <= (1 - u["p"]) * u["size"]
        moved = F.when(to_rest, gain).otherwise(-lose)
        new_r = _unit(r["id"], r["alike"], r["size"], r["p"] + moved / r["size"])
        new_u = _unit(u["id"], u["alike"], u["size"], u["p"] - moved / u["size"])
        # One of the two is integral now: 1 or 0 for the one that filled or emptied.
        rest_done = F.when(to_rest, rest_fills).otherwise(rest_empties)
        other_up = F.when(to_rest, F.lit(False)).otherwise(F.lit(True))  # the other, if done: emptied or filled
        rest = F.when(r.isNull(), u).otherwise(F.when(rest_done, new_u).otherwise(new_r))
        done_up = F.when(rest_done, F.when(to_rest, r)).otherwise(F.when(other_up, u))
        # A tie makes both integral; the one carried on then has probability 0 or 1, and meets others harmlessly.
        return F.struct(rest.alias("rest"), F.when(r.isNull() | done_up.isNull(), state["up"]).otherwise(F.concat(state["up"], F.array(done_up))).alias("up"))

    return F.aggregate(units, start, step)


def copies(sizes: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, size, source, source_size, target, alike, drawn): of `alike` equal rows, copies drawn for all of them.

    sizes: (doc_id, size, source), read several times. Rows equal in all three are one unit with `alike` times the
    mass, so that repeats gather in no block. Rows of size 0 have no mass and are drawn 0 times. Null ids and null sources
    are values like others; an empty table gives an empty result. Reruns agree. The result is stored.
    """
    spark = sizes.sparkSession
    small = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    table = F.broadcast(targets) if small else targets
    same = sizes.groupBy("doc_id", "size", "source").agg(F.count(F.lit(1)).alias("alike"))
    t = table.withColumnRenamed("source", "_source")
    units = same.join(t, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    exact = F.col("alike") * F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # Rounding errors of a sum near a whole number must not leave a unit that is almost integral.
    near = F.abs(exact - F.round(exact)) < 1e-9
    units = units.withColumn("_base", F.when(F.col("size") == 0, 0).otherwise(F.when(near, F.round(exact)).otherwise(F.floor(exact))).cast("long"))
    units = units.withColumn("_p", F.when((F.col("size") == 0) | near, 0.0).otherwise(exact - F.floor(exact)))
    units = units.withColumn("_block", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / FAN_IN))))
    units = stored(units)
    apart = F.greatest(F.lit(2).cast("long"), F.ceil(F.col("n") / RESERVE))
    held_back = (F.col("size") * F.col("n") <= F.col("source_size")) & (F.pmod(F.xxhash64("size", "doc_id", F.lit(seed)), apart) == 0)
    level = units.where("_p > 0").select("source", "_block", _unit(F.xxhash64("doc_id", "size"), F.col("alike"), F.col("size"), F.col("_p")).alias("u"), held_back.alias("held"))
    reserve, level = level.where("held").select("source", "u"), level.where("not held")
    largest = units.agg(F.max("_block")).first()[0]
    blocks = 1 if largest is None else largest + 1
    ups, trees = [], []
    level = level.select("source", "_block", "u")
    depth = 0
    while True:
        folded = level.groupBy("source", "_block").agg(F.sort_array(F.collect_list("u")).alias("units"))
        folded = stored(folded.select("source", "_block", _fold(F.col("units"), seed + depth).alias("f")))
        trees.append(folded)
        ups.append(folded.select("source", F.explode("f.up").alias("u")))
        level = folded.where("f.rest is not null").select("source", F.expr(f"_block div {FAN_IN}").alias("_block"), F.col("f.rest").alias("u"))
        depth += 1
        if blocks <= 1:
            break
        blocks = math.ceil(blocks / FAN_IN)
    # The tree's last unit of a source comes first, then the reserve, longest first: what is left in the end is short.
    closing = level.select("source", F.lit(-(1 << 62)).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "u")
    closing = closing.union(reserve.select("source", -F.col("u.size"), F.xxhash64("u.id", F.lit(seed)), "u"))
    closing = closing.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("a", "b", "u"))).alias("units"))
    closing = stored(closing.select("source", _fold(F.transform("units", lambda x: x["u"]), None).alias("f")))
    trees.append(closing)
    ups.append(closing.select("source", F.explode("f.up").alias("u")))
    # The only unit still fractional goes to the nearer side: half its size at most is missed.
    ups.append(closing.where("f.rest.p >= 0.5").select("source", F.col("f.rest").alias("u")))
    up = ups[0]
    for x in ups[1:]:
        up = up.union(x)
    up = up.select(F.col("source").alias("_s"), F.col("u.id").alias("_id"), F.col("u.size").alias("_size"))
    on = units["source"].eqNullSafe(F.col("_s")) & (F.xxhash64(units["doc_id"], units["size"]) == F.col("_id")) & (units["size"] == F.col("_size"))
    out = units.join(up.hint("merge"), on, "left")  # grows with the corpus: never broadcast
    drawn = F.col("_base") + F.when(F.col("_id").isNotNull(), 1).otherwise(0)
    out = stored(out.select("doc_id", "size", "source", F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), "alike", drawn.cast("long").alias("drawn")))
    drop_stored(units, *trees)
    return out


def _shared_out(drawn: Column, alike: Column, number: Column) -> Column:
    """Copies of the row `number` (from 0) of `alike` equal rows: as equal as can be."""
    return F.floor(drawn / alike) + F.when(number < drawn % alike, 1).otherwise(0)


def op2_pivotal_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = stored(read(spark, sf_dir, "documents").select("doc_id", words(F.col("text")).alias("size"), "source"))
    drawn = copies(sizes, stored(source_targets(sizes)))
    drop_stored(sizes)
    rows = drawn.withColumn("_number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("alike") - 1)))
    taken = F.col("size") * _shared_out(F.col("drawn"), F.col("alike"), F.col("_number"))
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix draws it (0, 1 or 2 times), with its own columns.

    Null and empty texts have no words and are not drawn; a null source is a source like others; very long texts count
    whole. Rows alike in doc_id, size and source share their copies out as equally as can be. An empty table stays
    empty; columns of any name are carried along.
    """
    boxed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), "doc_id", words(F.col("text")).alias("size"), "source")
    sizes = stored(boxed.select("doc_id", "size", "source"))
    targets = stored(source_targets(sizes))
    all_drawn = copies(sizes, targets)
    drop_stored(sizes, targets)
    drawn = all_drawn.where("drawn > 0").select(*(F.col(c).alias(f"of_{c}") for c in ("doc_id", "size", "source")), "alike", "drawn")
    on = boxed["doc_id"].eqNullSafe(F.col("of_doc_id")) & (boxed["size"] == F.col("of_size")) & boxed["source"].eqNullSafe(F.col("of_source"))
    keys = ["doc_id", "size", "source"]
    joined = boxed.join(drawn.hint("merge"), on).select("row", *keys, "alike", "drawn")
    out = joined.where("alike = 1").select("row", F.col("drawn").alias("times"))
    if not all_drawn.where("drawn > 0 and alike > 1").isEmpty():
        several = joined.where("alike > 1").withColumn("order", F.xxhash64("row.text"))
        several = numbered(several, keys, ["order"])
        out = out.union(several.select("row", _shared_out(F.col("drawn"), F.col("alike"), F.col("number"))))
    times = F.col("times").cast("int")
    return out.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), times)).alias("copy")).select("row.*")
