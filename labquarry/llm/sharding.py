"""Sharding by fixed virtual slots: a record's hash names one of thousands of slots for good, and a small versioned
map says which shard holds each slot. Rebalancing edits the map; no record is hashed anew.

Maps are tables in the shared folder, one for each version; versions are never changed. A run reads the latest version,
moves as few slots as balance asks for, and stores the next version only if a slot moved."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, numbered, read, shared_folder, stored, text_bytes

SLOTS = 16384


@dataclass(frozen=True)
class SlotMap:
    """shards[i] holds slot i; version grows by one with every edit, edits lists (version, slot, from, to)."""

    shards: tuple[int, ...]
    version: int = 1
    edits: tuple[tuple[int, int, int, int], ...] = field(default=(), compare=False)

    @staticmethod
    def first(n_shards: int, slots: int = SLOTS) -> SlotMap:
        return SlotMap(tuple(i % n_shards for i in range(slots)))

    def rebalanced(self, slot_bytes: dict[int, int], n_shards: int | None = None) -> SlotMap:
        """The next version: slots move, one at a time, from the fullest shard that can to the emptiest, narrowing their gap.

        The slot moved is the one nearest to half the gap, ties to the smaller slot. Slots without bytes stay.
        The work depends on the number of slots alone. Where nothing moves, the map itself is returned.
        """
        shards = list(self.shards)
        n = n_shards or max(shards) + 1
        shards = [s if s < n else i % n for i, s in enumerate(shards)]  # shards that are to go give up their slots
        load = [0] * n
        own: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for slot, size in sorted(slot_bytes.items()):
            load[shards[slot]] += size
            if size:
                own[shards[slot]].append((size, slot))
        edits = []
        for _ in range(8 * len(shards)):
            by_load = sorted(range(n), key=lambda s: (load[s], s))
            low, move = by_load[0], None
            for high in reversed(by_load[1:]):  # the fullest may hold nothing that can move
                gap = load[high] - load[low]
                if move := min(((abs(2 * size - gap), slot, size) for size, slot in own[high] if size < gap), default=None):
                    break
            if not move:
                break
            _, slot, size = move
            own[high].remove((size, slot))
            own[low].append((size, slot))
            load[high] -= size
            load[low] += size
            edits.append((self.version + 1, slot, high, low))
            shards[slot] = low
        return self if tuple(shards) == self.shards else SlotMap(tuple(shards), self.version + 1, self.edits + tuple(edits))

    def frame(self, spark: SparkSession) -> DataFrame:
        """The map as a table (version, virtual_slot, shard)."""
        rows = [(self.version, i, s) for i, s in enumerate(self.shards)]
        return spark.createDataFrame(rows, "version int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, folder: str) -> None:
        """Stores this version in the folder; fails if it is there already, so that two writers cannot both make it."""
        self.frame(spark).coalesce(1).write.mode("errorifexists").parquet(f"{folder}/version-{self.version:06}")


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Versions stored whole in the folder, oldest first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/version-*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(f.getPath().getParent().getName().removeprefix("version-")) for f in found or [])


def load(spark: SparkSession, folder: str, version: int | None = None) -> SlotMap | None:
    """The map of that version, or the latest; None if there is none. edits lists what changed since the version before."""
    there = versions(spark, folder)
    if version is None:
        version = there[-1] if there else None
    if version is None or version not in there:
        return None
    now, before = ([r["shard"] for r in spark.read.parquet(f"{folder}/version-{v:06}").orderBy("virtual_slot").collect()] if v in there else [] for v in (version, version - 1))
    edits = tuple((version, i, a, b) for i, (a, b) in enumerate(zip(before, now, strict=False)) if a != b)
    return SlotMap(tuple(now), version, edits)


def with_slots(df: DataFrame, keys: list[str], slots: int = SLOTS) -> DataFrame:
    """Adds virtual_slot, fixed for good by the values of keys (a clashing column of that name is replaced)."""
    return df.withColumn("virtual_slot", F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(slots)).cast("int"))


def slot_bytes(df: DataFrame, size: str) -> dict[int, int]:
    """Bytes of each slot in use: at most as many rows as there are slots reach the driver."""
    return {r["virtual_slot"]: r["b"] for r in df.groupBy("virtual_slot").agg(F.sum(size).alias("b")).collect()}


def shard_of(slot_map: SlotMap, slot: str = "virtual_slot"):
    """The shard of a slot, looked up in an array literal that holds the map (bounded by the number of slots)."""
    return F.element_at(F.array(*map(F.lit, slot_map.shards)), F.col(slot) + 1)


def assign_shards(df: DataFrame, keys: list[str], size: str, n_shards: int = 16, slots: int = SLOTS, slot_map: SlotMap | None = None, folder: str | None = None) -> tuple[DataFrame, SlotMap]:
    """df with virtual_slot and shard, and the map that placed its rows; shards get nearly equal sums of size.

    The map is slot_map, or else the latest in the folder, or else a first one, rebalanced for the sizes of df; if a
    folder is given, new versions are stored there. Rows equal in every key share a slot; null keys are values like
    others; a null size counts nothing. Columns virtual_slot and shard of df are replaced. An empty table gives an
    empty result and leaves the map as it is.
    """
    spark = df.sparkSession
    placed = with_slots(df, keys, slots)
    if slot_map is None:
        slot_map = load(spark, folder) if folder else None
    if slot_map is None:
        slot_map = SlotMap.first(n_shards, slots)
        if folder:
            slot_map.save(spark, folder)
    sizes = slot_bytes(placed, size)
    now = slot_map.rebalanced({k: v or 0 for k, v in sizes.items()}, n_shards) if sizes else slot_map
    if folder and now.version != slot_map.version:
        now.save(spark, folder)
    table = now.frame(spark).select("virtual_slot", "shard")
    return placed.drop("shard").join(F.broadcast(table), "virtual_slot"), now  # one row for each of a fixed number of slots


def op4_fixed_virtual_slots(spark: SparkSession, sf_dir: str, n_shards: int = 16) -> DataFrame:
    """All documents in shards by law `bytes`: near-equal sums of size (UTF-8 bytes of the text, null: none, plus 1).

    The map is kept in the shared folder, one for each table, whatever the number of shards: a run over the same table
    finds and leaves it as it is, one that asks for more or fewer shards edits it, and only the slots of that edit move.
    slot is a row's place in its shard, gapless from 0, in order of virtual slot, doc_id and text.
    """
    docs = read(spark, sf_dir, "documents").select(
        "doc_id",
        (text_bytes(F.col("text")) + 1).alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    name = hashlib.md5(f"{sf_dir.rstrip('/')}/documents".encode()).hexdigest()
    docs = stored(docs)
    placed, _ = assign_shards(docs, ["doc_id", "text_crc32", "size"], "size", n_shards, folder=f"{shared_folder(spark)}/slot-maps/{name}")
    out = numbered(placed, ["shard"], ["virtual_slot", "doc_id", "text_crc32", "size"], "slot")
    drop_stored(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
