"""Exact deduplication of a stream of documents, with state that is kept for good.

Documents arrive as files. A streaming aggregation keeps in RocksDB, without expiry, a row for each digest: how many
documents have had it, and of the one that stays its id and its locator (file and place in the file). Equal digests are
only hits: the whole texts of a hit's documents are compared with the content at the locator, and digests that stand for
different texts are settled by the texts themselves. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_folder
from .common import drop_stored, join_by_key, sieve, stored

#: What normalisation deletes: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
#: Files that a micro-batch takes.
FILES = 1000
#: State lives in RocksDB; a task closes its part after the commit, so that open parts (4 MB of local disk each at least) do not add up.
_STATE = {"providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "unloadOnCommit": "true"}

def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


@contextmanager
def _rocksdb(spark: SparkSession):
    keys = {f"spark.sql.streaming.stateStore.{k}": v for k, v in _STATE.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


@dataclass
class StreamingDedup:
    """A deduplication whose state lies in `folder` (a checkpoint of Structured Streaming in a shared folder) and grows with each call of absorb.

    files: a path of Parquet files with columns doc_id (long) and text; files added later are absorbed by the next call.
    digest: of a normalised text; any function of it gives right results, a weak one only more to compare.
    """

    spark: SparkSession
    files: str
    folder: str
    digest: Callable[[Column], Column] = sha256
    _tables: list[DataFrame] = field(default_factory=list)

    def _rows(self, source: DataFrame) -> DataFrame:
        text = F.coalesce("text", F.lit(""))
        return source.select("doc_id", text.alias("text"), normalised(text).alias("normal"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))

    def absorb(self, files_a_batch: int = FILES) -> None:
        """Takes in all files that are there and have not been taken in."""
        spark = self.spark
        source = spark.readStream.schema(spark.read.parquet(self.files).schema).option("maxFilesPerTrigger", files_a_batch)
        rows = self._rows(source.parquet(f"{self.files[:-1]}[{self.files[-1]}]"))  # a pattern, as a stream takes no path of a single file
        best = F.struct((-F.char_length("text")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")  # the least one stays
        state = rows.select(self.digest(F.col("normal")).alias("digest"), best.alias("best")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("best").alias("best"))
        with _rocksdb(spark):
            writer = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", self.folder)
            writer.trigger(availableNow=True).start().awaitTermination()

    def state(self) -> DataFrame:
        """(digest, n, keep_id, file, row) as the state store has them."""
        kept = self.spark.read.format("statestore").load(self.folder)
        return kept.select("key.digest", F.col("value.count").alias("n"), F.col("value.min.doc_id").alias("keep_id"), F.col("value.min.file").alias("file"), F.col("value.min.row").alias("row"))

    def verdicts(self) -> DataFrame:
        """One row for each document that was absorbed: doc_id, keep_id, group_size, kept, text_sha256.

        Of documents with equal normalised texts the one with the most code points stays, then the smallest doc_id (null
        ids last), then the first by file and place: one row of each group is kept, also where ids repeat. Null texts
        are empty ones, and empty texts are equal. Very long texts are compared whole. Other columns are not read. A table without rows gives none.
        """
        spark = self.spark
        source = self._rows(spark.read.parquet(self.files)).withColumn("digest", self.digest(F.col("normal")))
        sha = F.lower(F.hex(sha256(F.col("normal")))) if self.digest is not sha256 else F.lower(F.hex("digest"))
        rows = stored(source.select("doc_id", "digest", sha.alias("text_sha256"), "file", "row", F.char_length("text").alias("length")))
        hits = stored(self.state().where("n > 1"))
        self._tables += [rows, hits]
        h = F.xxhash64("digest")
        # The whole texts of hits, against the text at the locator. The least and the greatest are found before the
        # shuffle, so that a task passes on two texts of a group at most.
        could, texts = sieve(source.select("digest", "normal"), h, hits, h)
        ends = texts.where(could).groupBy("digest").agg(F.min("normal").alias("low"), F.max("normal").alias("high"))
        kept = source.join(hits.select("file", "row"), ["file", "row"], "left_semi").select("digest", F.col("normal").alias("kept"))
        differ = stored(kept.join(ends, "digest").where("low != kept or high != kept").select("digest"))
        self._tables.append(differ)
        could, rows = sieve(rows, h, hits, h)
        alone = rows.where(~could).withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
        rows = rows.where(could)
        many = hits.select("digest", "n", "keep_id", F.col("file").alias("_file"), F.col("row").alias("_row"))
        names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
        if not (collided := not differ.isEmpty()):
            some = rows
        else:
            some, many = rows.join(differ, "digest", "left_anti"), many.join(differ, "digest", "left_anti")
        total = self._tables[0].count()
        joined = join_by_key(some, many, ["digest"], "n", total, "left")
        is_it = F.col("_row").isNull() | ((F.col("row") == F.col("_row")) & (F.col("file") == F.col("_file")))
        joined = joined.withColumns({"keep_id": F.when(F.col("_row").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")), "group_size": F.coalesce("n", F.lit(1)), "kept": is_it})
        out = alone.select(names).unionByName(joined.select(names))
        if collided:
            own = source.join(differ, "digest").withColumn("text_sha256", sha)
            best = F.struct((-F.char_length("text")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")
            found = own.groupBy("digest", "normal").agg(F.count(F.lit(1)).alias("group_size"), F.min(best).alias("best"))
            own = own.join(found, ["digest", "normal"]).withColumns({"keep_id": F.col("best.doc_id"), "kept": (F.col("row") == F.col("best.row")) & (F.col("file") == F.col("best.file"))})
            out = out.unionByName(own.select(names))
        return out

    def drop(self) -> None:
        """Deletes the tables that the last verdicts read, when no result of it is to be read any more; the state stays."""
        drop_stored(*self._tables)
        self._tables.clear()


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """verdicts() of any table with columns doc_id (long) and text, absorbed from a stored copy."""
    spark = docs.sparkSession
    copy = stored(docs.select("doc_id", "text"))
    files = next(iter({f.rsplit("/", 1)[0] for f in copy.inputFiles()}), None)
    if files is None:
        return spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string")
    dedup = StreamingDedup(spark, files, new_folder(spark))
    dedup.absorb()
    return dedup.verdicts()


def op13_streaming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each row of documents."""
    dedup = StreamingDedup(spark, f"{sf_dir.rstrip('/')}/documents.parquet", new_folder(spark))
    dedup.absorb()
    return dedup.verdicts()


_NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

OP13_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, {_NORMAL} AS normal FROM documents),
placed AS (
  SELECT doc_id, normal, count(*) OVER (PARTITION BY normal) AS group_size, first(doc_id) OVER w AS keep_id, row_number() OVER w = 1 AS kept
  FROM docs WINDOW w AS (PARTITION BY normal ORDER BY length(text) DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, kept, sha256(normal) AS text_sha256 FROM placed
"""
