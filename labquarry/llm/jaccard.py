"""Jaccard join of texts on word shingles by the chosen-path method.

A text's set is its shingles of five words; the sets are embedded in min-hash coordinates, each the shared-token sample
of one hash function. A run starts from one coordinate and sends a text down the path that its value names; texts on
the same path meet in a bucket. Buckets that are not small are split on further coordinates, sampled by the path, two
for each level, so that a pair keeps a path in common with high probability. Small buckets are compared by brute force:
first the sketches, then the exact sets of those texts that have a likely partner. Buckets that no split makes small
(texts all alike) are compared in a grid of blocks; a block has the square root of the bucket's texts, from 256 to 2048.
Runs repeat until a pair at the threshold is missed with a probability below 1 - RECALL.

Each pair is counted in the first bucket that holds both texts and in no other, so nothing has to list all pairs: a
bucket gives each text's links and the edges of a spanning forest. Sides that grow with the corpus are joined by shuffles
(hint merge) at any size; texts are moved only for representatives with a likely partner, which a sieve picks out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, drop_stored, join_by_key, local_forest, parts_for, read, runs, sieve, stored, whole_groups

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.99999
#: Min-hash coordinates of a text; runs take the first ones, splits sample from the others.
COORDINATES = 64
#: Larger buckets are split further, for so many levels, on so many coordinates each.
SMALL_BUCKET = 128
LEVELS = 2
BRANCHES = 2
#: A bucket that a split has left with more than this share of its texts is not split again.
DENSE = 0.6
#: Buckets still larger are compared in blocks of so many texts, at least and at most.
BLOCK, MOST_BLOCK = 256, 2048
#: Rows a task compares, about.
COMPARED = 20_000
#: Sketches agree on this share of coordinates for less than one in 100,000 pairs below it.
SKETCH_MARGIN = 0.27

_WORD = re.compile(r"\w+")
_rng = np.random.default_rng(20240607)
_MULTIPLY = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def n_runs(threshold: float = THRESHOLD, recall: float = RECALL, levels: int = LEVELS, branches: int = BRANCHES) -> int:
    """Runs after which a pair at the threshold has met with the probability asked for, even where buckets are split."""
    met = threshold * (1 - (1 - threshold) ** branches) ** levels
    return math.ceil(math.log(1 - recall) / math.log(1 - met))


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-word shingles, words in lower case; a shorter text is one shingle."""
    found = _WORD.findall((text or "").lower())
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    m = min(n, len(h))
    out = np.full(len(h) - m + 1, np.uint64(m), np.uint64)
    for k in range(m):
        out = (out ^ h[k : len(h) - m + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def sketch(tokens: np.ndarray) -> bytes:
    """COORDINATES min-hashes of 32 bits; the work goes in slices, so that long texts need no more memory."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(tokens), 1024):
        least = np.minimum(least, (tokens[None, k : k + 1024] * _MULTIPLY[:, None] + _ADD[:, None]).min(1))
    return (least >> np.uint64(32)).astype("<u4").tobytes()


def text_key(text: F.Column) -> F.Column:
    """16 bytes, equal for equal texts; null texts count as empty ones."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def sketched(docs: DataFrame) -> DataFrame:
    """(id, key, sig) of docs (id, key, text); sig is null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = []
            for text in batch.column("text").to_pylist():
                tokens = shingles(text)
                sigs.append(sketch(tokens) if len(tokens) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(sigs, pa.binary())], ["id", "key", "sig"])

    return docs.select("id", "key", "text").mapInArrow(run, "id long, key binary, sig binary")


def _coordinate(k) -> F.Column:
    return F.substring(F.col("sig"), k * 4 + 1, F.lit(4))


def leaves(reps: DataFrame, run_count: int) -> DataFrame:
    """(rep, path, n): the buckets of two texts or more that paths end in. reps (rep, sig) is read several times."""
    first = reps.select("rep", "sig", F.explode(F.array(*map(F.lit, range(run_count)))).alias("run"))
    now = first.select("rep", F.xxhash64("run", _coordinate(F.col("run"))).alias("path"), F.lit(None).cast("long").alias("parent_n"))
    done = None
    for level in range(LEVELS + 1):
        sizes = now.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        now = stored(now.join(sizes.hint("merge"), "path"))
        # Texts all alike stay together however often they are split: such a bucket is left as it is.
        apart = (F.col("n") > SMALL_BUCKET) & (F.lit(level < LEVELS)) & (F.col("parent_n").isNull() | (F.col("n") <= DENSE * F.col("parent_n")))
        small = now.where(~apart)
        done = small if done is None else done.union(small)
        large = now.where(apart).select("rep", "path", "n")
        if level == LEVELS or large.isEmpty():
            break
        large = large.withColumn("branch", F.explode(F.array(*map(F.lit, range(BRANCHES))))).join(reps.hint("merge"), "rep")
        at = F.pmod(F.xxhash64("path", "branch"), F.lit(COORDINATES - run_count)) + run_count
        now = large.select("rep", F.xxhash64("path", "branch", at, _coordinate(at.cast("int"))).alias("path"), F.col("n").alias("parent_n"))
    return done.select("rep", "path", "n")


def blocks_of(n: F.Column) -> F.Column:
    """Blocks of a bucket of n texts."""
    size = F.least(F.lit(MOST_BLOCK), F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(n))))
    return F.when(n <= SMALL_BUCKET, 1).otherwise(F.ceil(n / size)).cast("int")


def grid(members: DataFrame) -> DataFrame:
    """members (path, rep, n, ...) with gid, side: small buckets whole, large ones as pairs of blocks.

    Block a meets blocks b >= a: a row goes to as many groups as there are blocks, and each pair of rows meets in one.
    """
    m = members.withColumn("_blocks", blocks_of(F.col("n")))
    m = m.withColumn("_own", F.pmod(F.xxhash64("rep", "path"), F.col("_blocks")).cast("int"))
    m = m.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    gid = F.xxhash64("path", F.least("_own", "_other"), F.greatest("_own", "_other"))
    side = F.when(F.col("_own") == F.col("_other"), 0).when(F.col("_own") < F.col("_other"), 1).otherwise(2)
    return m.withColumns({"gid": gid, "side": side}).drop("_blocks", "_own", "_other")


def _first_shared(paths: np.ndarray, path: int) -> np.ndarray:
    """pairs[i, j]: path is the smallest of the paths that rows i and j share. paths: one sorted row each, padded with the largest."""
    earlier = [row[row < path] for row in paths]
    out = np.ones((len(paths), len(paths)), bool)
    values = np.concatenate(earlier) if earlier else np.zeros(0, np.int64)
    if not len(values):
        return out
    _, at = np.unique(values, return_inverse=True)
    has = np.zeros((len(paths), at.max() + 1), np.float32)
    has[np.repeat(np.arange(len(paths)), [len(x) for x in earlier]), at] = 1
    return has @ has.T == 0


def _allowed(side: np.ndarray) -> np.ndarray:
    """Pairs that this group has to compare: all of a block with itself, else only those across the two blocks."""
    out = np.triu(np.ones((len(side), len(side)), bool), 1)
    across = (side[:, None] > 0) & (side[None, :] > 0)
    return out & (~across | (side[:, None] != side[None, :]))


def _likely(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Of each group, the texts with a partner whose sketch is near enough; pairs met before are no reason."""
    for pdf in whole_groups(batches, "gid"):
        keep = np.zeros(len(pdf), bool)
        gids, side = pdf["gid"].to_numpy(), pdf["side"].to_numpy()
        sigs = np.frombuffer(b"".join(pdf["sig"]), "<u4").reshape(len(pdf), COORDINATES)
        paths, path = pdf["paths"].to_list(), pdf["path"].to_numpy()
        for a, b in runs(gids):
            if b - a < 2:
                continue
            s = sigs[a:b]
            alike = np.zeros((b - a, b - a), np.int16)
            for k in range(COORDINATES):
                alike += s[:, k, None] == s[None, :, k]
            near = (alike >= (threshold - SKETCH_MARGIN) * COORDINATES) & _allowed(side[a:b])
            if near.any():
                near &= _first_shared([np.asarray(p) for p in paths[a:b]], path[a])
                keep[a:b] = near.any(0) | near.any(1)
        if keep.any():
            yield pdf.loc[keep, ["gid", "side", "path", "rep", "paths", "n_same"]]


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of incidence matrices over slices of the shared tokens."""
    n = len(sets)
    values = np.concatenate(sets)
    who = np.repeat(np.arange(n), [len(s) for s in sets])
    ids, at, counts = np.unique(values, return_inverse=True, return_counts=True)
    shared = counts > 1
    column = np.cumsum(shared) - 1
    keep = shared[at]
    who, at = who[keep], column[at[keep]]
    out = np.zeros((n, n), np.float32)
    order = np.argsort(at, kind="stable")
    who, at = who[order], at[order]
    width = max(1, (1 << 22) // max(1, n))
    for k in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(at, [k, k + width])
        has = np.zeros((n, width), np.float32)
        has[who[lo:hi], at[lo:hi] - k] = 1
        out += has @ has.T
    return out


def _verified(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Exact links of each group: rows (rep, links) and rows (rep, other) of a spanning forest."""
    for pdf in whole_groups(batches, "gid"):
        rep, links, other = [], [], []
        for a, b in runs(pdf["gid"].to_numpy()):
            part = pdf.iloc[a:b]
            sets = [shingles(t) for t in part["text"]]
            size = np.array([len(s) for s in sets], np.float64)
            both = intersections(sets).astype(np.float64)
            with np.errstate(invalid="ignore", divide="ignore"):
                linked = both / (size[:, None] + size[None, :] - both) >= threshold
            linked &= _allowed(part["side"].to_numpy())
            if not linked.any():
                continue
            linked &= _first_shared([np.asarray(p) for p in part["paths"]], part["path"].iloc[0])
            ids, same = part["rep"].to_numpy(), part["n_same"].to_numpy()
            total = linked @ same + linked.T @ same
            for i in np.flatnonzero(total):
                rep.append(ids[i])
                links.append(total[i])
                other.append(None)
            x, y = np.nonzero(linked)
            for i, j in zip(*local_forest(ids[x], ids[y]), strict=True):
                rep.append(i)
                links.append(0)
                other.append(j)
        if rep:
            yield pd.DataFrame({"rep": pd.array(rep, "int64"), "links": pd.array(links, "int64"), "other": pd.array(other, "Int64")})


def _id_key(id_: F.Column) -> F.Column:
    """The id as text; empty for null, which no id is."""
    return F.coalesce(id_.cast("string"), F.lit(""))


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (rep, key, low) with the text of each: one pass over docs, of which only rows that a sieve lets through are moved.

    One row of each text is looked for, that of the smallest id, so that copies stay where they are.
    """
    keyed = docs.select("key", _id_key(F.col("id")).alias("idk"), "text")
    wanted = wanted.select("rep", "key", _id_key(F.col("low")).alias("idk"))
    passes, joined = sieve(keyed, F.xxhash64("key", "idk"), wanted, F.xxhash64("key", "idk"))
    some = joined.where(passes).groupBy("key", "idk").agg(F.first("text").alias("text"))  # repeated rows combine where they are
    return wanted.join(some.hint("merge"), ["key", "idk"]).select("rep", "text")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(id, key, group, class_id, n_links) of docs (id long, text): one row for each row of docs.

    n_links: how many other rows have a Jaccard similarity of at least the threshold, equal texts included.
    group: a number for the texts reachable by links; class_id: the smallest id among their rows, null if all are null.
    Null texts, empty ones and those without a word link with nothing, and each row of theirs is its own class (group
    is null). Repeated ids count as rows of their own; very long texts are compared whole; an empty table gives an empty
    result; extra columns are ignored. docs is read twice.
    """
    spark = docs.sparkSession
    run_count = n_runs(threshold, recall)
    docs = docs.select("id", text_key(F.col("text")).alias("key"), "text")
    rows = stored(sketched(docs))
    total = rows.count()
    # Equal texts are one representative, numbered by a hash of their key; counts combine before the shuffle.
    same = rows.where("sig is not null").groupBy("key").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n_same"), F.first("sig").alias("sig"))
    same = stored(same.withColumn("rep", F.xxhash64("key")))
    found = stored(leaves(same.select("rep", "sig"), run_count))
    of_rep = found.groupBy("rep").agg(F.sort_array(F.collect_list("path")).alias("paths"))  # at most runs * branches^levels
    members = found.join(of_rep.join(same.select("rep", "n_same", "sig").hint("merge"), "rep").hint("merge"), "rep")
    n = parts_for(spark, found.agg(F.sum(blocks_of(F.col("n")))).first()[0] or 0, COMPARED)
    dealt = grid(members).repartition(n, "gid").sortWithinPartitions("gid")
    kept = "gid long, side int, path long, rep long, paths array<long>, n_same long"
    likely = dealt.select("gid", "side", "path", "rep", "paths", "n_same", "sig").mapInPandas(lambda b: _likely(b, threshold), kept)
    likely = stored(likely)
    drop_stored(found)
    wanted = stored(likely.select("rep").distinct().join(same.select("rep", "key", "low"), "rep"))
    n = parts_for(spark, likely.count(), COMPARED)
    dealt = likely.join(_texts_of(docs, wanted).hint("merge"), "rep").repartition(n, "gid").sortWithinPartitions("gid")
    links = dealt.select("gid", "side", "path", "rep", "paths", "n_same", "text").mapInPandas(lambda b: _verified(b, threshold), "rep long, links long, other long")
    links = stored(links)
    drop_stored(likely, wanted)
    classes = components(links.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    summed = links.groupBy("rep").agg(F.sum("links").alias("links"))
    table = same.select("key", "rep", "low", "n_same").join(summed, "rep", "left").join(classes.withColumnRenamed("id", "rep"), "rep", "left")
    table = stored(table.select("key", "low", "n_same", F.coalesce("component", "rep").alias("group"), (F.coalesce("links", F.lit(0)) + F.col("n_same") - 1).alias("n_links")))
    lowest = stored(table.groupBy("group").agg(F.min("low").alias("class_id"), F.count(F.lit(1)).alias("_texts")))
    by_key = stored(join_by_key(table.drop("low"), lowest, ["group"], "_texts", table.count()).drop("_texts"))
    drop_stored(same, links, table, lowest)
    result = ["id", "key", "group", "class_id", "n_links"]
    worded = join_by_key(rows.where("sig is not null").select("id", "key"), by_key, ["key"], "n_same", total).select(*result)
    wordless = rows.where("sig is null").select("id", "key", F.lit(None).cast("long").alias("group"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return worded.union(wordless)


def op8_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), "class_id", "n_links")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of documents linked as near copies, directly or through others, one of the smallest id stays.

    Rows that link with nothing stay as they are, however often they come: null texts, empty ones, texts without a
    word. Where several rows of a group have its smallest id, one of them stays; if all ids are null, one row of the
    group does. Very long texts are compared whole; an empty table stays empty; columns of any name are carried along.
    The rows to go are listed; only documents that a sieve over that list lets through are moved.
    """
    names = docs.columns
    found = near_duplicates(docs.select(F.col("doc_id").cast("long").alias("id"), "text"))
    linked = stored(found.where("n_links > 0").select("id", "key", _id_key(F.col("id")).alias("idk"), "group", "class_id"))
    go = linked.where("not id <=> class_id").groupBy("key", "idk").agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(False))
    of_class = linked.where("id <=> class_id").groupBy("group", "key", "idk").agg(F.count(F.lit(1)).alias("_n"))
    chosen = of_class.groupBy("group").agg(F.min("key").alias("_first"))
    of_class = of_class.join(chosen, "group").withColumn("_one", F.col("key") == F.col("_first")).where("_n > 1 or not _one")
    acts = stored(go.union(of_class.select("key", "idk", "_n", "_one")))
    boxed = docs.select(F.struct(*(docs[f"`{c}`"] for c in names)).alias("row"), text_key(F.col("text")).alias("key"), _id_key(F.col("doc_id").cast("long")).alias("idk"))
    passes, joined = sieve(boxed, F.xxhash64("key", "idk"), acts, F.xxhash64("key", "idk"))
    clear = joined.where(~passes).select("row")
    maybe = stored(joined.where(passes).select("row", "key", "idk"))
    both = join_by_key(maybe, acts, ["key", "idk"], "_n", maybe.count(), "left")
    one = both.where("_one").groupBy("key", "idk").agg(F.first("row").alias("row")).select("row")
    drop_stored(linked)
    return clear.union(both.where("_one is null").select("row")).union(one).select("row.*")


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), h AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k / (x.n + y.n - k) >= 0.8
), l AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h), r AS (
  SELECT doc_id AS id, doc_id AS c FROM documents
  UNION
  SELECT l.b, r.c FROM r JOIN l ON l.a = r.id
), c AS (SELECT id, min(c) AS class_id FROM r GROUP BY 1), d AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT doc_id, class_id, coalesce(d.n, 0) AS n_links FROM documents JOIN c ON id = doc_id LEFT JOIN d ON a = doc_id
"""
