"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Every row is indexed; only the centroids and code books are fitted on a bounded sample. A query visits the cells of
its nearest centroids and ranks their vectors by asymmetric distance tables; lists hold codes and ids alone. The original
vectors of the best are then fetched by one join, and reranked by exact distances. How many cells are visited, and how
many candidates are reranked, follows from the recall wanted, measured on the sample with the codes applied. Vectors of
different lengths never meet: each length has an index of its own, all in one pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_stored, parts_for, read, runs, stored, whole_groups
from .rangejoin import LEAST_OF_LENGTH, by_length, sampled, usable

#: About so many vectors, chosen by hash, fit the centroids and code books: the documented bound of the sample.
SAMPLE = 16384
MOST_CELLS = 4096
SUBSPACES = 16
CODES = 256
#: Candidates of a query that are reranked exactly, at least, and what is added to the depth that the sample asks for.
RERANK = 128
MARGIN = 2.0
#: Vectors of a list that are compared in one group, about.
BLOCK = 4096
#: Recall on the sample that sets the number of cells visited.
RECALL = 0.97
QUERIES_TOGETHER = 512


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most k centroids; starts from evenly spaced rows, so that reruns agree."""
    c = np.unique(x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)], axis=0).copy()
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :])


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([squares(x[k : k + 1024], c).argmin(1) for k in range(0, len(x), 1024)]) if len(x) else np.zeros(0, int)


@dataclass
class Index:
    centroids: np.ndarray
    books: list[np.ndarray]  # of each subspace, its code book
    cuts: list[slice]
    probes: int
    depth: int  # candidates to rerank
    first: int = 0  # the number of its first cell

    @staticmethod
    def fit(sample: np.ndarray, cells: int, count: int, k: int = 10, recall: float = RECALL) -> Index:
        """An index for `count` vectors like those of the sample."""
        centroids = k_means(sample, cells)
        rest = sample - centroids[nearest(sample, centroids)]
        bounds = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        cuts = [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        books = [k_means(rest[:, c], CODES) for c in cuts]
        # Cells that hold the true neighbours, in the sample, of some of its rows.
        of = nearest(sample, centroids)
        queries = np.linspace(0, len(sample) - 1, min(256, len(sample))).astype(int)
        codes = np.stack([nearest(rest[:, c], b) for c, b in zip(cuts, books, strict=True)], 1)
        meant = centroids[of]  # what the codes stand for
        for m, (cut, book) in enumerate(zip(cuts, books, strict=True)):
            meant[:, cut] += book[codes[:, m]]
        needed, deep = [], []
        for q in queries:
            d = ((sample - sample[q]) ** 2).sum(1)
            d[q] = np.inf
            true = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
            rank = np.empty(len(centroids), int)
            rank[np.argsort(squares(sample[q : q + 1], centroids)[0], kind="stable")] = np.arange(len(centroids))
            needed.append(rank[of[true]])
            rough = ((sample[q] - meant) ** 2).sum(1)  # as the tables of a search would give it
            rough[q] = np.inf
            deep.append(np.searchsorted(np.sort(rough), rough[true]))
        needed, deep = (np.concatenate(x) if x else np.zeros(0, int) for x in (needed, deep))
        probes = int(np.quantile(needed, recall, method="higher")) + 1 if len(needed) else 1
        depth = int(np.quantile(deep, recall, method="higher")) + 1 if len(deep) else 1
        grown = max(1.0, count / max(1, len(sample)))  # places among all vectors grow with their number
        return Index(centroids, books, cuts, probes, max(RERANK, math.ceil(MARGIN * depth * grown)))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector and the codes of its residual."""
        cell = nearest(x, self.centroids)
        rest = x - self.centroids[cell]
        return cell, np.stack([nearest(rest[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], 1).astype(np.uint8)

    def visited(self, q: np.ndarray) -> np.ndarray:
        return np.argsort(squares(q, self.centroids), axis=1, kind="stable")[:, : self.probes]

    def rough(self, cell: int, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances, by tables, of queries to the vectors that the codes of a cell stand for."""
        rest = q - self.centroids[cell]
        return sum(squares(rest[:, cut], book)[:, codes[:, m]] for m, (cut, book) in enumerate(zip(self.cuts, self.books, strict=True)))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows found of each query, its own id left out; score is the distance.

    vectors (id long, vector array); queries (id): rows of vectors that ask. Vectors that are null, zero or hold null
    or non-finite components take no part; a query meets vectors of its own length only. Equal vectors are indexed
    once, with their k + 1 smallest ids, which are all that k neighbours can need. Ties go to the smaller id. An empty
    table gives an empty result; further columns are ignored; a repeated id is a row of its own.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col("vector"))).select("id", F.col("vector").cast("array<double>").alias("vector"))
    rows = stored(rows.withColumn("key", F.md5(F.col("vector").cast("string"))))
    good = stored(rows.groupBy("key").agg(F.min("id").alias("low"), F.first("vector").alias("vector")).withColumn("rep", F.xxhash64("key")))
    counts, samples = sampled(good, SAMPLE, 16 * LEAST_OF_LENGTH)
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    indexes, first = {}, 0
    for d in sorted(counts):
        indexes[d] = Index.fit(samples[d], max(1, min(MOST_CELLS, round(math.sqrt(counts[d])), len(samples[d]) // 4)), counts[d], k, recall)
        indexes[d].first = first
        first += len(indexes[d].centroids)
    shared = spark.sparkContext.broadcast(indexes)  # bounded by MOST_CELLS and CODES for each length
    of_cell = spark.createDataFrame([(x.first + c, d) for d, x in indexes.items() for c in range(len(x.centroids))], "cell int, d int")

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, part, x in by_length(pdf):
                cell, codes = shared.value[d].encode(x)
                yield pd.DataFrame({"rep": part["rep"], "cell": (cell + shared.value[d].first).astype("int32"), "codes": [c.tobytes() for c in codes]})

    lists = stored(good.select("rep", "vector").mapInPandas(encoded, "rep long, cell int, codes binary"))

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, part, x in by_length(pdf):
                cells = shared.value[d].visited(x) + shared.value[d].first
                n = cells.shape[1]
                yield pd.DataFrame({"qrep": np.repeat(part["rep"].to_numpy(), n), "cell": cells.ravel().astype("int32"), "q": np.repeat(np.array([v.tobytes() for v in x], object), n)})

    asked = rows.join(queries.select(F.col("id").alias("_q")).distinct(), F.col("id") == F.col("_q"), "left_semi").select(F.col("id").alias("query_id"), F.xxhash64("key").alias("qrep"), "vector")
    asked = stored(asked)
    asking = asked.groupBy(F.col("qrep").alias("rep")).agg(F.first("vector").alias("vector"))
    visiting = stored(asking.mapInPandas(visits, "qrep long, cell int, q binary"))
    # Long lists and crowds of queries are cut into parts; each part of the one meets each part of the other.
    parts = lists.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    crowds = visiting.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES_TOGETHER).cast("int").alias("crowds"))
    table = stored(parts.join(crowds, "cell").join(of_cell, "cell"))  # one row a cell at most
    groups = table.agg(F.sum(F.col("parts") * F.col("crowds"))).first()[0] or 1
    table = F.broadcast(table)
    low = lists.join(table, "cell").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("crowd", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1)))
    high = visiting.join(table, "cell").withColumn("crowd", F.pmod(F.xxhash64("qrep"), F.col("crowds")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["cell", "part", "crowd", "d"]
    # Rows of a group travel as one pack for each task that made them.
    pack = lambda df, kind, a, b: df.groupBy(*keys).agg(F.collect_list(F.struct(F.col(a).alias("i"), F.col(b).alias("x"))).alias("rows")).select(*keys, F.lit(kind).alias("kind"), "rows")
    both = pack(low, 0, "rep", "codes").union(pack(high, 1, "qrep", "q")).withColumn("gid", F.xxhash64(*keys))

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, "gid"):
            out = []
            for a, b in runs(pdf["gid"].to_numpy()):
                part = pdf.iloc[a:b]
                mine = [r for rs, kind in zip(part["rows"], part["kind"], strict=True) if kind == 0 for r in rs]
                asks = [r for rs, kind in zip(part["rows"], part["kind"], strict=True) if kind == 1 for r in rs]
                if not mine or not asks:
                    continue
                index = shared.value[int(part["d"].iloc[0])]
                codes = np.frombuffer(b"".join(r["x"] for r in mine), np.uint8).reshape(len(mine), -1)
                q = np.frombuffer(b"".join(r["x"] for r in asks)).reshape(len(asks), -1)
                ids = np.array([r["i"] for r in mine], np.int64)
                rough = index.rough(int(part["cell"].iloc[0]) - index.first, q, codes).astype(np.float32)
                for r, d in zip(asks, rough, strict=True):
                    at = np.argpartition(d, index.depth - 1)[: index.depth] if len(d) > index.depth else np.arange(len(d))
                    out.append((r["i"], index.depth, ids[at].tobytes(), d[at].tobytes()))
            if out:
                yield pd.DataFrame(out, columns=["qrep", "depth", "reps", "d"])

    n = parts_for(spark, groups, 64)
    hits = both.repartition(n, "gid").sortWithinPartitions("gid", "kind").mapInPandas(found, "qrep long, depth int, reps binary, d binary")

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, "qrep"):
            for a, b in runs(pdf["qrep"].to_numpy()):
                depth = int(pdf["depth"].iloc[a])
                reps, d = np.frombuffer(b"".join(pdf["reps"].iloc[a:b]), np.int64), np.frombuffer(b"".join(pdf["d"].iloc[a:b]), np.float32)
                at = np.lexsort((reps, d))[:depth]
                yield pd.DataFrame({"qrep": pdf["qrep"].iloc[a], "rep": reps[at]})

    best = hits.repartition(n, "qrep").sortWithinPartitions("qrep").mapInPandas(merged, "qrep long, rep long")
    # The exact step: the original vectors of the candidates, fetched by one join, beside those of their queries.
    queried = asked.groupBy("qrep").agg(F.first("vector").alias("q"))
    near = best.join(good.select("rep", "key", "low", "vector"), "rep").join(queried, "qrep")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = np.array([np.sqrt(((np.asarray(x) - np.asarray(q)) ** 2).sum()) for x, q in zip(pdf["vector"], pdf["q"], strict=True)])
                yield pdf[["qrep", "key", "low"]].assign(score=d)

    scored = near.select("qrep", "key", "low", "vector", "q").mapInPandas(exact, "qrep long, key string, low long, score double")
    order = Window.partitionBy("qrep").orderBy("score", F.col("low").asc_nulls_last())  # a query's candidates: its depth
    top = stored(scored.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= k + 1).drop("_at", "low"))
    drop_stored(lists, visiting)
    # The k + 1 smallest ids of each vector wanted; copies combine before the shuffle.
    wanted = top.select("key").distinct()
    ids = rows.select("key", "id").where("id is not null").join(wanted, "key", "left_semi").groupBy("key", F.pmod(F.xxhash64("id"), F.lit(64)).alias("part")).agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"))
    ids = ids.groupBy("key").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    pairs = asked.select("query_id", "qrep").join(top, "qrep").join(ids, "key").select("query_id", F.explode("ids").alias("id"), "score").where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op3_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    out = search(vectors, vectors.where("id % 100 = 0").select("id"))
    return out.withColumnRenamed("id", "vec_id")
