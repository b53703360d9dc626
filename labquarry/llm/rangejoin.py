"""Exact range join of unit vectors: all pairs with a cosine of at least a threshold.

Vectors belong to the cell of their nearest pivot, large cells are cut into chunks, and chunks are gathered into blocks
of bounded size. Angles are a metric on the sphere: x can lie within the angle r of a member of a chunk only if
angle(x, pivot) is within r of the range of angles between that pivot and the chunk's members, so x is sent to just those
blocks that hold such a chunk, and compared with just such chunks there. Each pair meets once: in a block, or in that
one of two blocks which the other sends to, where each block sends to half of the others. What is sent to a block is
dealt to its slices, each of which holds the block and reads the vectors sent to it in turn: a vector goes to about
slices + blocks / 2 tasks, whatever the number of chunks. A task gives the number of links of each vector and a spanning
forest, not pairs. Vectors of different lengths never meet: each length has pivots, cells, chunks and blocks of its own, all in one pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, drop_stored, join_by_key, local_forest, partitions, read, runs, stored

THRESHOLD = 0.9
#: Vectors in a chunk, about, or as many more as keep the chunks to MOST_CHUNKS and a cell each.
CHUNK = 1024
MOST_CHUNKS = 65536
#: Pivots are drawn from about this many vectors chosen by hash, and at least about so many of each length.
SAMPLE = 8192
LEAST_OF_LENGTH = 64
MOST_PIVOTS = 2048
#: Bytes of a block's vectors, at most, and pairs that are worth a task of their own.
BLOCK_BYTES = 64 << 20
PAIRS = 1 << 23
#: Vectors compared at a time with as many of a block at most, and bytes of what is gathered in double precision meanwhile.
SLICE = 1024
DOUBLES = 4 << 20
#: Vectors and bytes of a pack, and bytes of packs put out at a time.
PACKED = 256
PACK_BYTES = 1 << 18
OUT_BYTES = 16 << 20


def usable(vector: F.Column) -> F.Column:
    """Neither null nor empty nor zero, without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def bytes_of(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 0))


def by_length(pdf: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    """(length, rows, their vectors) of each length in the column `vector`."""
    sizes = pdf["vector"].map(len).to_numpy()
    for d in np.unique(sizes):
        part = pdf[sizes == d]
        yield int(d), part, bytes_of(part["vector"])


def sampled(good: DataFrame, bound: int, least: int) -> tuple[dict[int, int], dict[int, np.ndarray]]:
    """(vectors of each length, some of them): of good (rep, vector), about `bound` in all by hash, but about `least` of each length."""
    counts = {r["d"]: r["count"] for r in good.groupBy(F.size("vector").alias("d")).count().collect()}  # a row a length
    total = sum(counts.values())
    out = {}
    for d, n in counts.items():
        share = min(1.0, max(bound / total, least / n))
        some = good.where((F.size("vector") == d) & (F.pmod("rep", F.lit(1_000_003)) <= int(share * 1_000_003))).orderBy("rep").limit(2 * bound)
        found = bytes_of(some.select("vector").toPandas()["vector"])
        out[d] = found if len(found) else np.eye(1, d)  # any direction will do
    return counts, out


def pivots_of(sample: np.ndarray, n: int) -> np.ndarray:
    """n rows of the sample, each farthest from those before it (fewer, if the sample has fewer distinct rows)."""
    picked, far = [0], 1 - sample @ sample[0]
    while len(picked) < n:
        k = int(np.argmax(far))
        if far[k] <= 1e-12:
            break
        picked.append(k)
        far = np.minimum(far, 1 - sample @ sample[k])
    return sample[picked]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit(x) @ pivots.T, -1, 1))


def grid(count: int, width: int, tasks: int) -> tuple[int, int]:
    """(blocks, slices of a block) for `count` vectors of `width` bytes: about `tasks` tasks, fewer if there is little to compare, more if blocks would not fit."""
    wanted = max(1, min(tasks, count * count // (2 * PAIRS)))
    blocks = max(1, round(math.sqrt(2 * wanted)), math.ceil(count * width / BLOCK_BYTES))
    return blocks, math.ceil(wanted / blocks)


def sends(block: np.ndarray, blocks: int) -> np.ndarray:
    """Of each block given, the blocks that its vectors are sent to: the next half of them in a ring."""
    to = np.arange(blocks)
    ahead = (to - block[:, None]) % blocks
    return (ahead > 0) & ((2 * ahead < blocks) | ((2 * ahead == blocks) & (block[:, None] < to)))


def near_pairs(x: np.ndarray, y: np.ndarray, raw_x: np.ndarray, raw_y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(p, q): the rows of x and y with a cosine of at least the threshold in double precision.

    x and y are unit vectors in single precision, whose products leave open only pairs within a bound of their rounding
    errors; these are computed from the given vectors, few at a time.
    """
    margin = (x.shape[1] + 4) * 2.0**-23
    products = x @ y.T
    at = np.flatnonzero(products >= threshold - margin)
    p, q = np.divmod(at, len(y))
    open_ = np.flatnonzero(products.ravel()[at] < threshold + margin)
    if len(open_):
        keep, step = np.ones(len(at), bool), max(1, DOUBLES // (8 * x.shape[1]))
        for k in range(0, len(open_), step):
            some = open_[k : k + step]
            keep[some] = (unit(raw_x[p[some]].astype(np.float64)) * unit(raw_y[q[some]].astype(np.float64))).sum(1) >= threshold
        p, q = p[keep], q[keep]
    return p, q


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Sets the labels, least places of classes, to those after places a and b have been linked.

    In each round every label that a link joins with another takes one such partner, so that classes halve at least and
    a crowd's links are read, not sorted.
    """
    while True:
        f, g = label[a], label[b]
        apart = np.flatnonzero(f != g)
        if not len(apart):
            return
        a, b, f, g = (v[apart] for v in (a, b, f, g))
        partner = np.full(len(label), -1)
        partner[f] = g
        partner[g] = f
        at = np.flatnonzero(partner >= 0)
        f, g = local_forest(at, partner[at])
        to = np.arange(len(label))
        to[f] = g
        label[:] = to[label]


def block_links(ids, same, chunk, raw, others, chunks: dict[int, tuple[int, float, float]], pivots: np.ndarray, threshold: float, turn: int = 0, slices: int = 1) -> Iterator[pd.DataFrame]:
    """(id, links, other) of the rows of a block and of others that link with them; `other` is an id linked with id, or itself.

    Rows of the block lie chunk by chunk; chunks: (row of pivots, least and largest angle with it) of each. others:
    (ids, same, raw), which are compared with the block but not among themselves. Every slices-th pair of pieces of the
    block is compared here, from the turn-th on. Nothing grows with the others or with the number of links.
    """
    size, d = raw.shape
    step = max(1, min(SLICE, 4 * DOUBLES // (8 * d)))
    single = lambda x: np.concatenate([unit(x[k : k + step].astype(np.float64)).astype(np.float32) for k in range(0, len(x), step)])
    reach = math.acos(threshold) + 1e-7
    x, pieces = single(raw), [(int(chunk[i]), k, min(k + step, j)) for i, j in runs(chunk) for k in range(i, j, step)]
    links, label = np.zeros(size + step, np.int64), np.arange(size + step)  # of the block's rows, then of others' at hand

    def meet(raw2: np.ndarray, x2: np.ndarray, same2: np.ndarray, base: int, with_: list[tuple[int, int, int]]) -> None:
        angle = np.ascontiguousarray(angles(raw2.astype(np.float64), pivots).T)
        for c, i, j in with_:
            pivot, low, high = chunks[c]
            rows = np.flatnonzero((angle[pivot] >= low - reach) & (angle[pivot] <= high + reach))
            if not len(rows):
                continue
            some = slice(None) if len(rows) == len(x2) else rows
            p, q = near_pairs(x[i:j], x2[some], raw[i:j], raw2[some], threshold)
            if i == base:  # a piece with itself
                once = i + p < base + rows[q]
                p, q = p[once], q[once]
            if not len(p):
                continue
            links[i:j] += np.bincount(p, same2[some][q], j - i).astype(np.int64)
            links[base + rows] += np.bincount(q, same[i:j][p], len(rows)).astype(np.int64)
            join_labels(label, i + p, base + rows[q])

    met = 0
    for k, (_, i, j) in enumerate(pieces):
        mine = [m for n, m in enumerate(pieces[k:]) if (met + n) % slices == turn]
        met += len(pieces) - k
        if mine:
            meet(raw[i:j], x[i:j], same[i:j], i, mine)
    out, rows = [], 0
    for ids2, same2, raw2 in others:
        for k in range(0, len(ids2), step):
            i2, s2, r2 = ids2[k : k + step], same2[k : k + step], raw2[k : k + step]
            meet(r2, single(r2), s2, size, pieces)
            hit = np.flatnonzero(links[size:])
            out.append((i2[hit], links[size + hit], ids[label[size + hit]]))  # the least place of its class is the block's
            rows += len(hit)
            links[size:], label[size:] = 0, np.arange(size, size + step)
            if rows >= 50_000:
                yield pd.DataFrame({n: np.concatenate(v) for n, v in zip(("id", "links", "other"), zip(*out, strict=True), strict=True)})
                out, rows = [], 0
    hit = np.flatnonzero(links)
    out.append((ids[hit], links[hit], ids[label[hit]]))
    yield pd.DataFrame({n: np.concatenate(v) for n, v in zip(("id", "links", "other"), zip(*out, strict=True), strict=True)})


def linked(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id) of vectors (id long, vector array): one row for each row.

    Vectors that are null, zero or hold null or non-finite components link with nothing; vectors of different lengths
    do not link with each other. Repeated ids are rows of their own in the counts. Equal vectors are compared once, and
    are sent as single-precision numbers where the table holds such. An empty table gives an empty result; further
    columns are ignored.
    """
    spark = vectors.sparkSession
    kind = "<f4" if dict(vectors.dtypes)["vector"] == "array<float>" else "<f8"
    vectors = vectors.select("id", "vector").withColumn("ok", usable(F.col("vector")))
    rows = stored(vectors.withColumn("key", F.when(F.col("ok"), F.unhex(F.md5(F.col("vector").cast("array<double>").cast("string"))))))
    total = rows.count()
    good = rows.where("ok").groupBy("key").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector"))
    good = stored(good.withColumn("rep", F.xxhash64("key")))
    counts, samples = sampled(good, SAMPLE, LEAST_OF_LENGTH)
    if not counts:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    count, pivots, first = sum(counts.values()), {}, 0
    for d in sorted(counts):
        found = pivots_of(unit(samples[d]), max(1, min(MOST_PIVOTS, round(counts[d] / CHUNK))))
        pivots[d] = (first, found)  # cells of a length are numbered from `first`
        first += len(found)
    shared = spark.sparkContext.broadcast(pivots)  # at most MOST_PIVOTS vectors a length

    def own_cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, rows, vectors in by_length(pdf):
                start, found = shared.value[d]
                for k in range(0, len(rows), SLICE):
                    part, angle = rows[k : k + SLICE], angles(vectors[k : k + SLICE], found)
                    cell = angle.argmin(1)
                    yield part.assign(cell=(start + cell).astype("int32"), angle=angle[np.arange(len(part)), cell])

    vector_type = "array<float>" if kind == "<f4" else "array<double>"
    numbers = good.select("rep", "n", F.col("vector").cast(vector_type).alias("vector"))
    celled = stored(numbers.mapInPandas(own_cell, f"rep long, n long, vector {vector_type}, cell int, angle double"))
    item, per_chunk = int(kind[-1]), max(CHUNK, math.ceil(count / MOST_CHUNKS))
    cells = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.max(F.size("vector")).alias("d"))
    fit = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (F.col("d") * item)))
    cells = cells.select("cell", F.ceil(F.col("m") / F.least(F.lit(per_chunk), fit)).cast("int").alias("parts"))
    parted = celled.join(F.broadcast(cells), "cell")  # at most one row a pivot
    parted = parted.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    spans = parted.groupBy("cell", "part").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("m"))
    spans = spans.orderBy("cell", "part").toPandas()  # one row a chunk: MOST_CHUNKS + a cell each at most, more only if vectors are very long
    cell_of, low, high = (spans[c].to_numpy() for c in ("cell", "low", "high"))
    key_of = spans["cell"].to_numpy(np.int64) << 32 | spans["part"].to_numpy(np.int64)
    grids, tasks = {}, 0
    for d, (start, found) in pivots.items():
        a, b = np.searchsorted(cell_of, [start, start + len(found)])  # this length's chunks
        m = spans["m"].to_numpy()[a:b]
        blocks, slices = grid(counts[d], d * item, 2 * partitions(spark))
        block = np.minimum(blocks - 1, (np.cumsum(m) - m / 2) * blocks // m.sum()).astype(np.int64)
        grids[d] = (tasks, blocks, slices, a, b, a + np.searchsorted(block, np.arange(blocks + 1)))  # the last: where each block's chunks begin
        tasks += blocks * slices
    table = spark.sparkContext.broadcast((grids, key_of, cell_of, low, high))
    reach = math.acos(threshold) + 1e-7

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Packs of vectors for their own block and for those of their length that they are sent to and have in reach."""
        grids, key_of, cell_of, low, high = table.value
        out, held = [], 0
        frame = lambda: pd.DataFrame(out, columns=["task", "kind", "d", "ids", "same", "chunks", "x"])
        for pdf in batches:
            for d, part, x in by_length(pdf):
                start, found = shared.value[d]
                first, blocks, slices, a, b, cuts = grids[d]
                own = a + np.searchsorted(key_of[a:b], part["cell"].to_numpy(np.int64) << 32 | part["part"].to_numpy(np.int64))
                block = np.searchsorted(cuts, own, "right") - 1
                go = sends(block, blocks)
                for k in range(0, len(x), SLICE) if blocks > 1 else ():
                    angle = angles(x[k : k + SLICE], found)
                    for c, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        at = angle[:, cell_of[i:j] - start]
                        go[k : k + SLICE, c] &= ((at >= low[i:j] - reach) & (at <= high[i:j] + reach)).any(1)
                ids, same, chunks, raw = part["rep"].to_numpy(), part["n"].to_numpy(), own.astype(np.int32), x.astype(kind)
                packed, turn = max(1, min(PACKED, PACK_BYTES // (d * item))), ids % slices
                for c in range(blocks):
                    for t in range(slices):
                        for role, at in ((0, np.flatnonzero(block == c)), (1, np.flatnonzero(go[:, c] & (turn == t)))):
                            for k in range(0, len(at), packed):
                                some = at[k : k + packed]
                                out.append((first + c * slices + t, role, d, *(v[some].tobytes() for v in (ids, same, chunks, raw))))
                                held += len(some) * (d * item + 20)
                                if held >= OUT_BYTES:
                                    yield frame()
                                    out, held = [], 0
        yield frame()

    packs = parted.select("rep", "n", "vector", "cell", "part").mapInPandas(sent, "task int, kind int, d int, ids binary, same binary, chunks binary, x binary")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grids, _, cell_of, low, high = table.value

        def flat():
            for pdf in batches:
                for task, role, d, i, s, c, x in pdf.itertuples(index=False):
                    i = np.frombuffer(i, np.int64)
                    yield task, role, i, np.frombuffer(s, np.int64), np.frombuffer(c, np.int32), np.frombuffer(x, kind).reshape(len(i), d)

        stream = flat()
        head = next(stream, None)
        while head:
            task, own = head[0], []
            while head and head[0] == task and head[1] == 0:
                own.append(head[2:])
                head = next(stream, None)
            ids, same, chunk, raw = (np.concatenate(p) for p in zip(*own, strict=True))
            own = np.argsort(ids)  # the same order in each slice
            own = own[np.argsort(chunk[own], kind="stable")]
            ids, same, chunk, raw = (v[own] for v in (ids, same, chunk, raw))
            first, _, slices, *_ = grids[raw.shape[1]]
            cells, at = np.unique(cell_of[np.unique(chunk)], return_inverse=True)
            chunks = {c: (k, low[c], high[c]) for c, k in zip(np.unique(chunk).tolist(), at.tolist(), strict=True)}
            start, found = shared.value[raw.shape[1]]

            def others():
                """What comes for this task, a few packs together."""
                nonlocal head
                while head and head[0] == task:  # noqa: B023
                    some, n = [], 0
                    while head and head[0] == task and (not n or n + len(head[2]) <= SLICE):  # noqa: B023
                        some.append((head[2], head[3], head[5]))
                        n += len(head[2])
                        head = next(stream, None)
                    yield tuple(np.concatenate(p) for p in zip(*some, strict=True))

            yield from block_links(ids, same, chunk, raw, others(), chunks, found[cells - start], threshold, (task - first) % slices, slices)

    dealt = packs.repartitionById(min(tasks, max(1024, 4 * partitions(spark))), "task").sortWithinPartitions("task", "kind")
    links = stored(dealt.mapInPandas(compare, "id long, links long, other long"))
    drop_stored(celled)
    classes = components(links.select(F.col("id").alias("a"), F.col("other").alias("b")))
    summed = links.groupBy("id").agg(F.sum("links").alias("links"))
    by_rep = good.select("key", F.col("rep").alias("id"), "low", "n").join(summed, "id", "left").join(classes, "id", "left")
    by_rep = stored(by_rep.select("key", "low", "n", F.coalesce("component", "id").alias("group"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    lowest = stored(by_rep.groupBy("group").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("m")))
    by_key = stored(join_by_key(by_rep.drop("low"), lowest, ["group"], "m", count).drop("m"))
    drop_stored(good, links, by_rep, lowest)
    result = ["id", "n_links", "component_id"]
    out = join_by_key(rows.where("ok").select("id", "key"), by_key, ["key"], "n", total)
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.select("id", F.col("n_links").cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")).select(*result).union(alone)


def op5_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    out = linked(vectors).withColumnRenamed("id", "vec_id")
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), r AS (
  SELECT vec_id AS id, vec_id AS c FROM embeddings
  UNION
  SELECT l.b, r.c FROM r JOIN l ON l.a = r.id
), c AS (SELECT id, min(c) AS component_id FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON id = vec_id LEFT JOIN n ON a = vec_id
"""
