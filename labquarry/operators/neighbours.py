"""Similarity of bit fingerprints, nearest neighbours, density clusters and leader clusters."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import stored
from .tabular import OperatorError, q


def bits(vector: Column, threshold: float = 0.0) -> Column:
    """An array of numbers as a fingerprint: longs that hold 63 bits each, a bit for every number above the threshold."""
    n = F.size(vector)
    words = F.sequence(F.lit(0), F.floor((n - 1) / 63).cast("int"))
    one = lambda w: F.aggregate(F.slice(vector, w * 63 + 1, F.lit(63)), F.lit(0).cast("long"), lambda a, x: a * 2 + (x > threshold).cast("long"))
    return F.transform(words, one)


def _popcount(v: Column) -> Column:
    return F.aggregate(v, F.lit(0), lambda a, x: a + F.bit_count(x))


SIMILARITIES = ("tanimoto", "dice", "cosine", "sokal", "russel", "kulczynski", "mcconnaughey", "asymmetric", "braunblanquet", "allbit")


def similarity(a: Column, b: Column, n_bits: Column, metric: str) -> Column:
    """Similarity of two fingerprints of n_bits bits."""
    x, y = _popcount(a).cast("double"), _popcount(b).cast("double")
    z = _popcount(F.zip_with(a, b, lambda p, r: p.bitwiseAND(r))).cast("double")
    n = n_bits.cast("double")
    forms = {
        "tanimoto": F.try_divide(z, x + y - z), "dice": F.try_divide(2 * z, x + y), "cosine": F.try_divide(z, F.sqrt(x * y)), "sokal": F.try_divide(z, 2 * x + 2 * y - 3 * z),
        "russel": F.try_divide(z, n), "kulczynski": F.try_divide(z * (x + y), 2 * x * y), "mcconnaughey": F.try_divide(z * (x + y) - x * y, x * y),
        "asymmetric": F.try_divide(z, F.least(x, y)), "braunblanquet": F.try_divide(z, F.greatest(x, y)), "allbit": F.try_divide(n - (x + y - 2 * z), n),
    }
    if metric not in forms:
        raise OperatorError(f"no metric {metric!r}")
    return F.coalesce(forms[metric], F.lit(0.0))


def similarity_search(df: DataFrame, query: DataFrame, fingerprint: str, n_bits: int, metric: str = "tanimoto", least: float = 0.0) -> DataFrame:
    """df with similarity to the one query row (its column `fingerprint`), rounded to 4 places, from `least` on."""
    one = query.limit(1).select(q(fingerprint).alias("_query"))
    out = df.crossJoin(F.broadcast(one)).withColumn("similarity", F.bround(similarity(q(fingerprint), F.col("_query"), F.lit(n_bits), metric), 4))
    return out.where(F.col("similarity") >= least).drop("_query")


#: A pair that meets in a prefix costs about as much as so many pairs compared by blocks.
MEETING = 64


def similarity_pairs(df: DataFrame, key: str, fingerprint: str, n_bits: int, least: float, metric: str = "tanimoto") -> DataFrame:
    """(a, b, similarity) of pairs a < b with a tanimoto similarity of at least `least` > 0.

    Equal fingerprints are compared once, as a class, and pairs of classes are put out as those of their rows. Where
    prefixes tell fingerprints apart, classes meet by them (see _meeting); where they do not, as with few bits of which
    half are set, all classes are compared block by block, which is quadratic in their number.
    """
    if metric != "tanimoto" or least <= 0:
        raise OperatorError("pairs are found for tanimoto above 0")
    kind = dict(df.dtypes)[key]
    rows = df.select(q(key).alias("k"), q(fingerprint).alias("fp")).where(_popcount(F.col("fp")) > 0)
    nodes = stored(rows.groupBy("fp").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("w")))
    n = nodes.count()
    prefix = stored(_prefixes(nodes, n_bits, least))
    meets = prefix.groupBy("bit").count().agg(F.sum(F.col("count").cast("double") ** 2)).first()[0] or 0.0  # as many rows as bits
    found = _meeting(prefix, least) if meets * MEETING < float(n) ** 2 else _links(nodes, least, kind)
    if nodes.where("w > 1").isEmpty():
        ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
        return found.select(*ordered, "similarity")
    of = stored(rows.join(nodes.select("fp", F.col("k").alias("of")), "fp").select("k", "of"))
    named = lambda s: of.select(F.col("k").alias("k" + s), F.col("of").alias(s))
    apart = found.join(named("a"), "a").join(named("b"), "b")
    apart = apart.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "similarity")
    if least > 1:
        return apart
    alike = of.join(of.select(F.col("k").alias("b"), "of"), "of").where(F.col("k") < F.col("b"))
    return apart.union(alike.select(F.col("k").alias("a"), "b", F.lit(1.0)))


def _prefixes(nodes: DataFrame, n_bits: int, least: float) -> DataFrame:
    """(k, fp, x, first, bit): the first bits of each fingerprint of x bits, rare ones first, a row for each.

    Two fingerprints of x and y bits that are alike share at least o = least / (1 + least) * (x + y) bits, so they share
    one of the first x - o + 1 bits of each in a fixed order, o being the smallest number with o / x >= least.
    """
    on = F.filter(F.sequence(F.lit(0), F.lit(n_bits - 1)), lambda i: F.getbit(F.element_at("fp", (F.floor(i / 63) + 1).cast("int")), (F.least(F.lit(63), F.lit(n_bits) - F.floor(i / 63).cast("int") * 63) - 1 - i % 63).cast("int")) == 1)
    p = stored(nodes.select("k", "fp", on.alias("on")))
    counts = p.select(F.explode("on").alias("bit")).groupBy("bit").agg(F.count(F.lit(1)).alias("c"))
    # Rare bits first, so that prefixes meet seldom; there are as many rows as bits.
    order = counts.agg(F.map_from_entries(F.collect_list(F.struct("bit", "c"))).alias("order"))
    sorted_on = F.array_sort(F.transform("on", lambda i: F.struct(F.element_at("order", i).alias("c"), i.alias("i"))))
    x = F.size("on")
    up = F.ceil(x * least).cast("int")
    up = F.when((up - 1) / x >= least, up - 1).otherwise(up)  # the product may round up past a whole number
    first = F.transform(F.slice(sorted_on, F.lit(1), x - up + 1), lambda s: s["i"])
    p = stored(p.crossJoin(F.broadcast(order)).where(up <= x).select("k", "fp", x.alias("x"), first.alias("first")))
    return p.withColumn("bit", F.explode("first"))


def _meeting(prefix: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of a < b: pairs are compared at the first bit that their prefixes share alone, if their sizes allow the similarity at all."""
    named = lambda s: prefix.select("bit", *(F.col(c).alias(c + s) for c in ("k", "fp", "x", "first")))
    both = named("a").join(named("b"), "bit").where((F.col("ka") < F.col("kb")) & (F.least("xa", "xb") / F.greatest("xa", "xb") >= least))
    both = both.where(F.element_at(F.array_intersect("firsta", "firstb"), 1) == F.col("bit"))
    z = _popcount(F.zip_with("fpa", "fpb", lambda u, v: u.bitwiseAND(v)))
    out = both.select(F.col("ka").alias("a"), F.col("kb").alias("b"), (z / (F.col("xa") + F.col("xb") - z)).alias("similarity"))
    return out.where(F.col("similarity") >= least)


def distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    """Distance of two arrays of equal length, in double precision."""
    pair = lambda f: F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    if metric == "euclidean":
        return F.sqrt(pair(lambda x, y: (x - y) * (x - y)))
    if metric == "cityblock":
        return pair(lambda x, y: F.abs(x - y))
    if metric == "chebyshev":
        return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    if metric == "cosine":
        return 1 - F.try_divide(pair(lambda x, y: x * y), F.sqrt(pair(lambda x, y: x * x) * pair(lambda x, y: y * y)))
    raise OperatorError(f"no metric {metric!r}")


#: Rows of a block of the training set, and of the rows that look for neighbours: what one task compares at a time.
TRAIN_BLOCK, ROW_BLOCK = 4096, 4096


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """distance() of every row of a with every row of b, summed in the same order; NaN where there is none."""
    out = np.zeros((len(a), len(b)))
    dot, ones, twos = np.zeros_like(out), np.zeros((len(a), 1)), np.zeros((1, len(b)))
    for x, y in zip(a.T[:, :, None], b.T[:, None, :], strict=True):
        if metric == "cosine":
            dot, ones, twos = dot + x * y, ones + x * x, twos + y * y
        elif metric == "chebyshev":
            out = np.maximum(out, np.abs(x - y))
        else:
            out += np.abs(x - y) if metric == "cityblock" else (x - y) * (x - y)
    if metric == "cosine":
        norm = np.sqrt(ones * twos)
        return 1 - np.divide(dot, norm, out=np.full_like(dot, np.nan), where=norm != 0)
    return np.sqrt(out) if metric == "euclidean" else out


def _nearest(rows: pd.DataFrame, train: pd.DataFrame, k: int, metric: str, leave_own: bool) -> pd.DataFrame:
    """(key, neighbour, distance): the k nearest of a block of the training set for each of a block of rows."""
    rows, train = rows.reset_index(drop=True), train.sort_values("neighbour", kind="stable").reset_index(drop=True)
    as_array = lambda v: np.zeros(0) if v is None else np.asarray(v, float)
    a, b = [as_array(v) for v in rows["_v"]], [as_array(v) for v in train["_t"]]
    width, lengths = (np.array([len(v) for v in x], int) for x in (a, b))
    keys, others, got = rows["key"].to_numpy(), train["neighbour"].to_numpy(), []
    for start in range(0, len(a), 256):
        d = np.full((min(256, len(a) - start), len(b)), np.nan)
        for n in set(width[start : start + 256].tolist()) & set(lengths.tolist()) - {0}:
            i, j = np.flatnonzero(width[start : start + 256] == n), np.flatnonzero(lengths == n)
            d[np.ix_(i, j)] = _distances(np.stack([a[start + x] for x in i]), np.stack([b[x] for x in j]), metric)
        known = np.where(np.isnan(d), np.inf, d)
        for r in range(len(d)):
            may = np.flatnonzero(others != keys[start + r]) if leave_own else np.arange(len(b))
            if len(may) > k:
                may = may[known[r, may] <= np.partition(known[r, may], k - 1)[k - 1]]
            may = may[np.argsort(known[r, may], kind="stable")[:k]]
            got.append((np.full(len(may), start + r), may, d[r, may]))
    at, to, far = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return pd.DataFrame({"key": rows["key"].iloc[at].reset_index(drop=True), "neighbour": train["neighbour"].iloc[to].reset_index(drop=True), "distance": far})


def knn(train: DataFrame, rows: DataFrame, key: str, train_key: str, vector: str, k: int = 5, metric: str = "euclidean", leave_own: bool = False) -> DataFrame:
    """(key, neighbour, rank, distance): the k nearest training rows of each row, ties to the smaller key.

    Both sides are dealt into blocks by their keys, and each pair of blocks is compared by a task of its own, which
    keeps k candidates a row; so either side may be of any size. leave_own leaves out training rows of the row's own
    key. Training rows without a distance (a missing vector, another length) come last, their distance is null.
    """
    if metric not in ("euclidean", "cityblock", "chebyshev", "cosine"):
        raise OperatorError(f"no metric {metric!r}")
    t = train.select(q(train_key).alias("neighbour"), q(vector).alias("_t"))
    d = rows.select(q(key).alias("key"), q(vector).alias("_v"))
    parts, blocks = max(1, -(-t.count() // TRAIN_BLOCK)), max(1, -(-d.count() // ROW_BLOCK))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    t = t.withColumn("_part", dealt("neighbour", parts)).withColumn("_block", every(blocks)).groupBy("_part", "_block")
    d = d.withColumn("_block", dealt("key", blocks)).withColumn("_part", every(parts)).groupBy("_part", "_block")
    types = {"key": rows.select(q(key)).dtypes[0][1], "neighbour": train.select(q(train_key)).dtypes[0][1]}
    near = d.cogroup(t).applyInPandas(lambda a, b: _nearest(a, b, k, metric, leave_own), f"key {types['key']}, neighbour {types['neighbour']}, distance double")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.col("distance").asc_nulls_last(), "neighbour"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("key", "neighbour", "distance", "rank")


def knn_classify(train: DataFrame, rows: DataFrame, key: str, train_key: str, vector: str, label: str, k: int = 5, weights: str = "uniform") -> DataFrame:
    """(key, prediction): the label with the most votes among the k nearest; by weight 1 / distance if asked for."""
    near = knn(train, rows, key, train_key, vector, k).join(train.select(q(train_key).alias("neighbour"), q(label).alias("label")), "neighbour")
    vote = F.lit(1.0) if weights == "uniform" else 1 / F.greatest(F.col("distance"), F.lit(1e-12))
    votes = near.groupBy("key", "label").agg(F.sum(vote).alias("votes"))
    return votes.groupBy("key").agg(F.min_by("label", F.struct(-F.col("votes"), "label")).alias("prediction"))


def knn_regress(train: DataFrame, rows: DataFrame, key: str, train_key: str, vector: str, target: str, k: int = 5, weights: str = "uniform") -> DataFrame:
    near = knn(train, rows, key, train_key, vector, k).join(train.select(q(train_key).alias("neighbour"), q(target).cast("double").alias("y")), "neighbour")
    w = F.lit(1.0) if weights == "uniform" else 1 / F.greatest(F.col("distance"), F.lit(1e-12))
    return near.groupBy("key").agg((F.sum(w * F.col("y")) / F.sum(w)).alias("prediction"))


#: Boxes that a cell is parted into, about.
BOXES = 64


def _placed(df: DataFrame, key: str, columns: list[str], eps: float) -> DataFrame:
    """(k, c0, ..., box, cell, block) of the rows whose columns are all finite numbers.

    Rows of one cell are within eps of each other; those within eps of each other lie in the same block or in blocks that
    touch. Boxes part cells. Only the first three columns make blocks.
    """
    n = len(columns)
    parts, fine = 1 + int(n**0.5), max(2, int(BOXES ** (1 / n) + 1e-9))  # more parts than the root of n: a cell's diagonal is under eps
    p = df.select(q(key).alias("k"), *(q(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)))
    p = p.where(reduce(lambda a, b: a & b, [F.abs(f"c{i}") < float("inf") for i in range(n)]))
    # A little wider than eps, so that rounding parts no two rows that are eps apart by more than a block.
    p = p.withColumn("box", F.array(*(F.floor(F.col(f"c{i}") / (eps * (1 + 1e-9)) * (parts * fine)) for i in range(n))))
    p = p.withColumn("cell", F.transform("box", lambda x: F.floor(x / fine)))
    return p.withColumn("block", F.transform(F.slice("cell", 1, min(3, n)), lambda x: F.floor(x / parts)))


def _touching(block: Column, m: int) -> Column:
    """An array of the block and all blocks that touch it."""
    steps = [[]]
    for _ in range(m):
        steps = [[*x, s] for x in steps for s in (-1, 0, 1)]
    return F.array(*(F.array(*(block[i] + F.lit(s) for i, s in enumerate(x))) for x in steps))


def _square(pairs: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, [d * d for d in pairs])


def dbscan(df: DataFrame, key: str, columns: list[str], eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """df with cluster: numbered from 0 by their smallest core key; -1 for noise.

    Cores have min_samples rows, themselves included, within eps; clusters are the connected cores; other rows join the
    smallest cluster of a core within eps. No list of all near pairs is made: rows of a cell of min_samples rows are
    cores and connected, so that neighbours are counted for rows of emptier cells alone, and cells are tied by the boxes
    around their cores, whose corners mostly tell whether some core of one cell is within eps of one of the other; only
    where they do not, cores are compared.
    """
    m, n = min(3, len(columns)), len(columns)
    p = stored(_placed(df, key, columns, eps))
    cells = p.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    full = stored(cells.where(F.col("n") >= min_samples).select("cell"))
    few = p.join(full, "cell", "left_anti")
    sent = few.select(F.col("k").alias("a"), *(F.col(f"c{i}").alias(f"d{i}") for i in range(n)), F.explode(_touching(F.col("block"), m)).alias("block"))
    near = sent.join(p.select("k", "block", *(f"c{i}" for i in range(n))), "block")
    near = stored(near.where(_square([F.col(f"c{i}") - F.col(f"d{i}") for i in range(n)]) <= eps * eps).select("a", F.col("k").alias("b")))
    more = near.groupBy(F.col("a").alias("k")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_samples).select("k")
    cores = stored(p.join(full, "cell", "left_semi").unionByName(p.join(more, "k", "left_semi").select(*p.columns)))

    boxes = cores.groupBy("block", "cell", "box").agg(F.min("k").alias("first"), *(f(f"c{i}").alias(f"{s}{i}") for i in range(n) for s, f in (("l", F.min), ("h", F.max))))
    names = stored(boxes.groupBy("cell").agg(F.min("first").alias("unit")))
    boxes = stored(boxes.join(names, "cell").drop("first", "cell"))
    links = _cell_links(boxes, cores, eps, n, m)
    label = _connected(names.select(F.col("unit").alias("core")), links)
    own = cores.select("k", "cell").join(names, "cell").join(label, F.col("unit") == F.col("core")).select(F.col("k").alias("core"), "label")
    if min_samples <= 1:  # rows without a place are near to none but themselves
        own = own.union(df.select(q(key).alias("k"), q(key).alias("label")).join(p.select("k"), "k", "left_anti"))
    own = stored(own)
    reach = near.join(own, F.col("b") == F.col("core")).groupBy("a").agg(F.min("label").alias("m")).select(F.col("a").alias("_a"), "m")
    numbers = own.select("label").distinct().select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("cluster"))
    out = df.drop("cluster").join(own.withColumnRenamed("label", "own"), q(key) == F.col("core"), "left").join(reach, q(key) == F.col("_a"), "left")
    out = out.withColumn("_of", F.coalesce("own", "m")).join(numbers, F.col("_of") == F.col("label"), "left")
    return out.select(*(q(c) for c in df.columns if c != "cluster"), F.coalesce("cluster", F.lit(UNCLUSTERED)).alias("cluster"))


def _cell_links(boxes: DataFrame, cores: DataFrame, eps: float, n: int, m: int) -> DataFrame:
    """(a, b), both ways: units (cells of cores) that have cores within eps of each other."""
    other = boxes.select(F.col("unit").alias("b"), F.col("box").alias("box_b"), F.explode(_touching(F.col("block"), m)).alias("block"), *(F.col(f"{s}{i}").alias(f"{s}{i}_b") for i in range(n) for s in "lh"))
    col = lambda s, i: F.col(f"{s}{i}")
    gap = _square([F.greatest(F.lit(0.0), F.col(f"l{i}_b") - col("h", i), col("l", i) - F.col(f"h{i}_b")) for i in range(n)])
    span = _square([F.greatest(F.col(f"h{i}_b") - col("l", i), col("h", i) - F.col(f"l{i}_b")) for i in range(n)])
    pairs = boxes.withColumnRenamed("unit", "a").join(other, "block").where((F.col("a") < F.col("b")) & (gap <= eps * eps))
    pairs = stored(pairs.select("a", "b", "box", "box_b", (span <= eps * eps).alias("sure")))
    sure = pairs.where("sure").select("a", "b").distinct()
    open_ = stored(pairs.where("not sure").join(sure, ["a", "b"], "left_anti").select("a", "b", "box", "box_b"))
    left = open_.join(cores.select("box", *(F.col(f"c{i}") for i in range(n))), "box")
    both = left.join(cores.select(F.col("box").alias("box_b"), *(F.col(f"c{i}").alias(f"d{i}") for i in range(n))), "box_b")
    links = stored(sure.union(both.where(_square([F.col(f"c{i}") - F.col(f"d{i}") for i in range(n)]) <= eps * eps).select("a", "b").distinct()))
    return links.union(links.select("b", "a"))


def _connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(core, label): the smallest node connected, found by passing labels along links (a, b), both ways, until nothing changes."""
    label = nodes.select("core", F.col("core").alias("label"))
    while True:
        passed = links.join(label, F.col("b") == F.col("core")).groupBy("a").agg(F.min("label").alias("m"))
        both = label.join(passed, F.col("core") == F.col("a"), "left").select("core", "label", F.least("label", F.coalesce("m", "label")).alias("low"))
        # A label's own label may be lower still, and what a core learns goes to the core that its label names.
        told = both.groupBy(F.col("label").alias("core")).agg(F.min("low").alias("told"))
        both = both.join(told, "core", "left").select("core", F.col("label").alias("old"), F.least("low", F.coalesce("told", "low")).alias("label"))
        both = stored(both)
        jump = both.select(F.col("core").alias("_at"), F.col("label").alias("_jump"))
        after = stored(both.join(jump, F.col("label") == F.col("_at")).select("core", "old", F.col("_jump").alias("label")))
        label = after.select("core", "label")
        if after.where("label <> old").isEmpty():
            return label


UNCLUSTERED = -1


#: Fingerprints of a block, of which pairs are compared at a time.
ALIKE_BLOCK = 4096


def _alike(left: pd.DataFrame, right: pd.DataFrame, least: float, same: bool) -> pd.DataFrame:
    """(a, b, similarity) of the pairs of two blocks, or within one (once each), that are at least `least` alike."""
    words = [[np.asarray(v, np.int64) for v in x["fp"]] for x in (left, right)]
    most = max((len(v) for x in words for v in x), default=0)
    lengths = [np.array([len(v) for v in x], int) for x in words]
    bit = [np.unpackbits(np.array([np.pad(v, (0, most - len(v))) for v in x], np.int64).reshape(len(x), most).view(np.uint8), axis=1).astype(np.float32) for x in words]
    n, keys, got = [x.sum(1, dtype=float) for x in bit], [x["k"].to_numpy() for x in (left, right)], []
    # z / (x + y - z) >= least where z - share * x - share * y >= 0: one product; rounding is made good below.
    share, ones = least / (1 + least), [np.ones((len(x), 1), np.float32) for x in bit]
    a = np.hstack([bit[0], -share * n[0][:, None].astype(np.float32), ones[0]])
    b = np.hstack([bit[1], ones[1], -share * n[1][:, None].astype(np.float32)]).T.copy()
    for start in range(0, len(left), 512):
        got.append(np.argwhere(a[start : start + 512] @ b >= -0.05) + [start, 0])
    i, j = np.concatenate(got).T if got else np.zeros((2, 0), int)
    may = (lengths[0][i] == lengths[1][j]) & ((i < j) if same else True)
    i, j = i[may], j[may]
    z = np.concatenate([np.einsum("ij,ij->i", bit[0][i[k : k + 65536]], bit[1][j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.zeros(0)]).astype(float)
    alike = z / (n[0][i] + n[1][j] - z)
    hit = alike >= least
    return pd.DataFrame({"a": keys[0][i[hit]], "b": keys[1][j[hit]], "similarity": alike[hit]})


def _links(nodes: DataFrame, least: float, kind: str) -> DataFrame:
    """(a, b, similarity) of all pairs of different (k, fp), once each, that are at least `least` alike, compared block by block."""
    n = max(1, -(-nodes.count() // ALIKE_BLOCK))
    own = F.pmod(F.xxhash64("k"), F.lit(n)).cast("int")
    x = nodes.select("k", "fp", own.alias("_own"))
    a = x.select("k", "fp", F.col("_own").alias("_i"), F.explode(F.sequence("_own", F.lit(n - 1))).alias("_j"))
    b = x.select(F.col("k").alias("k2"), F.col("fp").alias("fp2"), F.explode(F.sequence(F.lit(0), F.col("_own"))).alias("_i"), F.col("_own").alias("_j"))
    # The work is in the pairs and not in the bytes: as many partitions as pairs of blocks, within reason.
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(n * (n + 1) // 2, 2000))
    a, b = (y.repartition(parts, "_i", "_j") for y in (a, b))

    def compare(at, x, y):
        x, y = (z.set_axis(["k", "fp", "_i", "_j"], axis=1) if z.shape[1] else pd.DataFrame({"k": [], "fp": []}) for z in (x, y))
        return _alike(x.sort_values("k", ignore_index=True), y.sort_values("k", ignore_index=True), least, at[0] == at[1])

    return a.groupBy("_i", "_j").cogroup(b.groupBy("_i", "_j")).applyInPandas(compare, f"a {kind}, b {kind}, similarity double")


#: Rows, and links of theirs, among which one task takes heads in turn.
TURN_ROWS, TURN_LINKS = 20_000, 2_000_000


def _in_turn(best: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """(member, head): heads taken one by one among the best rows, with all their links; it ends where a row that is not
    at hand (links null, the best of the others) would be next."""
    best = best.sort_values("place", ignore_index=True)  # of equal ones the first is taken
    if links.empty:
        links = pd.DataFrame({"a": best["k"].iloc[:0], "b": best["k"].iloc[:0], "w": best["w"].iloc[:0]})
    left, keys, there = best["n"].to_numpy(np.int64).copy(), best["k"], best["links"].notna().to_numpy()
    nodes, code = np.unique(np.concatenate([keys.to_numpy(), links["b"].to_numpy()]), return_inverse=True)
    own, to = code[: len(keys)], code[len(keys) :]
    weight = np.zeros(len(nodes), np.int64)
    weight[to] = links["w"].to_numpy(np.int64)
    weight[own] = best["w"].to_numpy(np.int64)
    at = np.full(len(nodes), -1)
    at[own[there]] = np.flatnonzero(there)  # the row that ends it bounds all others, even when it is taken itself
    row = at[np.searchsorted(nodes, links["a"].to_numpy())]
    order = np.argsort(row, kind="stable")
    near, cuts = to[order], np.searchsorted(row[order], np.arange(len(keys) + 1))
    order = np.argsort(to, kind="stable")
    back, ends = row[order], np.searchsorted(to[order], np.arange(len(nodes) + 1))
    gone, members, heads = np.zeros(len(nodes), bool), [], []
    while len(left) and left[head := int(np.argmax(left))] > 0 and there[head]:
        taken = np.concatenate([near[cuts[head] : cuts[head + 1]], own[head : head + 1]])
        taken = taken[~gone[taken]]
        gone[taken] = True
        members.append(taken)
        heads.append(np.full(len(taken), own[head]))
        for x in taken.tolist():  # rows that lose a neighbour
            left[back[ends[x] : ends[x + 1]]] -= weight[x]
        left[at[taken[at[taken] >= 0]]] = 0
    if not members:
        return pd.DataFrame({"member": keys.iloc[:0], "head": keys.iloc[:0]})
    return pd.DataFrame({"member": nodes[np.concatenate(members)], "head": nodes[np.concatenate(heads)]})


def leader_clusters(df: DataFrame, key: str, fingerprint: str, n_bits: int, threshold: float = 0.35) -> DataFrame:
    """df with cluster: greedy clusters of rows at least 1 - threshold alike, largest neighbourhoods first.

    Equal fingerprints are one row with a weight: they have the same neighbours and always share a cluster. Different
    ones are compared block by block, which is quadratic in their number. The greedy
    pass runs in rounds over stored pairs, of two kinds, which both give the clusters of taking the head of all rows one
    by one (by neighbours left; ties to the smaller number or the larger text). In one, all rows are heads that no row
    within two links outranks: heads of one round have no neighbour in common. Where that takes few, a task takes heads
    in turn among the TURN_ROWS best rows or those of TURN_LINKS links, as far as no other row outranks them. Rows
    without neighbours are clusters of their own.
    """
    kind = dict(df.dtypes)[key]
    by_number = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
    first = F.min if by_number else F.max
    rows = df.select(q(key).alias("k"), q(fingerprint).alias("fp"))
    # Rows without a bit are alike to none, their copies included.
    some = rows.where(_popcount(F.col("fp")) > 0)
    nodes = stored(some.groupBy("fp").agg(first("k").alias("k"), F.count(F.lit(1)).alias("w")))
    pairs = stored(_links(nodes.select("k", "fp"), 1 - threshold, kind).select("a", "b"))
    links = pairs.union(pairs.select("b", "a"))
    tied = stored(links.select(F.col("a").alias("k")).distinct())
    done = stored(nodes.join(tied, "k", "left_anti").select(F.col("k").alias("member"), F.col("k").alias("head")))
    left = stored(nodes.select("k", "w").join(tied, "k", "left_semi"))
    rank = F.struct("n", *([(-F.col("k")).alias("tie")] if by_number else [F.col("k").alias("tie")]), "k")
    n_left = n_stored = left.count()
    wait = pause = 0
    while n_left:
        count = links.join(left.withColumnRenamed("k", "b"), "b").groupBy("a").agg(F.sum("w").alias("more"), F.count(F.lit(1)).alias("links"))
        at = left.join(count, F.col("k") == F.col("a"), "left").select("k", "w", (F.col("w") + F.coalesce("more", F.lit(0))).alias("n"), F.coalesce("links", F.lit(0)).alias("links"))
        at = stored(at)
        taken = stored(_turn(at, left, links, rank, kind) if wait else _peaks(at, links, rank))
        done = done.union(taken)
        left = stored(left.join(taken, F.col("k") == F.col("member"), "left_anti"))
        before, n_left = n_left, left.count()
        if wait:
            wait -= 1
        elif before - n_left < before / 4:
            wait = pause = min(32, 2 * pause or 4)  # rounds in turn before the others are tried again
        if n_left < n_stored / 2:
            inner = links.join(left.select(F.col("k").alias("a")), "a", "left_semi").join(left.select(F.col("k").alias("b")), "b", "left_semi")
            links, n_stored = stored(inner.select("a", "b")), n_left
    heads = nodes.join(done, F.col("k") == F.col("member")).select(F.col("fp").alias("_fp"), F.col("head").alias("_head"))
    return df.drop("cluster").join(heads, q(fingerprint) == F.col("_fp"), "left").withColumn("cluster", F.coalesce("_head", q(key))).drop("_fp", "_head")


def _peaks(at: DataFrame, links: DataFrame, rank: Column) -> DataFrame:
    """(member, head) of the rows that none within two links outranks, and those they take."""
    # The best among a row's neighbours and itself, then the best among theirs.
    best = at.select("k", rank.alias("best"))
    for _ in range(2):
        told = links.join(best.withColumnRenamed("k", "b"), "b").groupBy("a").agg(F.max("best").alias("told"))
        best = best.join(told, F.col("k") == F.col("a"), "left").select("k", F.greatest("best", F.coalesce("told", "best")).alias("best"))
    heads = stored(best.where(F.col("best.k") == F.col("k")).select(F.col("k").alias("head")))
    there = links.join(at.select(F.col("k").alias("b")), "b", "left_semi")
    taken = there.join(heads, F.col("a") == F.col("head")).select(F.col("b").alias("member"), F.col("a").alias("head"))
    return taken.union(heads.select(F.col("head").alias("member"), "head"))


def _turn(at: DataFrame, left: DataFrame, links: DataFrame, rank: Column, kind: str) -> DataFrame:
    """(member, head) of heads taken in turn among the best rows, whose number and links are bounded."""
    best = at.orderBy(rank.desc()).limit(TURN_ROWS + 1)
    best = stored(best.withColumn("place", F.row_number().over(Window.orderBy(rank.desc()))))  # TURN_ROWS + 1 rows at most
    tie = F.row_number().over(Window.orderBy(rank["tie"].desc()))
    upto = F.sum("links").over(Window.orderBy("place"))
    best = best.withColumn("_in", (F.col("place") == 1) | ((upto <= TURN_LINKS) & (F.col("place") <= TURN_ROWS)))
    others = best.where("not _in").orderBy("place").limit(1)
    best = best.where("_in").unionByName(others).withColumn("place", tie)
    best = stored(best.select("k", "w", "n", F.when(F.col("_in"), F.col("links")).alias("links"), "place"))
    own = best.where("links is not null").select(F.col("k").alias("a"))
    some = links.join(F.broadcast(own), "a", "left_semi").join(left.withColumnRenamed("k", "b"), "b").select("a", "b", "w")
    one = lambda x: x.withColumn("_one", F.lit(1)).groupBy("_one")
    return one(best).cogroup(one(some)).applyInPandas(_in_turn, f"member {kind}, head {kind}")
