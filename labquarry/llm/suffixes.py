"""Removal of repeated byte strings by a distributed sort of sampled suffixes.

A byte goes if it lies in a string of LENGTH bytes (a window) that also starts anywhere else. Sorting a suffix for every
byte would move two hundred times the corpus, so suffixes are sampled by content: of the CORE-byte strings in a window,
the one with the least hash is its anchor. Equal windows have equal anchors at equal offsets, so only suffixes
starting at anchors are sorted: range-partitioned by sampled splitters over their leading bytes, sorted in
each bucket by multikey quicksort, compared with their neighbours, and at the ends of a bucket with the buckets beside it.

A suffix is carried as its first eight bytes (its leading tokens) and a 64-bit digest of the string compared. Per
anchor, the string that all its windows share (the core) and the string that they cover together (the union) are
looked up: a core found once rules all windows out, a union found twice settles them all; what is left is cut into
pieces of PIECE windows, treated likewise, and at last into single windows. A hot string spreads over many buckets, as
ties are ordered by a hash of the place; each bucket adds one row for its ends, so no task sees all of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, partitions, read, stored

LENGTH = 200
CORE = 73
PIECE = 16
#: Bytes handled at a time; longer texts are handled in overlapping segments.
SEGMENT = 1 << 20
#: Rows in a bucket, about.
BUCKET = 400_000

_M = np.uint64
_BASE = _M(0x9E3779B97F4A7C15)
_INVERSE = _M(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240608).integers(0, 1 << 63, 256, dtype=np.uint64) * _M(2) + _M(1)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, SEGMENT + 4096)
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64))]) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _M(33))) * _M(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _M(29))) * _M(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _M(32))


class Digests:
    """Digests of any strings of a buffer."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, length: int | np.ndarray, salt: int | np.ndarray = 0) -> np.ndarray:
        h = (self.sums[start + length] - self.sums[start]) * self.down[start]
        return _mixed(h + _M(0x2545F4914F6CDD1D) * np.asarray(length * 1024 + salt, np.uint64))


def leading(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The first eight bytes as an integer that sorts as they do."""
    out = np.zeros(len(start), np.uint64)
    for k in range(8):
        out = (out << _M(8)) | data[start + k].astype(np.uint64)
    return (out ^ _M(1 << 63)).view(np.int64)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    full = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    full[: len(values)] = values
    rows = full.reshape(-1, width)
    before = np.minimum.accumulate(rows, 1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


@dataclass(frozen=True)
class Shape:
    length: int = LENGTH
    core: int = CORE
    segment: int = SEGMENT

    @property
    def windows(self) -> int:
        return self.length - self.core + 1


def anchors(data: np.ndarray, ends: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """Of a buffer of texts (ends: of each): places of the anchors, and the least and largest offset of their windows."""
    w = shape.windows
    digests = Digests(data)
    n = len(data) - shape.core + 1
    none = np.zeros(0, np.int64)
    if len(data) < shape.length:
        return none, none, none, digests
    at = np.arange(n, dtype=np.uint64)
    value = ((digests.of(np.arange(n), shape.core) >> _M(32)) << _M(32)) | at
    chosen = (sliding_least(value, w) & _M(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(len(chosen))
    valid = start + shape.length <= ends[np.searchsorted(ends, start, side="right")]
    start, chosen = start[valid], chosen[valid]
    if not len(start):
        return none, none, none, digests
    first = np.concatenate([[True], chosen[1:] != chosen[:-1]])
    last = np.concatenate([first[1:], [True]])
    p = chosen[first]
    return p, p - start[last], p - start[first], digests


def _segments(lengths: np.ndarray, segment: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, after the last, from byte, to byte): some whole texts, or a part of one long one."""
    k = 0
    while k < len(lengths):
        if lengths[k] > segment:
            for a in range(0, int(lengths[k]), segment):
                yield k, k + 1, a, min(a + segment, int(lengths[k]))
            k += 1
            continue
        m, total = k, 0
        while m < len(lengths) and total + lengths[m] <= segment:
            total += lengths[m]
            m += 1
        yield k, m, 0, total
        k = m


_RECORD = ["lead", "core", "whole", "rid", "at", "own"]
_RECORD_TYPES = "lead long, core long, whole long, rid long, at long, own int"


def _batch(arrays: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(arrays, names)


def anchor_records(texts: DataFrame, shape: Shape) -> DataFrame:
    """One record for each anchor of texts (rid, text): own packs the least and the largest offset of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = shape.windows - 1
        for batch in batches:
            encoded = [(x or "").encode() for x in batch.column("text").to_pylist()]
            rids = np.asarray(batch.column("rid"))
            lengths = np.array([len(x) for x in encoded], np.int64)
            for a, b, low, high in _segments(lengths, shape.segment):
                margin_low = max(0, low - reach)
                part = [encoded[a][margin_low : high + shape.length + reach]] if b - a == 1 else encoded[a:b]
                data = np.frombuffer(b"".join(part), np.uint8)
                ends = np.cumsum([len(x) for x in part])
                p, o_low, o_high, digests = anchors(data, ends, shape)
                if b - a == 1:
                    keep = (p + margin_low >= low) & (p + margin_low < high)
                    p, o_low, o_high = p[keep], o_low[keep], o_high[keep]
                if not len(p):
                    continue
                text = np.searchsorted(ends, p, side="right")
                begins = ends[text] - np.array([len(x) for x in part])[text]
                fits = (p - reach >= begins) & (p + shape.length <= ends[text])
                whole = np.zeros(len(p), np.int64)
                whole[fits] = digests.of(p[fits] - reach, shape.length + reach).view(np.int64)
                columns = [
                    pa.array(leading(data, p)), pa.array(digests.of(p, shape.core).view(np.int64)), pa.array(whole, mask=~fits),
                    pa.array(rids[a + text]), pa.array(p - begins + margin_low), pa.array((o_low * 1024 + o_high).astype(np.int32)),
                ]
                yield _batch(columns, _RECORD)

    return texts.mapInArrow(run, _RECORD_TYPES)


def multikey_order(words: list[np.ndarray]) -> np.ndarray:
    """Order of strings given word by word: quicksort by the first word, then each run of equal words by the next."""
    order = np.argsort(words[0], kind="quicksort")
    for depth in range(1, len(words)):
        ties = np.ones(len(order), bool)
        for w in words[:depth]:
            s = w[order]
            ties[1:] &= s[1:] == s[:-1]
        ties[:1] = False
        start = ~ties
        open_ = ties | np.concatenate([ties[1:], [False]])  # in a run of two or more
        if not open_.any():
            break
        at = np.flatnonzero(open_)
        run = np.cumsum(start)[at]
        inner = order[at]
        by = np.argsort(words[depth][inner], kind="quicksort")
        by = by[np.argsort(run[by], kind="stable")]
        order[at] = inner[by]
    return order


def looked_up(records: DataFrame, digest: str, rows: int, hits_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """records, with hit (the string is found twice or more) and first (one or more rows of each such string); and the
    stored table that the result reads, to be dropped after it.

    rows: how many records there are, about. Sorted by lead and digest as the module says. If only hits are wanted,
    others are left out as soon as they are known, but for the ends of buckets, which may be hits yet.
    """
    spark = records.sparkSession
    n = max(partitions(spark), -(-rows // BUCKET))
    names = records.columns
    dealt = records.withColumn("_salt", F.xxhash64("rid", "at", digest)).repartitionByRange(n, "lead", digest, "_salt").drop("_salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        lead, d = (np.asarray(t.column(c)) for c in ("lead", digest))
        order = multikey_order([lead, d])
        lead, d = lead[order], d[order]
        like = (lead[1:] == lead[:-1]) & (d[1:] == d[:-1])
        before, after = np.concatenate([[False], like]), np.concatenate([like, [False]])
        state = (before | after).astype(np.int8)
        ends = np.zeros(len(lead), bool)
        ends[[0, -1]] = True  # they may be like the ends of the buckets beside this one
        keep = np.flatnonzero((state == 1) | ends) if hits_only else np.arange(len(order))
        t = t.take(pa.array(order[keep]))
        flags = [pa.array(x[keep]) for x in (state == 1, ~before & after, ends)]
        for b in t.to_batches(max_chunksize=10_000):
            at = [x.slice(0, b.num_rows) for x in flags]
            flags = [x.slice(b.num_rows) for x in flags]
            yield _batch([*b.columns, *at], [*names, "hit", "first", "end"])

    kinds = ", ".join(f"{c} {t}" for c, t in records.dtypes)
    out = stored(dealt.mapInArrow(run, f"{kinds}, hit boolean, first boolean, end boolean"))
    ends = out.where("end").groupBy("lead", digest).agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("lead").alias("_lead"), F.col(digest).alias("_digest"), F.lit(True).alias("_met"))
    # Two rows a bucket: the ends that another bucket's end is like. Only ends are joined with them.
    inner, at_end = out.where("not end"), out.where("end")
    met = at_end.join(ends, (F.col("lead") == F.col("_lead")) & (F.col(digest) == F.col("_digest")), "left")
    met = met.select(*names, F.coalesce("_met", "hit").alias("hit"), F.coalesce("_met", "first").alias("first"))
    return inner.select(*names, "hit", "first").union(met), out


def refined(records: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """(settled, open): records whose union is found twice; and those that need a closer look, with one
    record of each settled union that shares its core with one of them, as something to compare with."""
    found, table = looked_up(records, "core", rows)
    cores = stored(found.where("hit").select(*records.columns))
    drop_stored(table)
    found, table = looked_up(cores.where("whole is not null"), "whole", cores.count(), False)
    open_ = found.where("not hit").select(*records.columns).union(cores.where("whole is null").select(*records.columns))
    wanted = open_.select(F.col("lead").alias("_lead"), F.col("core").alias("_core")).distinct()
    like = found.where("hit and first").select(*records.columns).join(wanted, (F.col("lead") == F.col("_lead")) & (F.col("core") == F.col("_core")), "left_semi")
    open_ = stored(open_.union(like))
    settled = stored(found.where("hit").select("rid", "at", "own"))
    drop_stored(table)
    drop_stored(cores)
    return settled, open_


def _pieces(texts: DataFrame, places: DataFrame, shape: Shape, size: int) -> DataFrame:
    """Records of the pieces of `size` windows of the places (rid, at, own, low, high): offsets low to high of the windows of an anchor.

    at holds the anchor times 1024 plus the piece's first offset, which the digests are salted with: pieces of two
    anchors that happen to cover the same bytes are not each other's repeats.
    """
    spread = places.groupBy("rid").agg(F.collect_list(F.struct("at", "own", "low", "high")).alias("places"))  # bounded by the text's length
    joined = texts.join(spread, "rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, text, found in zip(batch.column("rid").to_pylist(), batch.column("text"), batch.column("places"), strict=True):
                whole_text = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                flat = found.values
                at, own, low, high = (np.asarray(flat.field(k)).astype(np.int64) for k in range(4))
                order = np.argsort(at, kind="stable")
                at, own, low, high = at[order], own[order], low[order], high[order]
                for a in range(0, len(whole_text), shape.segment):
                    i, j = np.searchsorted(at, [a, a + shape.segment])
                    if i == j:
                        continue
                    base = max(0, a - shape.windows)
                    data = whole_text[base : a + shape.segment + shape.length + shape.windows]
                    digests = Digests(data)
                    p = at[i:j] - base
                    o_low, o_high = np.maximum(own[i:j] // 1024, low[i:j]), np.minimum(own[i:j] % 1024, high[i:j])
                    count = o_high // size - o_low // size + 1
                    count = np.maximum(0, count)
                    who = np.repeat(np.arange(len(p)), count)
                    nth = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
                    o = (o_low[who] // size + nth) * size
                    q = p[who]
                    start = q - o - (size - 1)  # of the union; the core starts at q - o
                    fits = (start >= 0) & (q - o + shape.length <= len(data))
                    if base:
                        fits &= start + base >= 0
                    core_at = q - o
                    good = core_at >= 0
                    core = np.zeros(len(q), np.int64)
                    core[good] = digests.of(core_at[good], shape.length - size + 1, (o[good] + 1)).view(np.int64)
                    whole = np.zeros(len(q), np.int64)
                    whole[fits] = digests.of(start[fits], shape.length + size - 1, (o[fits] + 1)).view(np.int64)
                    columns = [
                        pa.array(leading(data, q)), pa.array(core), pa.array(whole, mask=~fits),
                        pa.array(np.full(len(q), rid, np.int64)), pa.array((q + base) * 1024 + o), pa.array(own[i:j][who].astype(np.int32)),
                    ]
                    keep = pa.array(good)
                    yield _batch([c.filter(keep) for c in columns], _RECORD)

    return joined.select("rid", "text", "places").mapInArrow(run, _RECORD_TYPES)


def repeated_windows(texts: DataFrame, shape: Shape) -> DataFrame:
    """(rid, low, high): starts of windows that are found elsewhere. texts (rid, text) is read several times."""
    start = stored(anchor_records(texts, shape))
    settled, left = refined(start, start.count())
    last = shape.windows - 1
    out = [settled.select("rid", (F.col("at") - last).alias("low"), F.col("at").alias("high"))]
    # Anchors with windows undecided, in pieces; those that only serve for comparison have no windows to settle.
    places = left.select("rid", "at", "own", F.lit(0).alias("low"), F.lit(last).alias("high")).distinct()
    drop_stored(start)
    pieces = stored(_pieces(texts, places, shape, PIECE))
    drop_stored(left)
    settled, left = refined(pieces, pieces.count())
    anchor, offset = F.expr("at div 1024"), F.col("at") % 1024
    out.append(settled.select("rid", (anchor - offset - (PIECE - 1)).alias("low"), (anchor - offset).alias("high")))
    places = left.select("rid", anchor.alias("at"), "own", offset.cast("int").alias("low"), (offset + PIECE - 1).cast("int").alias("high")).distinct()
    drop_stored(pieces)
    windows = stored(_pieces(texts, places, shape, 1))
    drop_stored(left)
    hits = looked_up(windows, "core", windows.count())[0].where("hit")
    out.append(hits.select("rid", (anchor - offset).alias("low"), (anchor - offset).alias("high")))
    found = out[0]
    for x in out[1:]:
        found = found.union(x)
    return stored(found.distinct())


def removed(docs: DataFrame, length: int = LENGTH, core: int = CORE, segment: int = SEGMENT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of docs (doc_id, text), one row for each row.

    kept: the remaining bytes. Null texts count as empty; texts shorter than `length` bytes lose nothing. Repeated
    rows repeat each other's strings and go whole, as equal texts do; extra columns are ignored.
    """
    shape = Shape(length, core, segment)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).withColumn("rid", F.xxhash64("doc_id", F.md5("text")))
    long_ones = keyed.where(F.octet_length("text") >= length).select("rid", "text")
    windows = repeated_windows(long_ones, shape)
    spans = windows.groupBy("rid").agg(F.collect_list(F.struct("low", "high")).alias("spans"))  # bounded by the text's length
    spans = spans.withColumnRenamed("rid", "_rid")
    joined = keyed.join(spans, F.col("rid") == F.col("_rid"), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans"), strict=True):
                data = text.encode()
                kept, n, last = [], 0, 0
                if found.is_valid:
                    low, high = (np.asarray(found.values.field(k)) for k in range(2))
                    order = np.argsort(low, kind="stable")
                    low, end = low[order], np.maximum.accumulate(high[order] + length)
                    first = np.concatenate([[True], low[1:] > end[:-1]])
                    begins, ends = low[first], end[np.concatenate([first[1:], [True]])]
                    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
                        kept.append(data[last:a])
                        last, n = b, n + 1
                kept.append(data[last:])
                rest = b"".join(kept)
                for column, value in zip(out, (len(data), len(data) - len(rest), n, hashlib.sha256(rest).hexdigest(), rest), strict=True):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield _batch([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = dict(keyed.dtypes)["doc_id"]
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op7_sampled_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(read(spark, sf_dir, "documents")).drop("kept")
