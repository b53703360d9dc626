"""Ranked lexical search over a tiered inverted index.

The index is cut into segments of documents. In a segment, each term's postings are sorted by impact and dealt to
tiers, the high impacts first; beside a term's piece of a tier stands its residual bound, the highest impact in the tiers
below. A search reads the first tier alone. It knows what each document has scored so far and, from the bounds, the
most it can reach. An item is settled in a segment if no unsettled document there can reach the tenth best score found
anywhere; where that proof fails, the item falls through to the segment's next tier, and in the last one all is exact.

An impact is the score of a term in a document but for the term's weight, so the index holds for any set of items.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_stored, read, sieve, stored

#: A segment is closed at so many documents, or when it has so many postings.
SEGMENT_DOCUMENTS, SEGMENT_POSTINGS = 4096, 1 << 20
#: Of a term's postings in a segment, the first FIRST and a sixteenth of all are in tier 0, a quarter of all in tier 1 or
#: before, the others in tier 2: short lists are in tier 0 whole.
FIRST, SHARES, TIERS = 32, (16, 4), 3
#: Items that a segment is asked at once. More are asked block by block.
ITEMS = 512
#: Bytes of a text that are split at a time.
SLICE = 1 << 22

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(text: bytes | None) -> Counter:
    """Terms of a UTF-8 text, runs of ASCII letters, digits and other characters beyond ASCII, A-Z lower-cased; null has none."""
    found: Counter = Counter()
    if text:
        text, at = text.translate(_LETTERS), 0
        while at < len(text):
            end = text.find(b" ", at + SLICE) if len(text) - at > SLICE else -1
            end = len(text) if end < 0 else end
            found.update(text[at:end].split(b" ") if end - at < len(text) else text.split(b" "))
            at = end
        found.pop(b"", None)
    return found


@dataclass
class TieredIndex:
    """postings (segment, term, df, bound, docs, impacts, tier); documents that have a term, and their terms with repeats."""

    postings: DataFrame
    n: int
    length: int

    def drop(self) -> None:
        """Deletes the stored index."""
        drop_stored(self.postings)


class _Segment:
    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.lengths, self.docs, self.tf = array("q"), array("I"), array("q")
        self.terms: list[bytes] = []

    def add(self, doc_id: int | None, counts: Counter) -> None:
        self.docs.extend(array("I", [len(self.ids)]) * len(counts))
        self.ids.append(doc_id)
        self.lengths.append(sum(counts.values()))
        self.terms.extend(counts)
        self.tf.extend(counts.values())

    def rows(self, segment: int, n: int, length: int, whole: int) -> pa.RecordBatch:
        """One row for each term and tier, and one without a term that has the documents' ids."""
        coded = pa.array(self.terms, pa.binary()).dictionary_encode()
        code, docs, tf = coded.indices.to_numpy(), np.frombuffer(self.docs, np.uint32), np.frombuffer(self.tf, np.int64)
        m = 25 + (75 * np.frombuffer(self.lengths, np.int64) * n) // length
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[docs])
        order = np.lexsort((docs, -impact, code))
        code, docs, impact = code[order], docs[order], impact[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        df = np.diff(np.r_[first, len(code)])
        place, of = np.arange(len(code)) - np.repeat(first, df), np.repeat(df, df)
        tier = sum((place >= whole + of // share).astype(np.int8) for share in SHARES)
        start = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (tier[1:] != tier[:-1])])
        ends = np.r_[start[1:], len(code)]
        after = np.minimum(ends, len(code) - 1)
        bound = np.where((ends < len(code)) & (code[after] == code[start]), impact[after], 0)

        def pieces(values: np.ndarray) -> pa.Array:
            offsets = (np.r_[start, len(values)] * values.itemsize).astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])

        ids = np.array([x or 0 for x in self.ids], np.int64)
        known = np.array([x is not None for x in self.ids], np.uint8)
        columns = [
            pa.array(np.full(len(start) + 1, segment), pa.int64()),
            pa.concat_arrays([pa.array([""], pa.string()), coded.dictionary.take(pa.array(code[start])).cast(pa.string())]),
            pa.array(np.r_[len(ids), of[start]], pa.int64()),
            pa.array(np.r_[0, bound], pa.int64()),
            pa.concat_arrays([pa.array([ids.tobytes()], pa.binary()), pieces(docs.astype(np.uint16))]),
            pa.concat_arrays([pa.array([known.tobytes()], pa.binary()), pieces(impact.astype(np.uint32))]),
            pa.array(np.r_[0, tier[start]], pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["segment", "term", "df", "bound", "docs", "impacts", "tier"])


def _slices(rows: pa.RecordBatch, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, rows.num_rows, size):
        yield rows.slice(at, size)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", segment_documents: int = SEGMENT_DOCUMENTS, first: int = FIRST) -> TieredIndex:
    """The stored index of all documents and all their terms, in segments of at most segment_documents (under 65,536).

    Texts are read whole, very long ones in slices. Null and empty texts, and texts without a term, are in no segment
    and count nowhere; rows of one id, or of one text, are documents of their own; null ids are kept. Other columns are
    not read, whatever their names. An empty table gives an index that finds nothing.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [sum(term_counts(t.as_py()).values()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([sum(s > 0 for s in sizes)]), pa.array([sum(sizes)])], ["n", "length"])

    sums = rows.select("text").mapInArrow(measure, "n long, length long").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).first()
    n, length = sums["n"] or 0, sums["length"] or 0

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, now = TaskContext.get().partitionId() << 32, _Segment()
        for batch in batches:
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                if not (counts := term_counts(t.as_py())):
                    continue
                now.add(i, counts)
                if len(now.ids) >= segment_documents or len(now.terms) >= SEGMENT_POSTINGS:
                    rows, now = now.rows(number, n, length, first), _Segment()
                    yield from _slices(rows)
                    number += 1
        if now.ids:
            yield from _slices(now.rows(number, n, length, first))

    postings = rows.mapInArrow(invert, "segment long, term string, df long, bound long, docs binary, impacts binary, tier int")
    return TieredIndex(stored(postings, by=["tier"]), n, length)


_FOUND = "segment long, item long, doc_id long, score long, exact boolean, reach long"


def _best(score: np.ndarray, among: np.ndarray, ids: np.ndarray, unknown: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0 among those, ties to smaller ids, unknown ids last."""
    at = np.flatnonzero(among & (score > 0))
    if len(at) > k:
        at = at[score[at] >= np.partition(score[at], -k)[-k]]
    return at[np.lexsort((ids[at], unknown[at], -score[at]))[:k]]


def _score(rows: pd.DataFrame, asked: set[int] | None, k: int) -> pd.DataFrame:
    """What the tiers given of one segment say of the items asked (None: all): the best documents so far, those whose score is exact
    and others, and a row without a score whose reach is the most that a document whose score is not exact can have."""
    out: list[tuple] = []
    head, rows = rows[rows["term"] == ""], rows[rows["term"] != ""]
    if not len(rows):
        return pd.DataFrame(out, columns=[x.split()[0] for x in _FOUND.split(", ")])
    segment = int(head["segment"].iloc[0])
    ids, unknown = np.frombuffer(head["docs"].iloc[0], np.int64), np.frombuffer(head["impacts"].iloc[0], np.uint8) == 0
    items = sorted({i for own in rows["items"].map(lambda x: [e["item"] for e in x]) for i in own if asked is None or i in asked})
    at = {i: p for p, i in enumerate(items)}
    rest = rows.groupby("term")["bound"].transform("min")  # what the tiers below those given can add
    score, gone, most = np.zeros((len(items), len(ids)), np.int64), np.zeros((len(items), len(ids)), np.int64), np.zeros(len(items), np.int64)
    for tier, w, bound, docs, impacts, own in zip(rows["tier"], rows["w"], rest, rows["docs"], rows["impacts"], rows["items"], strict=True):
        own = [(at[e["item"]], e["times"]) for e in own if e["item"] in at]
        if not own:
            continue
        where, weight = np.array([p for p, _ in own]), np.array([t * w for _, t in own], np.int64)
        cells = np.ix_(where, np.frombuffer(docs, np.uint16))
        score[cells] += weight[:, None] * np.frombuffer(impacts, np.uint32).astype(np.int64)
        if bound:
            gone[cells] += (weight * bound)[:, None]
            if tier == 0:
                most[where] += weight * bound
    everything = np.ones(len(ids), bool)
    for i, p in at.items():
        reach = score[p] + most[p] - gone[p]
        exact = reach == score[p]
        chosen = {*_best(score[p], everything, ids, unknown, k).tolist(), *_best(score[p], exact, ids, unknown, k).tolist()}
        out += [(segment, i, None if unknown[d] else int(ids[d]), int(score[p][d]), bool(exact[d]), None) for d in sorted(chosen)]
        out.append((segment, i, None, None, None, int(reach[~exact].max(initial=0))))
    return pd.DataFrame(out, columns=[x.split()[0] for x in _FOUND.split(", ")]).astype({"doc_id": "Int64", "score": "Int64", "reach": "Int64", "exact": "boolean"})


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "segment")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: TieredIndex, items: DataFrame, k: int = 10, rounds: list[int] | None = None) -> DataFrame:
    """(item, rank, doc_id, score): the k documents of the highest score above 0 for each row of items (item long, text).

    A score sums weight times impact over the item's terms, repeats included; ties go to the smaller doc_id, null ids
    last. Items with a null text or without a known term have no rows; an empty index or table of items gives none.
    rounds, if given, gets how many (segment, item) were asked in each tier.
    """
    spark = items.sparkSession

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, t.decode(), n) for i, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True) for t, n in term_counts(text).items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.int64())], ["item", "term", "times"])

    asked = stored(items.select(F.col("item").cast("long"), F.col("text").cast("binary")).mapInArrow(split, "item long, term string, times long"))
    blocks = max(1, -(-asked.select("item").distinct().count() // ITEMS))
    terms = stored(asked.select("term").distinct())
    could, rows = sieve(index.postings, F.xxhash64("term"), terms, F.xxhash64("term"))
    known = rows.where(could).join(terms, "term").where("tier = 0").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * index.n + 2)) / (2 * F.col("df") + 1).cast("double")))
    weighed = known.select("term", weight.alias("w"))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    own = asked.withColumn("block", block).groupBy("term", "block").agg(F.collect_list(F.struct("item", "times")).alias("items"))  # ITEMS or so at most
    words = stored(own.join(weighed, "term"))
    heads = words.select(F.lit("").alias("term"), "block", F.expr("cast(array() as array<struct<item: bigint, times: bigint>>)").alias("items"), F.lit(0).cast("long").alias("w")).distinct()
    words = words.select("term", "block", "items", "w").unionByName(heads)
    wanted = stored(words)

    def pieces(tier: int) -> DataFrame:
        could, rows = sieve(index.postings.where(F.col("tier") <= tier), F.xxhash64("term"), wanted, F.xxhash64("term"))
        return rows.where(could).join(wanted, "term").select("segment", "block", "term", "tier", "bound", "docs", "impacts", "w", "items")

    now = stored(pieces(0).groupBy("segment", "block").applyInPandas(lambda rows: _score(rows, None, k), _FOUND))
    if rounds is not None:
        rounds.append(now.where("score is null").count())
    for tier in range(1, TIERS):
        best = _ranked(now.where("score is not null"), k).groupBy("item").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("least"))
        open_ = now.where("score is null").join(best, "item", "left").where(F.col("reach") >= F.coalesce("least", F.lit(1)))
        open_ = stored(open_.select("segment", "item", F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block")))
        if rounds is not None:
            rounds.append(open_.count())
        if open_.isEmpty():
            drop_stored(open_)
            break
        left = pieces(tier).join(open_.select("segment", "block").distinct(), ["segment", "block"], "left_semi")
        again = left.groupBy("segment", "block").cogroup(open_.groupBy("segment", "block")).applyInPandas(lambda rows, pairs: _score(rows, set(pairs["item"]), k), _FOUND)
        after = stored(now.join(open_, ["segment", "item"], "left_anti").unionByName(again))
        drop_stored(now, open_)
        now = after
    drop_stored(asked, terms, wanted)
    return _ranked(now.where("exact"), k).select("item", "rank", "doc_id", "score")


def op11_tiered_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of all for each item of benchmark; equal items (id and text) are answered once."""
    items = read(spark, sf_dir, "benchmark").select("item_id", "text").distinct()
    items = stored(items.withColumn("item", F.monotonically_increasing_id()))
    index = build_index(read(spark, sf_dir, "documents").select("doc_id", "text"))
    found = stored(search(index, items))
    index.drop()
    return found.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


_SQL_TERMS = (
    "unnest(regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
)

OP11_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
words AS (SELECT r, {_SQL_TERMS.format("text")} AS term FROM docs),
tfs AS (SELECT r, term, count(*) AS tf FROM words GROUP BY 1, 2),
lengths AS (SELECT r, sum(tf)::BIGINT AS n FROM tfs GROUP BY 1),
totals AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM lengths),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY 1),
items AS (SELECT DISTINCT item_id, text FROM benchmark),
asked AS (SELECT item_id, text, {_SQL_TERMS.format("text")} AS term FROM items),
qtf AS (SELECT item_id, text, term, count(*) AS times FROM asked GROUP BY 1, 2, 3),
scored AS (
  SELECT q.item_id, q.text, d.doc_id, t.r, sum(q.times * floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
      * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * big_n) // big_l))))::BIGINT AS score
  FROM qtf q JOIN tfs t USING (term) JOIN dfs USING (term) JOIN lengths l ON l.r = t.r JOIN docs d ON d.r = t.r, totals
  GROUP BY 1, 2, 3, 4),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id, r) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
