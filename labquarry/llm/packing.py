"""Best-fit packing by minimum bin slack.

Lengths are at most `capacity`, so their histogram has at most that many entries whatever the corpus. The packing is
found on the histogram: each bin starts from the longest length left, a bitset subset-sum over the lengths available
finds the fullest feasible combination, and that combination is removed as often as the counts allow. Pieces are then
numbered within their length without a hot task and looked up in the plan.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, read, stored

CAPACITY = 4096
VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Distinct words a worker remembers with their ids, and their longest length; beyond so many, the memory starts anew.
WORDS_KEPT = 400_000
LONGEST_KEPT = 64


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """{length: times}: a combination of the lengths available whose sum is the largest that is at most room.

    A bitset holds the sums reached; lengths come longest first and the search ends as soon as room itself is reached.
    """
    full, reached, steps = (1 << (room + 1)) - 1, 1, []
    for x in lengths:
        if x > room:
            continue
        left, part = min(counts[x], room // x), 1
        while left > 0:
            take = min(part, left)
            before = reached
            reached |= (reached << (take * x)) & full
            if reached != before:
                steps.append((x, take, before))
            left -= take
            part *= 2
            if reached >> room & 1:
                break
        if reached >> room & 1:
            break
    total, used = reached.bit_length() - 1, {}
    for x, take, before in reversed(steps):
        if not before >> total & 1:
            total -= take * x
            used[x] = used.get(x, 0) + take
    return used


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """[({length: times}, bins)]: patterns with the number of bins each fills; every piece is placed.

    Bit x of `there` says that length x is left, bit capacity - x of `mirrored` likewise: one shift and one AND find
    all pairs of a given sum. One to three lengths that fill the bin are looked for so; only if none do, the whole
    subset-sum runs. Either way no combination could be fuller.
    """
    counts = {x: n for x, n in histogram.items() if n > 0}
    there = sum(1 << x for x in counts)
    mirrored = sum(1 << (capacity - x) for x in counts)
    patterns = []

    def pair(total: int, other: int) -> tuple[int, ...] | None:
        """Two lengths left that add up to total, beside `other`, or one."""
        if there >> total & 1 and counts[total] > (total == other):
            return (total,)
        both = there & ((mirrored >> (capacity - total)) if total <= capacity else 0)
        while both:
            x = both.bit_length() - 1
            y = total - x
            if counts[x] >= 1 + (x == y) + (x == other) and counts[y] >= 1 + (x == y) + (y == other):
                return (x, y)
            both ^= 1 << x
        return None

    while there:
        seed = there.bit_length() - 1
        counts[seed] -= 1
        room, used = capacity - seed, None
        if room:
            found = pair(room, 0)
            third = there & ((1 << room) - 1) if not found else 0
            while third and not found:
                x = third.bit_length() - 1
                third ^= 1 << x
                if 3 * x < room:
                    break  # the largest of three is at least a third
                if counts[x] and (rest := pair(room - x, x)):
                    found = (x, *rest)
            if found:
                used = {x: found.count(x) for x in found}
            else:
                left = there & ((1 << (room + 1)) - 1)
                lengths = []
                while left:
                    x = left.bit_length() - 1
                    left ^= 1 << x
                    if counts[x] > 0:
                        lengths.append(x)
                used = fullest(counts, lengths, room)
        used = used or {}
        counts[seed] += 1
        used[seed] = used.get(seed, 0) + 1
        times = min(counts[x] // n for x, n in used.items())
        for x, n in used.items():
            counts[x] -= n * times
            if not counts[x]:
                there ^= 1 << x
                mirrored ^= 1 << (capacity - x)
        patterns.append((used, times))
    return patterns


def layout(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, after the last, first sequence, times in a sequence, offset of the first of them)."""
    rows, sequence, seen = [], 0, {}
    for used, bins in patterns:
        offset = 0
        for x in sorted(used, reverse=True):
            n = used[x]
            at = seen.get(x, 0)
            rows.append((x, at, at + n * bins, sequence, n, offset))
            seen[x] = at + n * bins
            offset += n * x
        sequence += bins
    return rows


def pack(pieces: DataFrame, length: str, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset: where each lies; lengths are from 1 to capacity.

    pieces should be stored (it is read several times). Ties and repeated rows get places of their own.
    """
    spark = pieces.sparkSession
    histogram = {r[length]: r["count"] for r in pieces.groupBy(length).count().collect()}  # at most `capacity` rows
    rows = layout(plan_bins(histogram, capacity))
    plan = spark.createDataFrame(
        pd.DataFrame(rows, columns=["_length", "_from", "_to", "_sequence", "_times", "_offset"]).astype("int64"),
        "_length long, _from long, _to long, _sequence long, _times long, _offset long",
    )
    placed = numbered(pieces, [length], order, "_number")
    on = (placed[length] == plan["_length"]) & (placed["_number"] >= plan["_from"]) & (placed["_number"] < plan["_to"])
    place = F.col("_number") - F.col("_from")
    # The plan's size is bounded by the capacity, not by the corpus: every pattern uses up a length or all but a few of it.
    return placed.join(F.broadcast(plan), on).select(
        *(placed[c] for c in pieces.columns),
        (F.col("_sequence") + F.expr("(_number - _from) div _times")).alias("sequence_id"),
        (F.col("_offset") + (place % F.col("_times")) * F.col("_length")).alias("offset"),
    )


#: Words of these letters, with or without a run of these signs after them (which stays one), need no normalising but lower case.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")


def _byte_signs() -> dict[int, int]:
    """The sign that byte-level vocabularies write for each byte: printable ones stay, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    return {x: x for x in plain} | {x: 256 + i for i, x in enumerate(rest)}


class Words(dict):
    """Ids of white-space free words, as little-endian unsigned 32-bit integers, remembered up to a bound, if not too long.

    The tokenizer drops white space and nothing it does reaches across it, so a text's ids are those of its words in turn.
    Plain words go straight to the merges, which is most of the work saved; all others through the whole tokenizer.
    """

    def __init__(self, file: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        self.model, self.signs, self.parts = self.tokenizer.model, _byte_signs(), {}

    def part(self, word: str) -> bytes:
        """Ids of lower-case letters, or of a run of signs."""
        if (ids := self.parts.get(word)) is None:
            written = word.encode().decode("latin-1").translate(self.signs)
            ids = array("I", [t.id for t in self.model.tokenize(written)]).tobytes()
            if len(word) <= LONGEST_KEPT:
                self.parts[word] = ids
        return ids

    def learn(self, words: set[str]) -> None:
        if len(self.parts) > WORDS_KEPT:
            self.parts.clear()
        others = []
        for word in words:
            if plain := _PLAIN.fullmatch(word):
                letters, sign = plain.groups()
                self[word] = self.part(letters.lower()) + (self.part(sign) if sign else b"")
            else:
                others.append(word)
        for k in range(0, len(others), 4096):
            some = others[k : k + 4096]
            for word, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self[word] = array("I", e.ids).tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if len(self) > WORDS_KEPT:
                self.clear()
            words = text.replace("\n", " ").split(" ")
            try:
                out.append(b"".join(map(self.__getitem__, words)))
            except KeyError:
                new = {w for w in words if w not in self}
                self.learn(new)
                out.append(b"".join(map(self.__getitem__, words)))
                for w in new:
                    if len(w) > LONGEST_KEPT:
                        del self[w]
        return out

    def forget(self) -> None:
        self.clear()
        self.parts.clear()


@lru_cache(maxsize=1)
def words_of(file: str) -> Words:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Words(file)


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per piece of each document: doc_id, piece, start, length, ids_crc32. Null texts count as empty ones."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(vocabulary_file(vocabulary))
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(words.ids(texts)):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])
        words.forget()  # a worker is used for other tasks too

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(split, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs (doc_id, text; further columns are ignored) cut into pieces and packed; an empty table packs into nothing.

    Repeated rows are packed as often as they come; a null text is one end token.
    """
    pieces = stored(pieces_of(docs, capacity, vocabulary))
    return pack(pieces, "length", ["doc_id", "piece", "ids_crc32"], capacity)


def op10_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
