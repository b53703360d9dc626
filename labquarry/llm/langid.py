"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter keeps, at each of its positions, one bit for every language. The positions that an n-gram
hashes to are combined by AND, so that one look-up returns all languages which may contain the n-gram. Whole texts
are read; for each language the n-grams that have its bit are counted, and from that popcount the false positives to
be expected of the filter are taken off. The largest corrected count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.running import percentiles
from .common import drop_stored, read, stored

SIZES = (2, 3, 4)
POSITIONS = 1 << 20
HASHES = 3
#: About so many labelled documents, chosen by hash, teach the filter: the documented bound of the training sample.
TRAINING_DOCUMENTS = 6000
#: The stage may reject about this share of documents like the labelled ones, at most.
REJECTED = 0.001
UNKNOWN = "und"


def letters(text: str) -> np.ndarray:
    """Code points of the lower-case text; every run of other characters than letters is one space; a space at each end."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    small = _table()
    is_letter = small[np.minimum(points, len(small) - 1)]
    high = points >= len(small) - 1
    if high.any():
        is_letter = is_letter.copy()
        is_letter[high] = [chr(c).isalpha() for c in points[high].tolist()]
    kept = np.where(is_letter, points, 32).astype(np.uint64)
    if not is_letter.any():
        return np.zeros(0, np.uint64)
    kept = np.concatenate([[np.uint64(32)], kept, [np.uint64(32)]])
    return kept[np.concatenate([[True], (kept[1:] != 32) | (kept[:-1] != 32)])]


_letters: list[np.ndarray] = []


def _table() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x3000)] + [False]))
    return _letters[0]


def grams(text: str) -> np.ndarray:
    """A 64-bit hash of each n-gram of the text, of all sizes, repeats included; none if it has no letter."""
    points = letters(text)
    out = []
    for n in SIZES:
        if len(points) < n:
            continue
        h = np.full(len(points) - n + 1, np.uint64(n), np.uint64)
        for k in range(n):
            h = (h ^ points[k : len(points) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out.append(h)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _places(h: np.ndarray, positions: int) -> Iterator[np.ndarray]:
    for k in range(HASHES):
        yield ((h >> np.uint64(20 * k)) & np.uint64(positions - 1)).astype(np.int64)


@dataclass
class LanguageFilter:
    """slices: POSITIONS x words of 64 bits; bit j belongs to languages[j]. false_positive: each language's rate."""

    languages: list[str]
    slices: np.ndarray
    false_positive: np.ndarray

    @staticmethod
    def of(profiles: dict[str, np.ndarray], positions: int = POSITIONS) -> LanguageFilter:
        languages = sorted(profiles)
        slices = np.zeros((positions, max(1, -(-len(languages) // 64))), np.uint64)
        for j, language in enumerate(languages):
            for at in _places(profiles[language], positions):
                slices[np.unique(at), j // 64] |= np.uint64(1 << (j % 64))
        filled = np.array([((slices[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)).mean() for j in range(len(languages))])
        return LanguageFilter(languages, slices, filled**HASHES)

    def masks(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram, the bits of all languages that may contain it."""
        found = None
        for at in _places(h, len(self.slices)):
            found = self.slices[at] if found is None else found & self.slices[at]
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and a score from 0 to 1: the winner's corrected count over that of the n-grams in any language."""
        h = grams(text or "")
        if not len(h) or not self.languages:
            return UNKNOWN, 0.0
        masks = self.masks(h)
        shifts = np.arange(64, dtype=np.uint64)
        bits = np.concatenate([_popcounts(masks[:, w], shifts) for w in range(masks.shape[1])])[: len(self.languages)]
        corrected = np.maximum(0, (bits - len(h) * self.false_positive) / (1 - self.false_positive))
        best = int(np.argmax(corrected))
        return self.languages[best], float(min(1.0, corrected[best] / len(h)))


def _popcounts(masks: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many masks have each of the 64 bits; equal masks are counted first."""
    values, n = np.unique(masks, return_counts=True)
    return (((values[:, None] >> shifts) & np.uint64(1)) * n[:, None].astype(np.uint64)).sum(0).astype(float)


def taught_by(labelled: DataFrame, text: str = "text", lang: str = "lang", bound: int = TRAINING_DOCUMENTS) -> DataFrame:
    """(text, lang): about `bound` rows chosen by their text's hash; rows with a null text or language teach nothing."""
    labelled = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    share = min(1.0, bound / max(1, labelled.count()))
    return labelled.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", bound: int = TRAINING_DOCUMENTS, positions: int = POSITIONS) -> LanguageFilter:
    """A filter learnt from about `bound` rows chosen by their text's hash; rows with a null language teach nothing.

    An n-gram enters a language's profile if its rate there is at least a quarter of its highest rate in any
    language: passages of one language in documents of another do not blur the profiles. All such n-grams that two
    documents have enter (or one, where a language has fewer than 20); the training sample alone bounds their number.
    """
    picked = taught_by(labelled, text, lang, bound)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for t, language in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                found.setdefault(language, []).append(np.unique(grams(t)))  # a document counts once for an n-gram
        for language, parts in sorted(found.items()):
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([language], pa.string()), pa.array([None], pa.int64()), pa.array([len(parts)], pa.int64())], ["lang", "gram", "n"])

    counts = stored(picked.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    docs = counts.where("gram is null").select("lang", F.col("n").alias("docs"))
    rates = counts.where("gram is not null").join(F.broadcast(docs), "lang").withColumn("rate", F.col("n") / F.col("docs"))
    # One row for each language: bounded by the training sample, as the n-grams are.
    top = rates.groupBy("gram").agg(F.max("rate").alias("top"))
    kept = rates.join(top, "gram").where("rate >= top / 4 and (n >= 2 or docs < 20)")
    profiles = {r["lang"]: np.zeros(0, np.uint64) for r in docs.collect()}
    for language, some in kept.select("lang", "gram").toPandas().groupby("lang")["gram"]:  # n-grams of the bounded sample
        profiles[language] = np.sort(some.to_numpy(np.int64)).view(np.uint64)
    drop_stored(counts)
    return LanguageFilter.of(profiles, positions)


def predict(df: DataFrame, model: LanguageFilter, text: str = "text") -> DataFrame:
    """df with lang_pred and score (columns of those names are replaced); `und`, 0 for null texts and texts without a letter.

    Ties go to the language that comes first by name; very long texts are read whole; repeated rows get equal results;
    an empty table stays empty.
    """
    df = df.drop("lang_pred", "score")
    shared = df.sparkSession.sparkContext.broadcast(model)  # POSITIONS words, whatever the corpus
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.predict(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([*df.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    return df.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves the remainder 2 by 4; false for null ids."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def op6_language_bitmask_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(docs.where("not held_out"))
    out = predict(docs.select("doc_id", "held_out", "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def least_score(labelled: DataFrame, share: float = REJECTED) -> float:
    """Half the score that all but `share` of the labelled documents (lang_pred, score) reach, all of them read; 0 if there are none."""
    found = percentiles(labelled.where(F.col("lang_pred") != UNKNOWN), "score", [share]).first()
    return ((found[0] if found else None) or 0.0) / 2


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str, languages: tuple[str, ...] | None = None) -> DataFrame:
    """Pipeline stage: documents that are in no language go; those that stay and have no `lang` get the predicted one.

    In no language are null texts, texts without a letter, those with no more n-grams of any language than the filter's
    false positives account for, and those whose score is under half of what all but a thousandth of the labelled
    documents reach. `languages`, if given, are the predictions that stay (by default all). If no language could be
    learnt, all texts with a letter stay. Ties go to the language that comes first by name; very long texts are read
    whole; repeated rows are treated alike; an empty table stays empty; columns of any name are carried along.
    """
    names = docs.columns
    taught = docs.where(~held_out(F.col("doc_id"))).select("text", "lang")
    model = fit(taught)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    boxed = docs.select(F.struct(*(docs[f"`{c}`"] for c in names)).alias("row"), "text")
    scored = stored(predict(boxed, model).drop("text"))  # each text is looked at once, for the threshold and for the choice
    least = least_score(scored.where(F.col("row.text").isNotNull() & F.col("row.lang").isNotNull() & ~held_out(F.col("row.doc_id"))))
    found = scored.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") > 0) & (F.col("score") >= least))
    if languages is not None:
        found = found.where(F.col("lang_pred").isin(*languages))
    lang = F.coalesce(F.col("row.lang"), F.col("lang_pred").cast(docs.schema["lang"].dataType)).alias("lang")
    return found.select(*(lang if c == "lang" else F.col(f"row.`{c}`").alias(c) for c in names))
