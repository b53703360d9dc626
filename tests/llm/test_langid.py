import numpy as np
import pytest
from pyspark.sql import functions as F

from labquarry.llm import langid

SF = "/root/testdata/sf0.001"


def test_filter_returns_every_language():
    profiles = {f"l{j:03}": np.arange(j, 5000, 7, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for j in range(70)}
    f = langid.LanguageFilter.of(profiles, 1 << 18)
    masks = f.masks(profiles["l003"])
    assert masks.shape[1] == 2
    for name in ("l003", "l010", "l066"):  # same n-grams, as 3, 10 and 66 agree mod 7
        j = f.languages.index(name)
        n = np.isin(profiles["l003"], profiles[name]).sum()
        assert ((masks[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)).sum() >= n > 0


def test_held_out_accuracy(spark):
    got = langid.op6_language_bitmask_filters(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert len(held) > 20 and (held["lang"] == held["lang_pred"]).mean() >= 0.97
    assert got["score"].between(0, 1).all()


def test_odd_texts(spark):
    rows = [(1, "the cat and the dog are in the house", "en"), (2, "der hund und die katze sind im haus", "de"), (3, "no", None)] * 30
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = [(1, None, "z"), (2, "", "z"), (3, "123 !?", "z"), (4, "the house " * 30000, "z"), (4, "the house", "z"), (None, "der hund", "z"), (5, "汉字", "z")]
    got = langid.predict(spark.createDataFrame(odd, "doc_id long, text string, score string"), model).orderBy(F.col("text")).toPandas()
    by = dict(zip(got["text"], got["lang_pred"], strict=True))
    assert by[None] == by[""] == by["123 !?"] == "und" and by["the house"] == "en" and by["der hund"] == "de" and by["汉字"] in ("de", "en")
    assert len(got) == 7
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert langid.predict(spark.createDataFrame(odd, "doc_id long, text string, score string"), langid.fit(empty)).where("lang_pred <> 'und'").count() == 0


def test_predictions_like_plain_counts(spark, monkeypatch):
    """Against sets of n-grams kept whole: the filter's corrected counts differ by its rare false positives alone."""
    taught = {}
    of = langid.LanguageFilter.of
    monkeypatch.setattr(langid.LanguageFilter, "of", staticmethod(lambda profiles, positions=langid.POSITIONS: taught.update(profiles) or of(profiles, positions)))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    got = langid.predict(docs.select("text"), model).toPandas()
    for text, lang, score in zip(got["text"], got["lang_pred"], got["score"], strict=True):
        h = langid.grams(text)
        plain = {k: np.isin(h, v).sum() / max(1, len(h)) for k, v in taught.items()}
        assert abs(score - max(plain.values())) <= 0.02 and plain[lang] >= max(plain.values()) - 0.02


def test_stage_fills_languages_and_carries_columns(spark):
    rows = [(k, t, lang, "s", 1, "x", 7) for k, (t, lang) in enumerate([("the cat and the dog are in the house", "en"), ("der hund und die katze sind im haus", "de")] * 40)]
    rows += [(900, "the dog in the house", None, "s", 4, "y", 8), (900, "the dog in the house", None, "s", 4, "y", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _text string, row int")
    got = langid.keep_identified(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.where("doc_id = 900").collect()) == [(900, "the dog in the house", "en", "s", 4, "y", 8)] * 2
    assert {r["lang"] for r in langid.keep_identified(spark, docs, "", ("de",)).collect()} == {"de"}
    assert langid.keep_identified(spark, docs.limit(0), "").count() == 0


def test_stage_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = docs.union(spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "12 34", "en", "s", 5)], docs.schema))
    got = langid.keep_identified(spark, more, SF)
    assert got.columns == docs.columns and got.count() == docs.count()


def test_stage_drops_untaught_scripts(spark):
    rows = [(k, t, lang, "s", 1) for k, (t, lang) in enumerate([("the cat and the dog are in the house", "en"), ("der hund und die katze sind im haus", "de")] * 40)]
    docs = spark.createDataFrame([*rows, (900, "汉字漢語", None, "s", 4), (901, "the house", None, "s", 9), (902, "12 34", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in langid.keep_identified(spark, docs, "").collect()} == {*range(80), 901}
    untaught = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["doc_id"] for r in langid.keep_identified(spark, untaught, "").collect()} == {*range(80), 900, 901}


def test_threshold_from_all_labelled_documents(spark, monkeypatch):
    """Few documents teach; the scores of all labelled ones set the threshold."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(langid.fit, "__defaults__", ("text", "lang", 60, langid.POSITIONS))
    seen = []
    least = langid.least_score

    def told(labelled, *more):
        seen.append((labelled.count(), least(labelled, *more), labelled.where("lang_pred != 'und'").agg(F.percentile("score", F.lit(langid.REJECTED))).first()[0] / 2))
        return seen[-1][1]

    monkeypatch.setattr(langid, "least_score", told)
    langid.keep_identified(spark, docs, SF).count()
    assert seen[0][0] == docs.where(~langid.held_out(F.col("doc_id"))).where("text is not null and lang is not null").count() and seen[0][1] == pytest.approx(seen[0][2])
