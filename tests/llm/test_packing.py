import itertools
import random
import zlib

import numpy as np
import pytest

from labquarry.llm import packing


def test_fullest_is_best():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 20): rng.randint(1, 3) for _ in range(5)}
        room = rng.randint(1, 40)
        used = packing.fullest(counts, sorted(counts, reverse=True), room)
        best = max(s for n in itertools.product(*(range(c + 1) for c in counts.values())) if (s := sum(k * x for k, x in zip(n, counts, strict=True))) <= room)
        assert sum(x * n for x, n in used.items()) == best and all(n <= counts[x] for x, n in used.items())


def test_plan_places_every_piece():
    rng = random.Random(5)
    for capacity in (16, 100):
        histogram = {x: rng.randint(1, 40) for x in rng.sample(range(1, capacity + 1), 12)}
        placed = {}
        for used, bins in packing.plan_bins(histogram, capacity):
            assert sum(x * n for x, n in used.items()) <= capacity and bins > 0
            for x, n in used.items():
                placed[x] = placed.get(x, 0) + n * bins
        assert placed == histogram
    assert packing.plan_bins({}) == []


TEXTS = [None, "", "a", "Hello, world! Don't stop", "é Ü ß İstanbul ΣΑΣ", "x" * 30000, "tok " * 9000, "a b\tc\nd  e", "<|endoftext|> 12345 _", "a", "a"]


def test_words_are_the_tokenizers(spark):
    words = packing.words_of(packing.vocabulary_file(packing.VOCABULARY))
    texts = [t or "" for t in TEXTS]
    for _ in range(2):
        for text, ids in zip(texts, words.ids(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_lines_and_runs_of_signs_go_the_short_way(spark, monkeypatch):
    """Words at line ends, and with several signs after them, are the merges' work alone; drawn texts of awkward characters are as the tokenizer has them."""
    words = packing.words_of(packing.vocabulary_file(packing.VOCABULARY))
    words.forget()
    rnd = random.Random(5)
    drawn = ["".join(rnd.choices("aBs\u00e9\u0301\u00df\u0130\u03a3'!.,$%&#*<>|\u2260_-9\n\n  \t\x1c \u0085\r ~`^{}[]@/:;?\"()+", k=rnd.randrange(1, 30))) for _ in range(2000)]
    for text, ids in zip(drawn, words.ids(drawn), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
    words.forget()
    text = "Une.\nEn\u00e7eau Oned,### whole!!\n(no"
    want = words.tokenizer.encode(text.replace("(", ""), add_special_tokens=False).ids
    asked = []

    class Asked:
        def encode_batch_fast(self, some, add_special_tokens):
            asked.extend(some)
            return real.encode_batch_fast(some, add_special_tokens=add_special_tokens)

    real = words.tokenizer
    monkeypatch.setattr(words, "tokenizer", Asked())
    assert np.frombuffer(words.ids([text.replace("(", "")])[0], "<u4").tolist() == want and asked == []
    words.ids([text])
    assert asked == ["(no"]
    words.forget()


def test_packed_whole(spark):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(2, "a", "y"), (None, "b", "z")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length string")).toPandas()
    words = packing.words_of(packing.vocabulary_file(packing.VOCABULARY))
    want = []
    for doc, text, _ in rows:
        ids = words.tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((-1 if doc is None else doc, piece, at, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(want) == sorted(tuple(map(int, r)) for r in got[columns].fillna(-1).to_numpy())
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 4096
    assert got["sequence_id"].nunique() <= -(-sum(w[3] for w in want) // 4096) + 1


def test_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [500])
def test_hot_length(spark, n):
    got = packing.pack_documents(spark.createDataFrame([(k, "same words here") for k in range(n)], "doc_id long, text string")).toPandas()
    assert len(got) == n and got.duplicated(["sequence_id", "offset"]).sum() == 0
