import math
import random
import re
from collections import Counter

import pytest

from labquarry.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return Counter(TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")))


def brute(docs, items, k=10):
    counts = [(i, c) for i, t in docs if (c := terms(t))]
    n, total, df = len(counts), sum(sum(c.values()) for _, c in counts), Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for p, (i, c) in enumerate(counts):
            m = 100 - 75 + (75 * sum(c.values()) * n) // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in terms(text).items() if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0, p))
        out += [(item, r + 1, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [0.0, 1.3])
def test_like_brute_force(spark, size):
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(60)] + ["The", "É", "ß9", "x" * 300]
    weights = [1 / (k + 1) ** size for k in range(len(words))]
    docs = [(k, rnd.choice([" ", "-", "\n"]).join(rnd.choices(words, weights, k=rnd.choice([1, 5, 40, 300])))) for k in range(400)]
    docs += [(7, docs[3][1]), (None, docs[4][1]), (500, None), (501, ""), (502, " .,;")] + [(k, docs[9][1]) for k in range(600, 640)]
    rnd.shuffle(docs)
    items = [(k, " ".join(rnd.choices(words, weights, k=rnd.randrange(1, 12)))) for k in range(30)] + [(50, None), (51, ""), (52, "unknown"), (53, "the THE é É ß9 w1,w1 w1")]
    table = spark.createDataFrame([(*d, "x", 1.0) for d in docs], "doc_id long, text string, term string, score double").repartition(3)
    index = lexical.build_index(table, segment_documents=50, first=2)
    asked = spark.createDataFrame(items, "item long, text string")
    rounds = []
    found = lexical.search(index, asked, rounds=rounds).collect()
    assert sorted([(r["item"], r["rank"], r["doc_id"], r["score"]) for r in found], key=str) == brute(docs, items)
    assert len(rounds) == 3 and rounds[0] > rounds[1] > rounds[2] > 0  # some items are settled in each tier
    index.drop()


def test_long_texts_in_slices():
    text = ("Ab, é9 " * 900_000).encode()
    assert len(text) > lexical.SLICE and lexical.term_counts(text) == Counter({b"ab": 900_000, "é9".encode(): 900_000})
    assert lexical.term_counts(b"x" * (lexical.SLICE + 5)) == Counter({b"x" * (lexical.SLICE + 5): 1})
    assert not lexical.term_counts(None) and not lexical.term_counts(b" \x00-")


def test_empty(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item long, text string")
    assert lexical.search(lexical.build_index(none), one).count() == 0
    index = lexical.build_index(spark.createDataFrame([(1, "a"), (2, "b b")], "doc_id long, text string"))
    assert lexical.search(index, none.withColumnRenamed("doc_id", "item")).count() == 0
    assert [r["doc_id"] for r in lexical.search(index, one).orderBy("rank").collect()] == [1, 2] or lexical.search(index, one).count() == 2


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS", 3)
    docs = [(k, f"t{k % 7} t{k % 3} all") for k in range(90)]
    items = [(k, f"t{k} all t1") for k in range(8)]
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    found = lexical.search(index, spark.createDataFrame(items, "item long, text string")).collect()
    assert sorted([(r["item"], r["rank"], r["doc_id"], r["score"]) for r in found], key=str) == brute(docs, items)
