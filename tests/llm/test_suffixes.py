import hashlib
import random

import numpy as np
import pytest

from labquarry.llm import suffixes


def brute(rows, length=200):
    data = [(t or "").encode() for _, t in rows]
    seen = {}
    for b in data:
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] = seen.get(b[k : k + length], 0) + 1
    out = []
    for (i, _), b in zip(rows, data, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def words(rng, n):
    return "".join(rng.choice("abcdefghij éß \n") for _ in range(n))


def check(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_bytes int")
    got = [tuple(r) for r in suffixes.removed(df, **more).drop("kept").collect()]
    assert sorted(got, key=str) == brute(rows)


def test_like_brute_force(spark):
    rng = random.Random(1)
    passage, edge, long_one = words(rng, 300), words(rng, 199), words(rng, 900)
    rows = []
    for k in range(40):
        parts = [words(rng, rng.randint(0, 500))]
        parts.append(rng.choice([passage, passage[:210], passage[90:], edge, long_one, long_one[100:620], ""]))
        parts.append(words(rng, rng.randint(0, 300)))
        rows.append((k, "".join(parts)))
    near = list(long_one)
    near[450] = "#"
    rows += [(100, "".join(near)), (101, long_one), (102, long_one), (102, long_one), (None, long_one)]
    check(spark, rows)


def test_periodic_and_odd(spark):
    rng = random.Random(2)
    twice = words(rng, 260)
    rows = [(1, None), (2, ""), (3, "a" * 199), (4, "b" * 200), (5, "c" * 201), (6, "xy" * 400), (7, twice + "-" + twice), (8, "z" * 5000 + words(rng, 100)), (9, words(rng, 200))]
    check(spark, rows)
    assert suffixes.removed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_texts_in_segments(spark):
    rng = random.Random(3)
    long_one = words(rng, 5200)
    check(spark, [(1, words(rng, 900) + long_one[:2000] + words(rng, 30) + long_one[2000:]), (2, long_one), (3, words(rng, 1000) + long_one[700:930])], segment=1000)


def test_hot_strings_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET", 20)
    rng = random.Random(4)
    passage = words(rng, 260)
    check(spark, [(k, words(rng, 120) + passage + words(rng, 90)) for k in range(60)])


def test_multikey_order():
    rng = np.random.default_rng(0)
    keys = [rng.integers(0, 4, 300), rng.integers(0, 4, 300), rng.integers(0, 100, 300)]
    order = suffixes.multikey_order(keys)
    rows = list(zip(*(k[order].tolist() for k in keys), strict=True))
    assert rows == sorted(rows) and sorted(order.tolist()) == list(range(300))


@pytest.mark.parametrize("width", [1, 5, 128])
def test_sliding_least(width):
    x = np.random.default_rng(1).integers(0, 1000, 700).astype(np.uint64)
    assert suffixes.sliding_least(x, width).tolist() == [x[k : k + width].min() for k in range(len(x) - width + 1)]
