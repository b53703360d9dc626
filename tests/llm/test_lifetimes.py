import random
import zlib

import numpy as np
import pytest

from labquarry.llm import lifetimes


def test_vertical_counters():
    rnd = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 64, 301):
        masks, weights = rnd.integers(0, 1 << 40, n), rnd.integers(1, 9, n)
        counters, lanes = lifetimes.VerticalCounters(masks, weights), np.arange(40)
        bits = ((masks[:, None] >> lanes) & 1) * weights[:, None]
        counts = bits.sum(0)
        assert counters.counts(lanes).tolist() == counts.tolist()
        there = lanes[counts > 0]
        for share in (0.0, 0.3, 0.5, 1.0):
            ranks = np.maximum(1, (counts[there] * share).astype(int))
            want = [int(np.searchsorted(bits[:, t].cumsum(), r)) for t, r in zip(there, ranks)]
            assert counters.select(there, ranks).tolist() == want


def brute(rows, batches):
    """rows: (key, item, value, mask)."""
    out, keys = [], {r[0] for r in rows if r[3]}
    for key in keys:
        old = (0, 0, 0, None, None, None)
        for t in range(batches):
            own = [r for r in rows if r[0] == key and r[3] and r[3] >> t & 1]
            values = sorted(r[2] for r in own if r[2] is not None)
            new = (len(own), len({r[1] for r in own} - {None}), sum(values), *((values[0], values[-1], values[len(values) // 2]) if values else (None,) * 3))
            if new != old:
                out.append((t, key, *(x for pair in zip(old, new) for x in pair)))
            old = new
    return sorted(out, key=str)


@pytest.mark.parametrize("run", [500_000, 60])
def test_like_brute_force(spark, monkeypatch, run):
    monkeypatch.setattr(lifetimes, "RUN", run)
    rnd = random.Random(run)
    rows = []
    for _ in range(1500):
        a, b = sorted(rnd.sample(range(13), 2))
        mask = rnd.choice([(1 << b) - (1 << a), (1 << b) - (1 << a), 0, None, 1])
        rows.append((rnd.choice(["hot"] * 6 + ["b", "c", None]), rnd.choice([None, "", "x", *map(str, range(40))]), rnd.choice([None, 0, -5, 7, 7, rnd.randrange(300)]), mask))
    rows += [("one", "t", 2**60, 1 << 11), ("nulls", None, None, 6)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "g string, item string, value long, mask long, part string, batch int").repartition(3)
    got = lifetimes.aggregates_by_batch(df, ["g"], batches=12).collect()
    sides = [f"{s}_{m}" for m in lifetimes.MEASURES for s in ("old", "new")]
    assert sorted([(r["batch"], r["g"], *(r[c] for c in sides)) for r in got], key=str) == brute(rows, 12)


def test_documents(spark, tmp_path):
    rnd = random.Random(9)
    docs = [(k, rnd.choice([None, "", "a", "b" * rnd.randrange(50)]), rnd.choice(["en", None]), rnd.choice(["s", "s", None, "t"]), rnd.choice([None, 3, rnd.randrange(90)])) for k in range(900)]
    docs += [docs[5], docs[5], (None, "n", "en", "s", 4), (7000, "é" * 300_000, "xx", "long", 300_000)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    rows = []
    for i, text, lang, source, n in docs:
        if i is not None:
            h = zlib.crc32(str(i).encode())
            b, q = h % 20, h // 20 % 4
            key, first = (source or "", lang or ""), sum(1 << t for t in range(b, min(b + q, 20)))
            rows.append((key, text, n, first))
            if q % 3 == 0:
                rows.append((key, text, None if n is None else n + q, sum(1 << t for t in range(b + q, 20))))
    got = lifetimes.op12_batch_lifetimes(spark, str(tmp_path)).collect()
    sides = [f"{s}_{m}" for m in lifetimes.MEASURES for s in ("old", "new")]
    assert sorted([(r["batch"], (r["source"], r["lang"]), *(r[c] for c in sides)) for r in got], key=str) == brute(rows, 20)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert lifetimes.op12_batch_lifetimes(spark, str(tmp_path)).count() == 0
    with pytest.raises(ValueError):
        lifetimes.aggregates_by_batch(spark.createDataFrame([], "g string, item string, value long, mask long"), ["g"], batches=63)


def test_without_keys(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 5, 3), ("b", 9, 2)], "item string, value long, mask long")
    got = lifetimes.aggregates_by_batch(df, [], batches=3).orderBy("batch").collect()
    assert [(r["batch"], r["new_n_rows"], r["new_n_distinct"], r["new_total"], r["new_median"]) for r in got] == [(0, 2, 1, 6, 5), (1, 2, 2, 14, 9), (2, 0, 0, 0, None)]
