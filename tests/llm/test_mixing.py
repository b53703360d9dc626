import pandas as pd
import pytest

from labquarry.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fill(sizes, weights, total, cap):
    """Reference: share by weight, cap, share the excess again."""
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    left = total
    while open_ and left > 1e-9:
        w = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / w >= cap * sizes[s] - 1e-12}
        if not full:
            for s in open_:
                target[s] = left * weights[s] / w
            break
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def docs(n=600, sources=(None, "a", "b", "c", "é", "Z")):
    out = []
    for k in range(n):
        source = sources[0 if k % 3 == 0 else 1 + k % (len(sources) - 1)]
        out.append((k, None if k % 50 == 7 else " \t".join(["w"] * (k % 23)), "en", source, 1))
    return out


def test_targets_and_taken(spark, tmp_path):
    rows = docs()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op2_pivotal_rounding(spark, str(tmp_path)).toPandas()
    again = mixing.op2_pivotal_rounding(spark, str(tmp_path)).toPandas()
    key = ["doc_id", "taken"]
    assert sorted(map(tuple, got[key].to_numpy())) == sorted(map(tuple, again[key].to_numpy()))
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    assert dict(zip(got.doc_id, got["size"], strict=True)) == size
    assert (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all()
    by = {}
    for r in rows:
        by[r[3]] = by.get(r[3], 0) + size[r[0]]
    order = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    want = fill(by, weights, 1.5 * sum(by.values()), 2.0)
    for s in order:
        own = got[got.source.isna() if s is None else got.source == s]
        assert own.target.iloc[0] == pytest.approx(want[s]) and own.source_size.iloc[0] == by[s]
        assert abs(own.taken.sum() - want[s]) <= 11.5


def test_expectations(spark):
    """Over seeds, a document's copies average target over size of the source."""
    sizes = spark.createDataFrame([(k, 1 + k % 5, "s") for k in range(200)], "doc_id long, size long, source string").cache()
    targets = spark.createDataFrame([("s", 600, 200, 210.0)], "source string, source_size long, n long, target double")
    drawn = pd.concat([mixing.copies(sizes, targets, seed).toPandas() for seed in range(6)])
    assert drawn.groupby("size")["drawn"].mean().between(0.2, 0.5).all()


def test_repeats_ties_empty(spark):
    rows = [(1, 3, "a")] * 500 + [(None, 2, None)] * 7 + [(2, 0, "a")]
    sizes = spark.createDataFrame(rows, "doc_id long, size long, source string").cache()
    got = mixing.copies(sizes, mixing.source_targets(sizes)).toPandas()
    assert got["alike"].sum() == len(rows) and (got["drawn"] <= 2 * got["alike"]).all()
    assert (got[got["size"] == 0]["drawn"] == 0).all()
    for _, own in got[got["size"] > 0].groupby("source", dropna=False):
        assert abs((own["drawn"] * own["size"]).sum() - own.target.iloc[0]) <= own["size"].max()
    none = spark.createDataFrame([], "doc_id long, size long, source string")
    assert mixing.copies(none, mixing.source_targets(none)).count() == 0


def test_stage_repeats_rows(spark):
    rows = docs(200) + [(1, "w w", "en", "b", 9), (1, "v v", "en", "b", 9)]
    extra = "_size string, _times string, size string, alike string, row string, number string"
    df = spark.createDataFrame([(*r, *["x"] * 6) for r in rows], f"{SCHEMA}, {extra}")
    got = mixing.mix(spark, df, "").toPandas()
    assert list(got.columns) == df.columns and (got[["_size", "_times", "size", "alike", "row", "number"]] == "x").all().all()
    assert got.groupby(["doc_id", "text"]).size().max() <= 2 and len(got) > 100


def test_stage_on_nothing(spark):
    assert mixing.mix(spark, spark.createDataFrame([], SCHEMA), "").count() == 0
    no_words = spark.createDataFrame([(1, None, "en", "s", 0), (2, " ", None, None, 1)], SCHEMA)
    assert mixing.mix(spark, no_words, "").count() == 0


def test_long_texts_count_whole(spark):
    rows = [(k, "w " * (300_000 if k == 3 else 50), "en", "s", 1) for k in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    sizes = df.select("doc_id", mixing.words(df.text).alias("size"), "source")
    assert sizes.agg({"size": "max"}).first()[0] == 300_000
    got = mixing.copies(sizes, mixing.source_targets(sizes)).toPandas()
    assert abs((got["drawn"] * got["size"]).sum() - got.target.iloc[0]) <= 150_000


def test_long_documents_do_not_miss_the_target(spark):
    """The tree's last document may be long; the reserve settles it to a few words."""
    sizes = spark.createDataFrame([(k, 900 + k % 500 if k % 40 == 0 else 1 + k % 30, "ab"[k % 3 == 0]) for k in range(6000)], "doc_id long, size long, source string").cache()
    for seed in range(3):
        got = mixing.copies(sizes, mixing.source_targets(sizes), seed).toPandas()
        for _, own in got.groupby("source"):
            assert abs((own["drawn"] * own["size"]).sum() - own.target.iloc[0]) <= 15
            assert ((own["drawn"] == own.drawn.min()) | (own["drawn"] == own.drawn.min() + 1)).all()


def test_closing_moves_mass_to_the_nearer_side(spark):
    from pyspark.sql import functions as F

    units = [(1, 1, 1000, 0.3), (2, 1, 400, 0.5), (3, 1, 200, 0.5), (4, 1, 10, 0.25)]
    df = spark.createDataFrame([(units,)], f"u array<{mixing._UNIT}>")
    got = df.select(mixing._fold(F.col("u"), None).alias("f")).first()["f"]
    # 1 gives 200 to 2, which is full, and 100 to 3, which is full as 1 is empty: a tie, and 4 is what is left.
    assert [u["id"] for u in got["up"]][:1] == [2] and sum(u["size"] for u in got["up"]) + got["rest"]["p"] * got["rest"]["size"] == pytest.approx(602.5)


def test_fold_like_a_plain_pivotal_loop(spark):
    """The same pairings done in plain Python, with the same random numbers, round the same units up."""
    from pyspark.sql import functions as F

    units = [(100 + k, 1, 3 + 7 * k % 11, ((k * 37) % 97 + 1) / 99) for k in range(30)]
    df = spark.createDataFrame([(units,)], f"u array<{mixing._UNIT}>")
    got = df.select(mixing._fold(F.col("u"), 5).alias("f")).first()["f"]
    pairs = [(a[0], b[0]) for a in units for b in units]
    draws = spark.createDataFrame(pairs, "r long, u long").select("r", "u", mixing._uniform(F.col("r"), F.lit(1).cast("long"), F.col("u"), F.lit(1).cast("long"), F.lit(5)).alias("x"))
    draw = {(r["r"], r["u"]): r["x"] for r in draws.collect()}
    rest, up = None, []
    for i, _, size, p in units:
        if rest is None:
            rest = (i, size, p)
            continue
        j, other, q = rest
        gain, lose = min((1 - q) * other, p * size), min(q * other, (1 - p) * size)
        if draw[j, i] * (gain + lose) < lose:  # mass moves to the rest
            q, p = q + gain / other, p - gain / size
            done_rest = (1 - rest[2]) * other <= units[[u[0] for u in units].index(i)][3] * size
            if done_rest:
                up.append(j)
        else:
            done_rest = rest[2] * other <= (1 - p) * size
            q, p = q - lose / other, p + lose / size
            if not done_rest:
                up.append(i)
        rest = (i, size, p) if done_rest else (j, other, q)
    assert [u["id"] for u in got["up"]] == up and got["rest"]["id"] == rest[0] and abs(got["rest"]["p"] - rest[2]) < 1e-9
