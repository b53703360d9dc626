import random

import numpy as np

from labquarry.llm import jaccard


def brute(rows, threshold=0.8):
    sets = [set(jaccard.shingles(t).tolist()) for _, t in rows]
    n, top = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
                n[a] += 1
                n[b] += 1
                top[max(find(a), find(b))] = min(find(a), find(b))
    out = []
    for k, (i, _) in enumerate(rows):
        if not sets[k]:
            out.append((i, i, 0))
            continue
        ids = [rows[j][0] for j in range(len(rows)) if sets[j] and find(j) == find(k) and rows[j][0] is not None]
        out.append((i, min(ids) if ids else None, n[k]))
    return sorted(out, key=str)


def texts(seed=1, groups=12, n=6, words=60):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [rng.choice("abcdefgh") * rng.randint(1, 6) + str(rng.randint(0, 99)) for _ in range(words)]
        for _ in range(n):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(words)] = str(rng.random())
            rows.append((len(rows) * 3 + 1, " ".join(w)))
    return rows


def check(spark, rows, extra=""):
    df = spark.createDataFrame([(*r, "x") for r in rows] if extra else rows, "id long, text string" + extra)
    got = jaccard.near_duplicates(df).select("id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_like_brute_force(spark):
    check(spark, texts())


def test_odd_rows(spark):
    rows = texts(2, 3, 3) + [(500, None), (501, ""), (502, "..."), (503, "one two"), (504, "One, two!"), (505, "one two three")]
    rows += [(600, "long " * 30000), (601, "long " * 30000), (1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "only here with a null id")]
    check(spark, rows, ", class_id string")
    assert jaccard.near_duplicates(spark.createDataFrame([], "id long, text string")).count() == 0


def test_large_bucket_of_near_copies(spark):
    """More texts alike than a bucket compares at once: splits and the grid of blocks lose no link and count none twice."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for k in range(300):
        w = list(base)
        w[rng.randrange(80)] = f"own{k}"
        rows.append((k, " ".join(w)))
    check(spark, rows)


def test_runs_reach_recall():
    runs = jaccard.n_runs()
    met = 0.8 * (1 - 0.2**jaccard.BRANCHES) ** jaccard.LEVELS
    assert (1 - met) ** runs <= 1 - jaccard.RECALL < (1 - met) ** (runs - 1)


def test_intersections():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 50, rng.integers(0, 40))).astype(np.uint64) for _ in range(20)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = jaccard.intersections(sets)
    assert all(got[i, j] == want[i][j] for i in range(20) for j in range(20) if i != j)


def test_stage_keeps_one(spark):
    rows = texts(7, 5, 4) + [(900, None), (901, ""), (4, texts(7, 5, 4)[1][1]), (None, "null id but clean words here")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = jaccard.keep_one_of_each(spark, df, "").toPandas()
    classes = {(c, i) if n == 0 else (c, None) for i, c, n in brute(rows)}
    assert list(got.columns) == df.columns and len(got) == len(classes)


def test_stage_with_repeats_and_clashing_columns(spark):
    near = texts(7, 2, 4)
    rows = [*near, near[1], near[1], (near[1][0], near[2][1]), (None, near[3][1]), (None, "a b c d e f g h"), (None, "a b c d e f g h"), (5, "..."), (5, "..."), (None, None)]
    schema = "doc_id long, text string, _key string, _group int, _class int, _own string, key string, idk int, row string, _at int, _n int, _one int"
    df = spark.createDataFrame([(i, t, *["k", 1, 2, "o", "y", 3, "r", 4, 5, 6]) for i, t in rows], schema)
    got = jaccard.keep_one_of_each(spark, df, "")
    assert got.columns == df.columns
    out = got.collect()
    assert all(tuple(r)[2:] == ("k", 1, 2, "o", "y", 3, "r", 4, 5, 6) for r in out)
    found = brute(rows)
    assert len(out) == sum(n == 0 for _, _, n in found) + len({c for _, c, n in found if n})
    assert jaccard.keep_one_of_each(spark, df.limit(0), "").count() == 0


def test_sieve_lets_all_wanted_through(spark):
    from pyspark.sql import functions as F

    from labquarry.llm import common

    rows = common.stored(spark.range(20000).withColumn("h", F.xxhash64("id")))
    wanted = common.stored(rows.where("id % 20 = 3"))
    passes, joined = common.sieve(rows, F.col("h"), wanted, F.col("h"))
    got = {r["id"] for r in joined.where(passes).select("id").collect()}
    assert got >= set(range(3, 20000, 20)) and len(got) < 4000
    assert joined.where(passes | ~passes).count() == 20000
    passes, joined = common.sieve(rows, F.col("h"), rows.where("id < 0"), F.col("h"))
    assert joined.where(passes).count() == 0


def test_hot_keys_join_like_others(spark):
    from pyspark.sql import functions as F

    from labquarry.llm import common

    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 700).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).where("k <> 5")
    for how in ("inner", "left"):
        got = common.join_by_key(rows, table, ["k"], "n", 2000, how).select("k", "id", "top")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rows.join(table, "k", how).select("k", "id", "top").collect()), key=str)
