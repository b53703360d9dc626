import numpy as np
import pytest

from labquarry.llm import ann, rangejoin

ODD = [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0] * 7 + [None]), (904, [float("inf")] * 8), (905, [])]


def vectors(n=400, d=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[n // 2 : n // 2 + 90] = x[n // 2] + 0.05 * rng.normal(size=(90, d))  # a crowd
    x[-30:] = x[5]  # copies
    return x


def frame(spark, x, odd=True, extra=True):
    rows = [(int(k), [float(v) for v in r]) for k, r in enumerate(x)] + (ODD if odd else [])
    return spark.createDataFrame([(*r, 1) for r in rows], "id long, vector array<double>, component_id int")


@pytest.mark.parametrize("d", [3, 8])
def test_range_join_like_brute_force(spark, d, monkeypatch):
    monkeypatch.setattr(rangejoin, "CHUNK", 64)
    x = vectors(d=d)
    got = rangejoin.linked(frame(spark, x, odd=d == 8)).toPandas().set_index("id").sort_index()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min(label[k], label[near[k]].min() if near[k].any() else label[k]) for k in range(len(x))])
        if (new == label).all():
            break
        label = new
    assert (got["n_links"][: len(x)].to_numpy() == near.sum(1)).all()
    assert (got["component_id"][: len(x)].to_numpy() == label).all()
    if d == 8:
        odd = got.loc[[i for i, _ in ODD]]
        assert (odd["n_links"] == 0).all() and (odd["component_id"] == odd.index).all()


def test_range_join_empty(spark):
    assert rangejoin.linked(frame(spark, np.zeros((0, 8)), odd=False)).count() == 0
    assert rangejoin.linked(frame(spark, np.zeros((0, 8)))).count() == len(ODD)


def test_search_recall_and_order(spark):
    x = vectors(1500, 16)
    x[:20] = x[100]
    df = frame(spark, x)
    got = ann.search(df, df.where("id % 50 = 0").select("id")).toPandas()
    hit = total = 0
    for q in range(0, len(x), 50):
        own = got[got["query_id"] == q].sort_values("rank")
        dist = np.sqrt(((x - x[q]) ** 2).sum(1))
        dist[q] = np.inf
        true = np.lexsort((np.arange(len(x)), dist))[:10]
        assert own["rank"].tolist() == list(range(1, 11)) and q not in set(own["id"])
        assert np.allclose(own["score"], dist[own["id"]], rtol=0, atol=1e-12)
        assert list(zip(own["score"], own["id"], strict=True)) == sorted(zip(own["score"], own["id"], strict=True))
        hit += len(set(true) & set(own["id"]))
        total += 10
    assert hit / total >= 0.9
    own = got[got["query_id"] == 0].sort_values("rank")
    assert own["id"].tolist() == list(range(1, 11)) and (own["score"] == 0).all()


def test_search_few(spark):
    df = frame(spark, vectors(200, 16)[:3])
    got = ann.search(df, df.select("id")).toPandas()
    assert got.groupby("query_id").size().tolist() == [2, 2, 2]
    none = frame(spark, np.zeros((0, 8)))
    assert ann.search(none, none.select("id")).count() == 0


def test_two_lengths(spark):
    """Vectors of a rarer length link and are found among themselves."""
    x = vectors(300, 16)
    rows = [(int(k), [float(v) for v in r]) for k, r in enumerate(x)]
    rows += [(1000, [1.0, 2.0, 3.0]), (1001, [2.0, 4.0, 6.0]), (1002, [1.0, 2.0, 3.1]), (1003, [-1.0, 0.0, 0.0]), (1004, [5.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = rangejoin.linked(df).toPandas().set_index("id")
    assert got.loc[[1000, 1001, 1002, 1003, 1004], "n_links"].tolist() == [2, 2, 2, 0, 0]
    assert got.loc[[1000, 1001, 1002, 1003, 1004], "component_id"].tolist() == [1000, 1000, 1000, 1003, 1004]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert (got["n_links"].sort_index()[:300].to_numpy() == ((u @ u.T) >= 0.9).sum(1) - 1).all()
    found = ann.search(df, df.where("id = 1000 or id = 1004 or id = 7").select("id")).toPandas()
    own = found[found["query_id"] == 1000].sort_values("rank")
    assert own["id"].tolist() == [1002, 1001, 1003] and not (found["query_id"] == 1004).any()
    assert len(found[found["query_id"] == 7]) == 10 and (found[found["query_id"] == 7]["id"] < 300).all()


def test_single_precision_links_like_double(spark):
    x = vectors(200, 8).astype(np.float32)
    rows = [(int(k), [float(v) for v in r]) for k, r in enumerate(x)]
    single = rangejoin.linked(spark.createDataFrame(rows, "id long, vector array<float>")).orderBy("id").collect()
    assert single == rangejoin.linked(spark.createDataFrame(rows, "id long, vector array<double>")).orderBy("id").collect()


def test_recall_where_codes_prune(spark, monkeypatch):
    """Far more vectors than are reranked: the codes decide."""
    monkeypatch.setattr(ann, "RERANK", 16)
    monkeypatch.setattr(ann, "SAMPLE", 2000)
    x = np.random.default_rng(3).normal(size=(8000, 24))
    df = frame(spark, x, odd=False)
    got = ann.search(df, df.where("id % 200 = 0").select("id")).toPandas()
    hit = 0
    for q in range(0, len(x), 200):
        dist = ((x - x[q]) ** 2).sum(1)
        dist[q] = np.inf
        hit += len(set(np.argsort(dist)[:10]) & set(got[got["query_id"] == q]["id"]))
    assert hit / 400 >= 0.9
