"""Registered queries that take their tables whole."""

import numpy as np

from labquarry.operators import neighbours
from labquarry.plans import registry

SF = "/root/testdata/sf0.001"


def test_joins_take_every_key(spark):
    orders, customers = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("orders", "customer"))
    queries = registry.queries()
    got = {how: queries[f"join_{how}"](spark, SF).toPandas() for how in ("inner", "left", "right", "outer")}
    assert all(set(g["o_orderkey"].dropna()) == {r[0] for r in orders.select("o_orderkey").collect()} for g in got.values())
    keys = {r[0] for r in customers.select("c_custkey").collect()}
    assert set(got["right"]["k"]) == keys and set(got["outer"]["k"]) >= keys
    assert all((g["k"] % 2 == 1).any() and (g["k"] % 3 == 0).any() for g in got.values())


def test_knn_asks_all_rows(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = registry.queries()["knn"](spark, SF).toPandas()
    assert set(got["key"]) == {r[0] for r in v.where("vec_id % 50 = 0").select("vec_id").collect()} and not (got["key"] == got["neighbour"]).any()
    assert got.groupby("key").size().eq(5).all()


def test_knn_in_blocks_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TRAIN_BLOCK", 16)
    monkeypatch.setattr(neighbours, "ROW_BLOCK", 8)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 5))
    x[60:80] = x[3]  # copies: ties go to the smaller key
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)] + [(500, None)], "id long, v array<double>")
    forms = {"euclidean": lambda a: np.sqrt(((x - a) ** 2).sum(1)), "cityblock": lambda a: np.abs(x - a).sum(1), "chebyshev": lambda a: np.abs(x - a).max(1), "cosine": lambda a: 1 - x @ a / np.sqrt((x * x).sum(1) * (a @ a))}
    for metric, form in forms.items():
        got = neighbours.knn(df, df.where("id < 500 and id % 4 = 3"), "id", "id", "v", 4, metric, leave_own=True).toPandas()
        for key in range(3, 120, 4):
            d = np.round(form(x[key]), 9)
            d[key] = np.inf
            own = got[got["key"] == key].sort_values("rank")
            assert own["neighbour"].tolist() == np.lexsort((np.arange(120), d))[:4].tolist() and np.allclose(own["distance"], np.sort(d)[:4], atol=1e-7)


def test_knn_refuses_no_size(spark):
    train = spark.range(200_500).selectExpr("id", "array(double(id)) AS v")
    got = neighbours.knn(train, train.where("id = 200400"), "id", "id", "v", 3).orderBy("rank").collect()
    assert [(r["neighbour"], r["distance"]) for r in got] == [(200400, 0.0), (200399, 1.0), (200401, 1.0)]


def greedy(rows, threshold, best):
    """Clusters one by one: (key, bits) -> {key: head}; best() picks of keys that tie."""
    alike = lambda a, b: len(a | b) and len(a & b) / len(a | b) >= 1 - threshold
    near = {k: {o for o, c in rows.items() if o != k and alike(b, c)} for k, b in rows.items()}
    out = {}
    while len(out) < len(rows):
        sizes = {k: len(near[k] - out.keys()) for k in rows if k not in out}
        head = best(k for k, n in sizes.items() if n == max(sizes.values()))
        out |= {m: head for m in (near[head] | {head}) - out.keys()}
    return out


def test_leader_clusters_like_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ALIKE_BLOCK", 32)
    rng = np.random.default_rng(5)
    bits = [frozenset(np.flatnonzero(rng.random(24) < 0.35).tolist()) for _ in range(90)]
    bits += [bits[k % 7] for k in range(40)] + [frozenset()] * 3  # copies, and rows alike to none
    for kind, name, best in (("long", int, min), ("string", "k{:03}".format, max)):
        rows = {name(k): b for k, b in enumerate(bits)}
        df = spark.createDataFrame([(k, [sum(1 << (23 - i) for i in b)]) for k, b in rows.items()], f"id {kind}, fp array<long>")
        got = {r["id"]: r["cluster"] for r in neighbours.leader_clusters(df, "id", "fp", 24, 0.45).collect()}
        assert got == greedy(rows, 0.45, best)


def test_leader_clusters_of_many_copies(spark):
    df = spark.range(6600).selectExpr("id", "array(IF(id % 3 = 0, 7L, 7L + (id % 500) * 8)) AS fp")
    got = neighbours.leader_clusters(df, "id", "fp", 16, 0.45)
    assert got.count() == 6600 and got.where("id % 3 = 0").select("cluster").distinct().count() == 1
