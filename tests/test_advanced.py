import numpy as np
import pytest

from labquarry.operators import advanced as a
from labquarry.operators import models


def test_curves(spark):
    x = np.array([0.1, 0.3, 1, 3, 10, 30, 100.0])
    rows = [("a", float(v), float(5 + 95 / (1 + (v / 4) ** -1.5))) for v in x] + [("short", 1.0, 1.0)]
    got = {r["parameter"]: r["value"] for r in a.nonlinear_fit(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", "4pl", "g").collect()}
    assert got["ec50"] == pytest.approx(4, rel=1e-4) and got["hill"] == pytest.approx(1.5, rel=1e-4) and got["top"] == pytest.approx(100, rel=1e-4)


def test_rout_and_normality(spark):
    rng = np.random.default_rng(0)
    v = [float(x) for x in rng.normal(10, 1, 200)] + [30.0, -15.0]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(v)] + [(999, None)], "id int, v double")
    out = a.rout(df, "v")
    assert sorted(r["id"] for r in out["removed"].collect()) == [200, 201] and out["kept"].count() == 201
    n = a.normality(df.where("id < 200"), "v").first()
    z = (np.sort(v[:200]) - np.mean(v[:200])) / np.std(v[:200], ddof=1)
    from labquarry.functions.special import normal_sf

    f, i = 1 - normal_sf(z), np.arange(1, 201)
    assert n["ks"] == pytest.approx(max((i / 200 - f).max(), (f - (i - 1) / 200).max())) and n["is_normal"]
    assert n["ad"] == pytest.approx(-200 - ((2 * i - 1) * (np.log(f) + np.log(1 - f[::-1]))).sum() / 200)


def test_two_way(spark):
    rows = [(p, r, float(10 * (p == "x") + 3 * (r == "s") + e)) for p in "xy" for r in "st" for e in (-1, 0, 1)]
    got = {r["term"]: r for r in a.two_way_anova(spark.createDataFrame(rows, "p string, r string, v double"), "p", "r", "v").collect()}
    assert got["p"]["ss"] == pytest.approx(300) and got["r"]["ss"] == pytest.approx(27) and got["p:r"]["ss"] == pytest.approx(0, abs=1e-9)
    assert got["residual"]["df"] == 8 and got["p"]["f"] == pytest.approx(300.0)


def test_permutation_kendall_fisher(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(8)] + [("b", float(x + 20)) for x in range(8)], "g string, v double")
    r = a.permutation_test(df, "v", "g", 500).first()
    assert r["difference"] == -20 and r["p"] < 0.01
    xy = [(1, 2), (2, 1), (3, 3), (4, 4), (4, 5), (5, 5)]
    s = sum(np.sign((p[0] - r[0]) * (p[1] - r[1])) for i, p in enumerate(xy) for r in xy[:i])
    assert a.kendall(spark.createDataFrame(xy, "x int, y int"), "x", "y").first()["tau"] == pytest.approx(s / np.sqrt(14 * 14))
    cells = [("p", "u")] * 8 + [("p", "w")] * 2 + [("q", "u")] * 1 + [("q", "w")] * 5
    f = a.fisher_exact(spark.createDataFrame(cells, "a string, b string"), "a", "b").first()
    assert f["odds_ratio"] == 20 and f["p"] == pytest.approx(0.03496503, abs=1e-7)
    assert a.rank_biserial(df, "v", "g").first()["r"] == 1


def test_distributions(spark):
    rng = np.random.default_rng(1)
    x = rng.exponential(3.0, 500)
    got = a.distribution_fits(spark.createDataFrame([(float(v),) for v in x], "v double"), "v").collect()
    assert got[0]["distribution"] == "exponential" and got[0]["log_likelihood"] == pytest.approx(-500 * (np.log(x.mean()) + 1))


@pytest.mark.parametrize("linkage", ["ward", "complete", "average", "single"])
def test_agglomerative(spark, linkage):
    rows = [(k, float(x), 0.0) for k, x in enumerate([0, 0.1, 0.2, 5, 5.1, 9, 9.2, 9.1])]
    got = {r["id"]: r["cluster"] for r in a.agglomerative(spark.createDataFrame(rows, "id int, x double, y double"), "id", ["x", "y"], 3, linkage).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: 2, 7: 2}


def test_boosting_and_learning(spark):
    rng = np.random.default_rng(2)
    x = rng.random((300, 2))
    rows = [(k, *map(float, r), "in" if 0.3 < r[0] < 0.7 else "out") for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c string").cache()
    model = a.adaboost(df, "c", ["a", "b"], 6)
    assert model.predict(df).where("prediction = c").count() > 285
    curve = a.learning_curve(df, lambda d: models.fit_classifier(d, "qda", "c", ["a", "b"]), "c", ["id"], shares=(0.5, 1.0)).collect()
    assert len(curve) == 2 and all(0.5 < r["test_score"] <= 1 for r in curve)
