import numpy as np
import pytest
from pyspark.sql import functions as F

from labquarry.operators import models as m


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = 2 * x[:, 0] - x[:, 1] + 0.5 + 0.01 * rng.normal(size=300)
    c = np.where(x[:, 0] + x[:, 1] > 0, "yes", "no")
    rows = [(k, *map(float, r), float(v), str(u)) for k, (r, v, u) in enumerate(zip(x, y, c, strict=True))] + [(900, None, 1.0, 1.0, 1.0, "yes")]
    return spark.createDataFrame(rows, "id int, a double, b double, d double, y double, c string").cache()


@pytest.mark.parametrize("kind", ["logistic_regression", "naive_bayes", "lda", "qda", "ridge", "decision_tree"])
def test_classifiers(data, kind):
    model = m.fit_classifier(data, kind, "c", ["a", "b", "d"])
    out = model.predict(data.where("id < 900"))
    assert out.where("prediction = c").count() / 300 > 0.85
    if kind in ("naive_bayes", "lda", "qda", "logistic_regression"):
        assert out.where("abs(prob_yes + prob_no - 1) > 1e-9").count() == 0


@pytest.mark.parametrize("kind", ["linear", "ridge", "bayesian_ridge", "lasso"])
def test_regressors(data, kind):
    model = m.fit_regressor(data, kind, "y", ["a", "b", "d"], alpha=0.001)
    assert model.linear["a"] == pytest.approx(2, abs=0.02) and model.linear["intercept"] == pytest.approx(0.5, abs=0.02)
    assert m.score(model.predict(data.where("id < 900")), "y", "r2") > 0.999


def test_contributions_add_up(data):
    model = m.fit_regressor(data, "linear", "y", ["a", "b", "d"])
    out = m.linear_contributions(model, model.predict(data.where("id < 900")))
    assert out.where(F.abs(F.col("shap_base") + F.col("shap_a") + F.col("shap_b") + F.col("shap_d") - F.col("prediction")) > 1e-9).count() == 0


def test_validation_and_grid(data):
    rows = data.where("id < 900")
    cv = {r["fold"]: r["score"] for r in m.cross_validate(rows, lambda d: m.fit_classifier(d, "lda", "c", ["a", "b"]), "c", ["id"], 3).collect()}
    assert set(cv) == {"1", "2", "3", "mean", "std"} and cv["mean"] > 0.85
    best, table = m.grid_search(rows, "regression", "ridge", "y", ["id"], {"alpha": [0.01, 1000.0]}, ["a", "b"], 3)
    assert table.where("rank = 1").first()["params"] == '{"alpha": 0.01}' and best.linear["a"] == pytest.approx(2, abs=0.05)


def test_pca_kmeans_save(spark, data, tmp_path):
    out = m.pca(data, ["a", "b", "d"], 2)
    v = out["variance"].collect()
    assert len(v) == 2 and v[0]["eigenvalue"] >= v[1]["eigenvalue"]
    assert out["transformed"].agg(F.var_samp("pc1")).first()[0] == pytest.approx(v[0]["eigenvalue"], rel=1e-9)
    clustered, _ = m.k_means(data, ["a", "b"], 2)
    assert {r[0] for r in clustered.where("id < 900").select("cluster").distinct().collect()} == {0, 1}
    model = m.fit_classifier(data, "decision_tree", "c", ["a", "b"])
    m.save_model(model, str(tmp_path), spark)
    again = m.load_model(str(tmp_path), spark)
    a, b = (x.predict(data.where("id < 900")).select("id", "prediction") for x in (model, again))
    assert a.exceptAll(b).count() == 0 and again.labels == ["no", "yes"]
