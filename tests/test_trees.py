import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labquarry.operators import models, trees


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(8)
    out = []
    for k in range(300):
        a, b, c = rnd.randrange(12), rnd.gauss(0, 2), rnd.choice([None, float("nan"), 1.0, 2.0, 3.0])
        y = 3.0 * (a > 5) + (b if b > 0 else -2.0) * (a < 9) + (4.0 if c in (None,) or c != c else c)
        out.append((k, float(a), b, c, 7.0, round(y, 4), "hi" if y > 5 else "lo", "uvw"[(a // 4)] if k % 9 else "u"))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, a double, b double, c double, same double, y double, two string, three string")


FEATURES = ["a", "b", "c", "same"]


def plain_tree(x, g, h, cuts, depth, lam, gamma, mcw, msl):
    """The best splits of one tree by search over all cuts, with missing values on either side."""

    def grow(at, level):
        gs, hs = g[at].sum(), h[at].sum()
        best = None
        for f in range(x.shape[1]):
            v = x[at, f]
            for s, cut in enumerate([*cuts[f], math.inf]):
                for missing_left in (False, True):
                    left = np.where(np.isnan(v), missing_left, v < cut)
                    l, r = at[left], at[~left]
                    if len(l) < msl or len(r) < msl or h[l].sum() < mcw or h[r].sum() < mcw:
                        continue
                    if missing_left and (not np.isnan(v).any() or not (~np.isnan(v) & ~left).any()):
                        continue
                    gain = round(g[l].sum() ** 2 / (h[l].sum() + lam) + g[r].sum() ** 2 / (h[r].sum() + lam) - gs**2 / (hs + lam), 9)
                    if gain > 0 and gain / 2 > gamma and (best is None or gain > best[0] + 1e-9):
                        best = (gain, f, s, missing_left, l, r)
        if level == depth or best is None:
            return {"value": -gs / (hs + lam)}
        return {"f": best[1], "left": grow(best[4], level + 1), "right": grow(best[5], level + 1), "n": len(best[4])}

    return grow(np.arange(len(x)), 0)


def same(tree, k, plain, lr):
    if "value" in plain:
        assert tree.feature[k] == -1 and tree.value[k] == pytest.approx(plain["value"] * lr, abs=1e-7)
        return
    assert tree.feature[k] == plain["f"]
    same(tree, tree.left[k], plain["left"], lr)
    same(tree, tree.right[k], plain["right"], lr)


def test_splits_equal_a_plain_search(table, rows):
    x = np.array([[math.nan if v is None else v for v in r[1:5]] for r in rows])
    y = np.array([r[5] for r in rows])
    cuts = trees.cut_points(table, FEATURES, 16)
    assert cuts[3] == [] and all(c == sorted(set(c)) for c in cuts)
    (found,) = trees.boost(table, "y", FEATURES, rounds=2, max_depth=3, learning_rate=0.5, reg_lambda=1.0, gamma=0.3, min_child_weight=3, cuts=cuts)
    margin = np.full(len(y), y.mean())
    for tree in found.trees:
        same(tree, 0, plain_tree(x, margin - y, np.ones(len(y)), cuts, 3, 1.0, 0.3, 3, 1), 0.5)
        margin += [value(tree, r) for r in x]
    got = {r["id"]: r["p"] for r in table.select("id", found.column().alias("p")).collect()}
    assert [got[k] for k in range(len(y))] == pytest.approx(margin.tolist(), abs=1e-7)
    two = np.array([float(r[6] == "lo") for r in rows])
    (found,) = trees.boost(table, "two", FEATURES, ["hi", "lo"], rounds=1, max_depth=2, learning_rate=1.0, reg_lambda=0.0, min_child_weight=1, min_samples_leaf=20, cuts=cuts)
    p = np.full(len(y), two.mean())
    same(found.trees[0], 0, plain_tree(x, p - two, p * (1 - p), cuts, 2, 0.0, 0.0, 1, 20), 1.0)
    labels = ["u", "v", "w"]
    found = trees.boost(table, "three", FEATURES, labels, rounds=1, max_depth=2, learning_rate=1.0, cuts=cuts)
    for label, e in zip(labels, found):
        own = np.array([float(r[7] == label) for r in rows])
        p = np.full(len(y), own.mean())
        same(e.trees[0], 0, plain_tree(x, p - own, 2 * p * (1 - p), cuts, 2, 1.0, 0.0, 1, 1), 1.0)


def value(tree, x, known=None, k=0):
    """The leaf's value; with known given, turns by other features are averaged by cover."""
    if tree.feature[k] < 0:
        return tree.value[k]
    f = tree.feature[k]
    if known is not None and f not in known:
        return sum(tree.cover[c] * value(tree, x, known, c) for c in (tree.left[k], tree.right[k])) / tree.cover[k]
    left = tree.missing_left[k] if math.isnan(x[f]) else x[f] <= tree.threshold[k]
    return value(tree, x, known, tree.left[k] if left else tree.right[k])


def by_definition(ensemble, x):
    n = len(x)
    out = []
    for i in range(n):
        total = 0.0
        for size in range(n):
            for s in itertools.combinations([j for j in range(n) if j != i], size):
                w = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                total += w * sum(value(t, x, {*s, i}) - value(t, x, set(s)) for t in ensemble.trees)
        out.append(total)
    return out


def explained(model, table, ensemble, rows, prediction, label=None):
    got = {r["id"]: r for r in models.shap_values(model, table.withColumn("p", prediction), label).collect()}
    for r in rows[:25]:
        x = [math.nan if v is None else v for v in r[1:5]]
        own = got[r[0]]
        assert [own[f"shap_{c}"] for c in FEATURES] == pytest.approx(by_definition(ensemble, x), abs=1e-7)
        assert sum(own[f"shap_{c}"] for c in FEATURES) + own["shap_base"] == pytest.approx(own["p"], abs=1e-7)


def test_shapley_values_of_boosting(table, rows):
    model = models.fit_regressor(table, "xgboost", "y", FEATURES, n_estimators=2, max_depth=4)
    explained(model, table, model.ensembles[0], rows, model.ensembles[0].column())
    base = models.shap_values(model, table).select("shap_base").first()[0]
    assert base == pytest.approx(table.select(F.avg(model.ensembles[0].column())).first()[0], abs=1e-6)  # the mean prediction, as every row has cover 1
    model = models.fit_classifier(table, "hist_gradient_boosting", "three", FEATURES, n_estimators=1, max_depth=3)
    explained(model, table, model.ensembles[1], rows, model.ensembles[1].column(), "v")
    summary = {r["feature"]: r["mean_abs"] for r in trees.shap_summary(models.shap_values(model, table, "v"), FEATURES).collect()}
    assert summary["same"] == 0 and summary["a"] == max(summary.values())


def test_shapley_values_of_forests(table, rows):
    whole = table.where("c is not null and not isnan(c)")
    own = [r for r in rows if r[3] is not None and r[3] == r[3]]
    model = models.fit_regressor(whole, "random_forest", "y", FEATURES, n_estimators=3, max_depth=4)
    e = trees.ml_trees(model.pipeline.stages[-1], FEATURES)
    explained(model, whole, e, own, e.column())
    assert model.predict(whole).select(F.max(F.abs(F.col("prediction") - e.column()))).first()[0] < 1e-9
    model = models.fit_classifier(whole, "decision_tree", "two", FEATURES, max_depth=3)
    e = trees.ml_trees(model.pipeline.stages[-1], FEATURES, 1)
    explained(model, whole, e, own, e.column(), "lo")
    assert model.predict(whole).select(F.max(F.abs(F.col("prob_lo") - e.column()))).first()[0] < 1e-9


def test_models_of_boosting(spark, table, tmp_path):
    for kind in models.BOOSTED:
        m = models.fit_classifier(table, kind, "two", FEATURES, n_estimators=3, max_depth=3, learning_rate=0.8)
        assert models.score(m.predict(table), "two", "accuracy") > 0.9 and m.importances["same"] == 0
        assert m.predict(table).where("abs(prob_hi + prob_lo - 1) > 1e-9 or prediction is null").count() == 0  # rows with missing values too
        r = models.fit_regressor(table, kind, "y", FEATURES, n_estimators=3, max_depth=3, learning_rate=0.6)
        assert models.score(r.predict(table), "y", "r2") > 0.8
        models.save_model(r, str(tmp_path / kind), spark)
        back = models.load_model(str(tmp_path / kind), spark)
        assert back.predict(table).select("id", "prediction").exceptAll(r.predict(table).select("id", "prediction")).count() == 0
    sampled = models.fit_regressor(table, "xgboost", "y", FEATURES, n_estimators=1, max_depth=2, subsample=0.5)
    assert sampled.ensembles[0].trees[0].cover[0] < 220
