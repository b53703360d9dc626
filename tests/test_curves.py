import math
import random

import numpy as np
import pytest

from labquarry.functions import special
from labquarry.operators import curves

# For each curve, true parameters and the same curve in numpy.
TRUE = {
    "4pl": ([1.0, 9.0, 12.0, 1.6], lambda x, b, t, e, h: b + (t - b) / (1 + (x / e) ** -h)),
    "hill": ([8.0, 11.0, 2.0], lambda x, v, k, n: v * x**n / (k**n + x**n)),
    "one_phase_decay": ([9.0, 2.0, 0.12], lambda x, a, p, k: (a - p) * np.exp(-k * x) + p),
    "two_phase_decay": ([5.0, 0.6, 4.0, 0.05, 1.0], lambda x, a, k, b, m, p: a * np.exp(-k * x) + b * np.exp(-m * x) + p),
    "exponential_growth": ([2.0, 0.06], lambda x, a, k: a * np.exp(k * x)),
    "michaelis_menten": ([10.0, 9.0], lambda x, v, k: v * x / (k + x)),
    "gompertz": ([9.0, 3.0, 0.15], lambda x, a, b, c: a * np.exp(-b * np.exp(-c * x))),
    "sigmoid": ([9.0, 20.0, 0.25], lambda x, a, m, k: a / (1 + np.exp(-k * (x - m)))),
}


def plain_fit(f, x, y, p):
    """Gauss-Newton with damping over all rows; parameters, covariances and the sum of squares."""
    p, damping = np.array(p, float), 1e-3

    def told(p):
        j = np.stack([(f(x, *(p + e)) - f(x, *(p - e))) / (2 * e.max()) for e in np.diag(np.maximum(np.abs(p), 1e-4) * 1e-5)], 1)
        return y - f(x, *p), j

    r, j = told(p)
    for _ in range(300):
        a = j.T @ j
        d = np.linalg.solve(a + damping * np.diag(np.diag(a)), j.T @ r)
        r2, j2 = told(p + d)
        if np.isfinite(r2).all() and r2 @ r2 < r @ r:
            p, r, j, damping = p + d, r2, j2, damping / 5
        else:
            damping *= 4
    return p, np.linalg.inv(j.T @ j) * (r @ r) / (len(x) - len(p)), r @ r


@pytest.mark.parametrize("model", ["4pl", "two_phase_decay", "michaelis_menten"])  # all eight are fitted by queries
def test_like_a_plain_fit(spark, model):
    p, f = TRUE[model]
    rnd = random.Random(len(model))
    rows = [(g, x / 2, float(f(x / 2, *[v * (1 + 0.1 * k) for v in p])) + rnd.gauss(0, 0.05), "z") for k, g in enumerate(["a", "b"]) for x in range(1, 101) for _ in range(1 + x % 2)]
    df = spark.createDataFrame([*rows, ("few", 1.0, 2.0, "z"), (None, 1.0, 2.0, "z"), ("a", None, 1.0, "z")], "w string, x double, y double, n string")
    fits = curves.fit_curves(df, "x", "y", model, "w")
    table = curves.parameters(fits, model).collect()
    band = curves.curve_band(fits, model, 2.0, 40.0, 5).collect()
    assert {r["group"] for r in table} == {"a", "b"}
    for k, g in enumerate(["a", "b"]):
        x, y = (np.array([r[i] for r in rows if r[0] == g]) for i in (1, 2))
        want, cov, sse = plain_fit(f, x, y, [v * (1 + 0.1 * k) for v in p])
        own = {r["parameter"]: r for r in table if r["group"] == g}
        names = curves.CURVES[model].names
        assert [own[c]["value"] for c in names] == pytest.approx(want.tolist(), rel=2e-4)
        assert [own[c]["std_error"] for c in names] == pytest.approx(np.sqrt(np.diag(cov)).tolist(), rel=2e-3)
        n, t = len(x), special.t_quantile(0.975, len(x) - len(p))
        one = own[names[0]]
        assert one["n"] == n and one["rmse"] == pytest.approx(math.sqrt(sse / n), rel=1e-5) and one["r_squared"] == pytest.approx(1 - sse / ((y - y.mean()) ** 2).sum(), abs=1e-7)
        like = -0.5 * n * (math.log(2 * math.pi * sse / n) + 1)
        assert one["aic"] == pytest.approx(2 * len(p) - 2 * like, abs=1e-4) and one["bic"] == pytest.approx(len(p) * math.log(n) - 2 * like, abs=1e-4)
        assert one["ci_high"] - one["value"] == pytest.approx(t * one["std_error"], rel=1e-6)
        for r in (r for r in band if r["group"] == g):
            grad = np.array([(f(r["x"], *(want + e)) - f(r["x"], *(want - e))) / (2 * e.max()) for e in np.diag(np.maximum(np.abs(want), 1e-4) * 1e-5)])
            assert r["fit"] == pytest.approx(float(f(r["x"], *want)), rel=1e-3)
            assert r["ci_high"] - r["fit"] == pytest.approx(t * math.sqrt(grad @ cov @ grad), rel=1e-2)


@pytest.mark.parametrize("model", ["hill", "gompertz"])
def test_predictions_and_their_inverse(spark, model):
    p, f = TRUE[model]
    df = spark.createDataFrame([(float(x), float(f(float(x), *p))) for x in range(1, 41)], "x double, y double")
    fits = curves.fit_curves(df, "x", "y", model)
    got = curves.inverse_predict(curves.predict(df, fits, model, "x"), fits, model, "y").collect()
    assert all(r["prediction"] == pytest.approx(r["y"], rel=1e-5) and r["x_of_y"] == pytest.approx(r["x"], rel=1e-3) for r in got if 2 < r["x"] < 35)
    beyond = spark.createDataFrame([(1e9,)], "y double")
    if model not in ("exponential_growth", "one_phase_decay"):
        assert curves.inverse_predict(beyond, fits, model, "y").first()["x_of_y"] is None


def test_refusals(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    with pytest.raises(curves.OperatorError):
        curves.fit_curves(df, "x", "y", "line")
    assert curves.nonlinear_fit(df, "x", "y").count() == 0 and curves.nonlinear_fit(df.limit(0), "x", "y").count() == 0
    assert curves.curve("michaelis_menten", {"vmax": 2.0, "km": 1.0}, 0, 3, 4, spark).collect()[3]["y"] == 1.5
