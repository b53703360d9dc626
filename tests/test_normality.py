import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from labquarry.functions import special
from labquarry.operators import normality

ND = statistics.NormalDist()


def royston(x):
    """The published steps in a plain loop."""
    x, n = sorted(x), len(x)
    m = [ND.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    mm, u = sum(v * v for v in m), 1 / math.sqrt(n)
    a = [0.0] * n
    if n == 3:
        a = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    else:
        outer = [m[-1 - k] / math.sqrt(mm) + sum(c * u**j for j, c in enumerate(normality.OUTER[k])) for k in range(2)][: 1 if n <= 5 else 2]
        k = len(outer)
        phi = (mm - 2 * sum(v * v for v in m[n - k :])) / (1 - 2 * sum(v * v for v in outer))
        a = [v / math.sqrt(phi) for v in m]
        for j, v in enumerate(outer):
            a[n - 1 - j], a[j] = v, -v
    mean = sum(x) / n
    w = sum(p * v for p, v in zip(a, x)) ** 2 / sum((v - mean) ** 2 for v in x)
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    poly = lambda c, t: sum(v * t**j for j, v in enumerate(c))
    if n < 12:
        gamma = poly(normality.SMALL_GAMMA, n)
        z = (-math.log(gamma - math.log(1 - w)) - poly(normality.SMALL_MEAN, n)) / math.exp(poly(normality.SMALL_LOG_SD, n))
    else:
        ln = math.log(n)
        z = (math.log(1 - w) - poly(normality.LARGE_MEAN, ln)) / math.exp(poly(normality.LARGE_LOG_SD, ln))
    return w, 1 - ND.cdf(z)


def test_like_a_plain_loop(spark):
    rnd = random.Random(6)
    groups = {f"n{n}": [rnd.gauss(5, 2) for _ in range(n)] for n in (3, 4, 5, 6, 7, 11, 12, 40, 700)}
    groups |= {"ties": [rnd.randrange(6) / 1.0 for _ in range(90)], "skew": [rnd.expovariate(1) for _ in range(60)], "flat": [2.0] * 9, "two": [1.0, 2.0]}
    groups["weights"] = [148.0, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]  # the first example of Shapiro and Wilk (1965): W = 0.79
    rows = [(g, float(v), "x") for g, own in groups.items() for v in own] + [("n12", None, "x"), (None, 1.0, "x")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, y double, n string").repartition(5)
    got = {r["group"]: r for r in normality.shapiro_wilk(df, "y", "k").collect()}
    assert set(got) == set(groups) - {"flat", "two"}
    for g, r in got.items():
        w, p = royston(groups[g])
        assert r["n"] == len(groups[g]) and r["w"] == pytest.approx(w, abs=1e-10) and r["p"] == pytest.approx(p, abs=1e-7), g
        assert r["is_normal"] == (p > 0.05)
    assert round(got["weights"]["w"], 2) == 0.79 and got["skew"]["p"] < 1e-3
    whole = normality.shapiro_wilk(df.where("k = 'n40'"), "y").first()
    assert whole["group"] == "all" and whole["w"] == pytest.approx(got["n40"]["w"], abs=1e-12)  # sums run in another order
    assert normality.shapiro_wilk(df.limit(0), "y", "k").count() == 0


def test_normal_quantile(spark):
    ps = [1e-300, 1e-20, 1e-9, 0.01, 0.074, 0.076, 0.5, 0.6, 0.93, 0.999999]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", F.expr(special.quantile_normal_sql("p")).alias("x")).collect()
    assert all(r["x"] == pytest.approx(ND.inv_cdf(r["p"]), rel=1e-13, abs=1e-15) for r in got)
