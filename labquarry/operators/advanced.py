"""Fits and tests that need more than aggregates: each group is fitted in one task, groups run in parallel.

Where a fit works on a group's values, the group has to fit in a task's memory; group by a column that bounds it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import special
from .curves import CURVES, curve, nonlinear_fit  # noqa: F401
from .models import Model, _scored, score
from .running import percentiles
from .statistics import _known, mann_whitney
from .tabular import OperatorError, as_text, q

# Outliers and normality


def rout(df: DataFrame, value: str, group: str | None = None, share: float = 0.01) -> dict[str, DataFrame]:
    """kept and removed: values too far from their group's median, by robust spread and a false discovery rate.

    The spread is the larger of 1.4826 times the median deviation and the 68.27th percentile of the deviations, scaled
    for the group's size; p-values are of Student's t. Missing values are kept. The p-values are ranked by distinct value.
    """
    rows = df.withColumn("_g", as_text(q(group)) if group else F.lit("all")).withColumn("_v", q(value).cast("double"))
    known = rows.where("_v is not null and not isnan(_v)").groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("c"))
    values = rows.where("_v is not null and not isnan(_v)")
    mid = values.groupBy("_g").agg(F.median("_v").alias("m"), F.count(F.lit(1)).alias("n"))
    away = values.join(mid, "_g").withColumn("a", F.abs(F.col("_v") - F.col("m")))
    spread = away.groupBy("_g").agg(F.first("m").alias("m"), F.first("n").cast("double").alias("n"), F.median("a").alias("mad"), F.percentile("a", 0.6827).alias("p68"))
    spread = spread.withColumn("rs", F.greatest(1.4826 * F.col("mad"), F.col("p68") * F.sqrt(F.try_divide("n", F.col("n") - 1))))
    cells = known.join(spread, "_g").withColumn("t", F.try_divide(F.abs(F.col("_v") - F.col("m")), F.col("rs")))
    cells = cells.withColumn("p", special.p_t(F.col("t"), F.col("n") - 1))
    upto = Window.partitionBy("_g").orderBy("p")
    cells = cells.withColumn("i", F.sum("c").over(upto))
    passing = F.max(F.when(F.col("p") <= share * F.col("i") / F.col("n"), F.col("p"))).over(Window.partitionBy("_g"))
    cells = cells.withColumn("out", F.coalesce(F.col("p") <= passing, F.lit(False))).where("out").select(F.col("_g").alias("_og"), F.col("_v").alias("_ov"))
    on = (F.col("_g") == F.col("_og")) & (F.col("_v") == F.col("_ov"))
    clean = lambda d: d.select(*(q(c) for c in df.columns))
    return {"kept": clean(rows.join(cells, on, "left_anti")), "removed": clean(rows.join(cells, on, "left_semi"))}


def normality(df: DataFrame, value: str, group: str | None = None, alpha: float = 0.05) -> DataFrame:
    """(group, n, mean, std, ks, ks_p, ad, is_normal): distances of the values from the normal curve of their mean and deviation.

    ks_p is of the limiting distribution; ad is Anderson and Darling's statistic, judged by its critical value at 5 %.
    """
    k = _known(df, value, group) if group else _known(df, value).withColumn("g", F.lit("all"))
    m = k.groupBy("g").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")).where("std > 0")
    c = k.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c")).join(m, "g")
    c = c.withColumn("i", F.sum("c").over(Window.partitionBy("g").orderBy("v")))
    z = (F.col("v") - F.col("mean")) / F.col("std")
    cdf = special._column(lambda x: 1 - special.normal_sf(x), z)
    c = c.withColumn("f", cdf).withColumn("f", F.least(F.greatest("f", F.lit(1e-16)), F.lit(1 - 1e-16)))
    gap = F.greatest(F.col("i") / F.col("n") - F.col("f"), F.col("f") - (F.col("i") - F.col("c")) / F.col("n"))
    # The places of equal values, summed: (2k - 1) over k from i - c + 1 to i.
    up = (F.col("i") ** 2 - (F.col("i") - F.col("c")) ** 2).cast("double")
    terms = up * F.log("f") + (2 * F.col("n") * F.col("c") - up) * F.log(1 - F.col("f"))
    s = c.withColumns({"gap": gap, "terms": terms}).groupBy("g").agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.first("std").alias("std"), F.max("gap").alias("ks"), (-F.first("n") - F.sum("terms") / F.first("n")).alias("ad"))
    s = s.withColumn("ks_p", special.p_kolmogorov(F.col("ks") * F.sqrt("n")))
    corrected = F.col("ad") * (1 + 0.75 / F.col("n") + 2.25 / F.col("n") ** 2)
    return s.select(F.col("g").alias("group"), F.col("n").cast("long").alias("n"), "mean", "std", "ks", "ks_p", "ad", ((F.col("ks_p") > alpha) & (corrected < 0.752)).alias("is_normal"))


# Layouts


def two_way_anova(df: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """(term, ss, df, f, p) of two factors and their interaction, by sums of squares of nested models (type II).

    The rows are reduced to a table of cells; only that is solved on the driver.
    """
    k = df.where(q(first).isNotNull() & q(second).isNotNull() & q(value).isNotNull())
    cells = k.groupBy(as_text(q(first)).alias("a"), as_text(q(second)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.avg(q(value)).alias("m"), F.var_pop(q(value)).alias("v")).limit(100_001).toPandas()
    if len(cells) > 100_000:
        raise OperatorError("more than 100,000 cells")
    n, m = cells["n"].to_numpy(float), cells["m"].to_numpy(float)
    within = float((n * cells["v"].to_numpy(float)).sum())
    a = pd.get_dummies(cells["a"]).to_numpy(float)
    b = pd.get_dummies(cells["b"]).to_numpy(float)
    both = np.eye(len(cells))

    def sse(*parts: np.ndarray) -> tuple[float, int]:
        x = np.hstack([np.ones((len(cells), 1)), *parts]) * np.sqrt(n)[:, None]
        y = m * np.sqrt(n)
        beta, _, rank, _ = np.linalg.lstsq(x, y, rcond=None)
        r = y - x @ beta
        return float(r @ r) + within, int(rank)

    (s_a, r_a), (s_b, r_b), (s_ab, r_ab), (s_full, r_full) = sse(a), sse(b), sse(a, b), sse(both)
    free = n.sum() - r_full
    ms = s_full / free if free > 0 else np.nan
    rows = []
    for term, ss, d in ((first, s_b - s_ab, r_ab - r_b), (second, s_a - s_ab, r_ab - r_a), (f"{first}:{second}", s_ab - s_full, r_full - r_ab)):
        f = ss / d / ms if d and ms else np.nan
        p = float(special.f_sf(f, d, free)) if f == f else np.nan
        rows.append((term, float(ss), int(d), None if f != f else float(f), None if p != p else p))
    rows.append(("residual", s_full, int(free), None, None))
    return df.sparkSession.createDataFrame(rows, "term string, ss double, df long, f double, p double")


def permutation_test(df: DataFrame, value: str, group: str, permutations: int = 1000, seed: int = 42) -> DataFrame:
    """(group1, group2, difference, p): share of random relabellings whose means differ at least as much, both ways counted.

    A group's values go to one task for each pair; relabellings are drawn there by the seed.
    """
    k = _known(df, value, group)
    groups = k.select("g").distinct()
    pairs = groups.select(F.col("g").alias("g1")).join(groups.select(F.col("g").alias("g2")), F.col("g1") < F.col("g2"))
    both = k.join(pairs, (F.col("g") == F.col("g1")) | (F.col("g") == F.col("g2")))

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        first = (pdf["g"] == pdf["g1"]).to_numpy()
        order = np.lexsort((first, pdf["v"].to_numpy()))
        v, first = pdf["v"].to_numpy()[order], first[order]
        rng = np.random.default_rng(seed)
        n, total = int(first.sum()), v.sum()
        seen = v[first].mean() - v[~first].mean()
        hits = 0
        for _ in range(permutations):
            s = v[rng.permutation(len(v))[:n]].sum()
            hits += abs(s / n - (total - s) / (len(v) - n)) >= abs(seen) - 1e-12
        return pd.DataFrame({"group1": [pdf["g1"].iloc[0]], "group2": [pdf["g2"].iloc[0]], "difference": [seen], "p": [(hits + 1) / (permutations + 1)]})

    return both.groupBy("g1", "g2").applyInPandas(test, "group1 string, group2 string, difference double, p double")


def rank_biserial(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group1, group2, r): 1 - 2U / (n1 n2) of each pair."""
    u = mann_whitney(df, value, group)
    return u.select("group1", "group2", (1 - 2 * F.col("u") / (F.col("n1") * F.col("n2"))).alias("r"))


def distribution_fits(df: DataFrame, value: str) -> DataFrame:
    """(distribution, log_likelihood, parameters, aic, bic), best first, of families whose likeliest parameters are closed forms."""
    k = _known(df, value)
    x = F.col("v")
    positive = F.min("v") > 0
    s = k.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("s2"), F.min(x).alias("a"), F.max(x).alias("b"), F.avg(F.log(F.when(x > 0, x))).alias("lm"), F.var_pop(F.log(F.when(x > 0, x))).alias("l2"), F.avg(x * x).alias("q"), positive.alias("positive"))
    med = k.crossJoin(F.broadcast(percentiles(k, "v", [0.5]).withColumnRenamed("p0", "med"))).agg(F.avg(F.abs(x - F.col("med"))).alias("laplace"))  # one row
    s = s.crossJoin(F.broadcast(med))
    n = F.col("n")
    log = F.log
    forms = {
        "normal": (2, -n / 2 * (log(F.lit(2 * math.pi) * F.col("s2")) + 1), F.lit(True)),
        "lognormal": (2, -n / 2 * (log(F.lit(2 * math.pi) * F.col("l2")) + 1) - n * F.col("lm"), F.col("positive")),
        "exponential": (1, -n * (log("m") + 1), F.col("a") >= 0),
        "uniform": (2, -n * log(F.col("b") - F.col("a")), F.lit(True)),
        "rayleigh": (1, n * (F.col("lm") - log(F.col("q") / 2) - 1), F.col("positive")),
        "laplace": (2, -n * (log(2 * F.col("laplace")) + 1), F.lit(True)),
        "pareto": (2, n * (log(1 / (F.col("lm") - log("a"))) + log("a") / (F.col("lm") - log("a"))) - n * (1 / (F.col("lm") - log("a")) + 1) * F.col("lm"), F.col("positive")),
    }
    rows = F.array(*(F.struct(F.lit(name).alias("distribution"), F.when(ok, ll).alias("log_likelihood"), F.lit(p).alias("parameters")) for name, (p, ll, ok) in forms.items()))
    out = s.select("n", F.explode(rows).alias("x")).select("n", "x.*").where("log_likelihood is not null")
    return out.withColumns({"aic": 2 * F.col("parameters") - 2 * F.col("log_likelihood"), "bic": F.col("parameters") * F.log("n") - 2 * F.col("log_likelihood")}).drop("n").orderBy("aic")


# Clusters and validation


def agglomerative(df: DataFrame, key: str, columns: list[str], n_clusters: int = 3, linkage: str = "ward", most: int = 5000) -> DataFrame:
    """df with cluster, from 0 by smallest key: the closest two clusters merge until n_clusters are left.

    All distances are held at once, so the number of rows is checked; it may be `most` at most.
    """
    rows = df.select(q(key).alias("k"), *(q(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns))).dropna().orderBy("k").limit(most + 1).toPandas()
    if len(rows) > most:
        raise OperatorError(f"more than {most} rows")
    x = rows.drop(columns="k").to_numpy(float)
    n = len(x)
    d = ((x[:, None] - x[None]) ** 2).sum(2) if n else np.zeros((0, 0))
    d = d if linkage == "ward" else np.sqrt(d)
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(n), np.arange(n)
    for _ in range(max(0, n - n_clusters)):
        i, j = divmod(int(np.argmin(d)), n)
        i, j = min(i, j), max(i, j)
        a, b = d[i], d[j]
        if linkage == "single":
            new = np.minimum(a, b)
        elif linkage == "complete":
            new = np.where(np.isinf(a) | np.isinf(b), np.inf, np.maximum(a, b))
        elif linkage == "average":
            new = (size[i] * a + size[j] * b) / (size[i] + size[j])
        else:
            new = ((size[i] + size) * a + (size[j] + size) * b - size * d[i, j]) / (size[i] + size[j] + size)
        d[i], d[:, i], d[j], d[:, j] = new, new, np.inf, np.inf
        d[i, i] = np.inf
        size[i] += size[j]
        label[label == j] = i
    _, names = np.unique(label, return_inverse=True)
    kind = dict(df.dtypes)[key]
    table = df.sparkSession.createDataFrame([(k, int(c)) for k, c in zip(rows["k"].tolist(), names.tolist(), strict=True)], f"_k {kind}, _c int")
    return df.drop("cluster").join(F.broadcast(table), q(key) == F.col("_k"), "left").withColumnRenamed("_c", "cluster").drop("_k")


def learning_curve(df: DataFrame, fit: Callable[[DataFrame], Model], target: str, key: list[str], scoring: str = "accuracy", shares: tuple[float, ...] = (0.25, 0.5, 1.0), seed: int = 42) -> DataFrame:
    """(share, train_score, test_score): a fifth of the rows tests models fitted on growing shares of the others."""
    draw = F.pmod(F.xxhash64(F.lit(seed), *(as_text(q(c)) for c in key)), F.lit(1000))
    marked = df.withColumn("_d", draw)
    test, rest = marked.where("_d < 200").drop("_d"), marked.where("_d >= 200")
    rows = []
    for share in shares:
        train = rest.where(F.col("_d") < 200 + 800 * share).drop("_d")
        model = fit(train)
        rows.append((float(share), score(model.predict(train), target, scoring), score(model.predict(test), target, scoring)))
    return df.sparkSession.createDataFrame(rows, "share double, train_score double, test_score double")


def adaboost(df: DataFrame, target: str, features: list[str], rounds: int = 10) -> Model:
    """Boosted stumps (SAMME). Each round finds the best cut of each feature from quantile bins in one aggregate."""
    labels = sorted(r[0] for r in df.select(as_text(q(target))).distinct().limit(1001).collect())
    bins = 32
    cuts = df.agg(*(F.percentile_approx(q(c).cast("double"), [k / bins for k in range(1, bins)], 10_000).alias(c) for c in features)).first()
    y = as_text(q(target))
    scores = {x: F.lit(0.0) for x in labels}
    k = len(labels)
    for _ in range(rounds):
        own = reduce(lambda a, b: a + b, [F.when(y == x, s).otherwise(F.lit(0.0)) for x, s in scores.items()])
        mean = reduce(lambda a, b: a + b, scores.values()) / k
        weighted = df.withColumn("_w", F.exp(-(own - mean))).withColumn("_y", y)
        sides = F.array(*(F.struct(F.lit(c).alias("c"), F.lit(float(v)).alias("v"), (q(c) <= float(v)).alias("low")) for c in features for v in sorted(set(cuts[c]))))
        table = weighted.select("_w", "_y", F.explode(sides).alias("s")).groupBy("s.c", "s.v", "s.low", "_y").agg(F.sum("_w").alias("w")).toPandas()  # cuts times labels
        choice = None
        for (c, v), part in table.groupby(["c", "v"]):
            side = {bool(low): p.sort_values(["w", "_y"], ascending=[False, True]).iloc[0] for low, p in part.groupby("low")}
            right = sum(s["w"] for s in side.values())
            error = 1 - right / part["w"].sum()
            if choice is None or error < choice[0] - 1e-12:
                choice = (error, c, v, {low: s["_y"] for low, s in side.items()})
        if choice is None or choice[0] >= 1 - 1 / k:
            break
        error, c, v, picked = choice
        alpha = math.log((1 - error) / max(error, 1e-10)) + math.log(max(k - 1, 1))
        vote = F.when(q(c) <= float(v), F.lit(picked.get(True))).otherwise(F.lit(picked.get(False)))
        scores = {x: s + F.when(vote == x, F.lit(alpha)).otherwise(F.lit(0.0)) for x, s in scores.items()}
        if error < 1e-10:
            break
    return Model("classification", features, target, _scored(scores, True), labels)


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n and tau-b of two columns, from pairs of distinct values, counted."""
    k = df.where(q(a).isNotNull() & q(b).isNotNull()).groupBy(q(a).cast("double").alias("x"), q(b).cast("double").alias("y")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    other = k.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("c").alias("c2"))
    s = k.join(other, F.col("x") < F.col("x2")).agg(F.sum(F.col("c") * F.col("c2") * F.signum(F.col("y2") - F.col("y"))).alias("s"))
    n = k.agg(F.sum("c").alias("n"))
    ties = lambda c: k.groupBy(c).agg(F.sum("c").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(f"t_{c}"))
    out = s.crossJoin(n).crossJoin(ties("x")).crossJoin(ties("y"))  # one row each
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return out.select(F.col("n").cast("long").alias("n"), F.try_divide(F.coalesce("s", F.lit(0.0)), F.sqrt((pairs - F.col("t_x")) * (pairs - F.col("t_y")))).alias("tau"))


def fisher_exact(df: DataFrame, first: str, second: str) -> DataFrame:
    """One row: odds_ratio and two-sided p of a table of two by two."""
    k = df.where(q(first).isNotNull() & q(second).isNotNull()).groupBy(as_text(q(first)).alias("a"), as_text(q(second)).alias("b")).agg(F.count(F.lit(1)).alias("n")).limit(5).collect()
    rows, cols = sorted({r["a"] for r in k}), sorted({r["b"] for r in k})
    if len(rows) != 2 or len(cols) != 2:
        raise OperatorError("a table of two by two is needed")
    n = {(r["a"], r["b"]): r["n"] for r in k}
    a, b, c, d = (n.get((x, y), 0) for x in rows for y in cols)
    total, row, col = a + b + c + d, a + b, a + c
    lg = math.lgamma

    def prob(x: int) -> float:
        return math.exp(lg(row + 1) + lg(total - row + 1) + lg(col + 1) + lg(total - col + 1) - lg(total + 1) - lg(x + 1) - lg(row - x + 1) - lg(col - x + 1) - lg(total - row - col + x + 1))

    at = prob(a)
    low, high = max(0, row + col - total), min(row, col)
    # Terms far from the mean vanish; all are summed, for there are at most as many as the smaller margin.
    p = min(1.0, sum(v for x in range(low, high + 1) if (v := prob(x)) <= at * (1 + 1e-7)))
    return df.sparkSession.createDataFrame([(a * d / (b * c) if b * c else float("inf"), p)], "odds_ratio double, p double")

