"""Linear mixed models with a random intercept, and if asked for a random slope, for each group."""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..storage import drop_stored, stored
from .tabular import OperatorError, q


def _profile(sizes: np.ndarray, counts: np.ndarray, inner: np.ndarray, outer: np.ndarray, ratio: float, reml: bool) -> tuple:
    """(log likelihood, coefficients, inverse of X'V^-1X, residual variance) at a ratio of the two variances.

    inner: sums of products over rows, outer: sums over groups of products of group sums; both by group size.
    """
    n = float(sizes @ counts)
    s = (inner - (ratio / (1 + ratio * sizes))[:, None, None] * outer).sum(0)
    return _likelihood(s, counts @ np.log1p(ratio * sizes), n, reml)


def _likelihood(s: np.ndarray, log_det: float, n: float, reml: bool) -> tuple:
    """As _profile, from s, the products [X y]'V^-1[X y], and the logarithm of the determinant of V."""
    p = len(s) - 1
    inverse = np.linalg.pinv(s[:-1, :-1])
    beta = inverse @ s[:-1, -1]
    rest = max(float(s[-1, -1] - s[:-1, -1] @ beta), 1e-300)
    free = n - p if reml else n
    value = free * np.log(2 * np.pi * rest / free) + free + log_det
    if reml:
        value += np.linalg.slogdet(s[:-1, :-1])[1]
    return -value / 2, beta, inverse, rest / free


def _fixed(spark, xs: list[str], means: list[float], beta: np.ndarray, inverse: np.ndarray, variance: float, ci_level: float) -> DataFrame:
    """The fixed effects of columns that were shifted by their means (the target's last), for the columns as given."""
    back = np.eye(len(beta))  # only the intercept changes
    back[0, 1:] = -np.array(means[:-1], float)
    coefficients = back @ beta
    coefficients[0] += means[-1]
    error = np.sqrt(np.maximum(0, np.diag(back @ inverse @ back.T)) * variance)
    with np.errstate(all="ignore"):
        z = coefficients / error
    width = special.normal_quantile((1 + ci_level) / 2)
    rows = [(name, *map(float, r)) for name, *r in zip(["Intercept", *xs], coefficients, error, z, 2 * special.normal_sf(np.abs(z)), coefficients - width * error, coefficients + width * error, strict=True)]
    return spark.createDataFrame(rows, "parameter string, coefficient double, std_error double, z double, p double, ci_low double, ci_high double")


def mixed_effects(df: DataFrame, y: str, xs: list[str], group: str, reml: bool = True, ci_level: float = 0.95, slope: str | None = None) -> dict[str, DataFrame]:
    """fixed_effects (parameter, coefficient, std_error, z, p, ci_low, ci_high), random_effects (group, intercept) and
    summary (n_obs, n_groups, log_likelihood, aic, bic, var_random_intercept, var_residual, icc, method).

    Rows with a null among the columns are left out. A group enters the likelihood through its size and its sums alone,
    and groups of one size through the sums over them: rows are reduced to groups, groups to sizes, and only one row
    for each different size reaches the driver, at most the root of twice the number of rows. There the ratio of the
    two variances is searched on a grid, then by golden section. Columns are shifted by their means first.

    With a slope, a column whose effect varies by group too, random_effects has slope beside intercept, and summary
    var_random_slope and cov_random beside var_random_intercept; see _with_slope. The column need not be among xs.
    """
    if not xs:
        raise OperatorError("a mixed model needs a fixed effect")
    if slope is not None:
        return _with_slope(df, y, xs, group, reml, ci_level, slope)
    columns = [*xs, y]
    known = df.where(reduce(lambda a, b: a & b, [q(c).isNotNull() & ~F.isnan(q(c).cast("double")) for c in columns]) & q(group).isNotNull())
    means = known.agg(*(F.avg(q(c).cast("double")) for c in columns)).first()
    if means[0] is None:
        raise OperatorError("no row has all columns")
    v = [F.lit(1.0), *(q(c).cast("double") - F.lit(float(m)) for c, m in zip(columns, means, strict=True))]
    m = len(v)
    cells = [(i, j) for i in range(m) for j in range(i, m)]
    groups = known.groupBy(q(group).alias("group")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(v[i]).alias(f"s{i}") for i in range(m)), *(F.sum(v[i] * v[j]).alias(f"p{i}_{j}") for i, j in cells))
    by = groups.groupBy("n").agg(F.count(F.lit(1)).alias("m"), *(F.sum(f"p{i}_{j}") for i, j in cells), *(F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i, j in cells))
    rows = sorted(by.collect())  # one a group size
    table = np.array([list(r) for r in rows], float)
    sizes, counts = table[:, 0], table[:, 1]
    inner, outer = np.zeros((2, len(rows), m, m))
    for k, (i, j) in enumerate(cells):
        inner[:, i, j] = inner[:, j, i] = table[:, 2 + k]
        outer[:, i, j] = outer[:, j, i] = table[:, 2 + len(cells) + k]

    def at(power):
        return _profile(sizes, counts, inner, outer, 10.0**power, reml)[0]

    grid = np.linspace(-8, 8, 129)
    best = int(np.argmax([at(x) for x in grid]))
    low, high = grid[max(0, best - 1)], grid[min(len(grid) - 1, best + 1)]
    golden = (5**0.5 - 1) / 2
    for _ in range(80):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if at(a) >= at(b) else (a, high)
    ratio = 10.0 ** ((low + high) / 2)
    if _profile(sizes, counts, inner, outer, 0.0, reml)[0] >= at((low + high) / 2):
        ratio = 0.0
    likelihood, beta, inverse, variance = _profile(sizes, counts, inner, outer, ratio, reml)

    n, p = int(sizes @ counts), m - 1
    spark = df.sparkSession
    random, terms = ratio * variance, p + 1
    gap = F.col(f"s{p}") - reduce(lambda a, b: a + b, [F.col(f"s{i}") * float(beta[i]) for i in range(p)])
    summary = (n, int(counts.sum()), float(likelihood), float(-2 * likelihood + 2 * terms), float(-2 * likelihood + np.log(n) * terms), float(random), float(variance), float(random / (random + variance)), "REML" if reml else "ML")
    return {
        "fixed_effects": _fixed(spark, xs, list(means), beta, inverse, variance, ci_level),
        "random_effects": groups.select("group", (gap * (ratio / (1 + ratio * F.col("n")))).alias("intercept")),
        "summary": spark.createDataFrame([summary], "n_obs long, n_groups long, log_likelihood double, aic double, bic double, var_random_intercept double, var_residual double, icc double, method string"),
    }


def _inside(p: tuple) -> tuple[Column, Column, Column, Column]:
    """(determinant, m11, m12, m22) of I + Psi A and of M = (I + Psi A)^-1 Psi, for the 2 x 2 matrix A = (n, su; su, suu) of a group."""
    p11, p12, p22 = p
    n, su, suu = F.col("n"), F.col("su"), F.col("suu")
    b11, b12, b21, b22 = 1 + p11 * n + p12 * su, p11 * su + p12 * suu, p12 * n + p22 * su, 1 + p12 * su + p22 * suu
    det = b11 * b22 - b12 * b21
    return det, (b22 * p11 - b12 * p12) / det, (b22 * p12 - b12 * p22) / det, (b11 * p22 - b21 * p12) / det


def _evaluated(groups: DataFrame, inner: np.ndarray, n: float, reml: bool, points: list[np.ndarray]) -> list[tuple]:
    """_likelihood at each of the points (a, c, d), Psi = LL' with L = (a, 0; c, d): one aggregate over the groups for all of them."""
    m = len(inner)
    psi = [(k, float(a * a), float(a * c), float(c * c + d * d)) for k, (a, c, d) in enumerate(points)]
    tried = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(x).alias("p11"), F.lit(y).alias("p12"), F.lit(z).alias("p22")) for k, x, y, z in psi))
    det, m11, m12, m22 = _inside((F.col("c.p11"), F.col("c.p12"), F.col("c.p22")))
    each = groups.withColumn("c", F.explode(tried)).select(F.col("c.k").alias("k"), F.log(det).alias("ld"), m11.alias("m11"), m12.alias("m12"), m22.alias("m22"), *(f"s{i}" for i in range(m)), *(f"t{i}" for i in range(m)))
    cells = [(i, j) for i in range(m) for j in range(i, m)]
    s, t = [F.col(f"s{i}") for i in range(m)], [F.col(f"t{i}") for i in range(m)]
    taken = [F.sum(F.col("m11") * s[i] * s[j] + F.col("m12") * (s[i] * t[j] + t[i] * s[j]) + F.col("m22") * t[i] * t[j]) for i, j in cells]
    out: list = [None] * len(points)
    for k, log_det, *sums in each.groupBy("k").agg(F.sum("ld"), *taken).collect():  # one row a point
        less = np.zeros((m, m))
        for (i, j), x in zip(cells, sums, strict=True):
            less[i, j] = less[j, i] = x
        out[k] = _likelihood(inner - less, log_det, n, reml)
    return out


#: Points of a cube of step 1 around its centre, and the terms of a quadratic at each.
_CUBE = np.array(list(product((-1.0, 0.0, 1.0), repeat=3)))
_TERMS = np.array([[1, *x, *(x[i] * x[j] for i in range(3) for j in range(i, 3))] for x in _CUBE])
ROUNDS, STEP, LEAST_STEP = 60, 0.25, 1e-4


def _climbed(value, start: np.ndarray, best: float) -> np.ndarray:
    """The point near start where value() is greatest: cubes of 27 points, each round tried at once, moved to their best point
    or to the top of the quadratic through them, and made smaller while the best stays in the middle."""
    step, centre = STEP * max(1.0, float(np.abs(start).max())), start
    for _ in range(ROUNDS):
        found = np.array(value([centre + step * x for x in _CUBE]))
        top = int(found.argmax())
        q2 = np.linalg.lstsq(_TERMS, found, rcond=None)[0]
        h = np.zeros((3, 3))
        for x, (i, j) in zip(q2[4:], [(i, j) for i in range(3) for j in range(i, 3)], strict=True):
            h[i, j] += x
            h[j, i] += x
        move = -np.linalg.pinv(h) @ q2[1:4]
        if np.abs(move).max() <= 1 and np.linalg.eigvalsh(h).max() < 1e-12 * abs(found[top]) + 1e-9:
            moved = centre + step * move
            there = value([moved])[0]
            if there >= found[top]:
                centre, best, top = moved, there, len(_CUBE) // 2
        if top != len(_CUBE) // 2:
            centre, best = centre + step * _CUBE[top], float(found[top])
            continue
        if step < LEAST_STEP:
            break
        step /= 5
    return centre


def _with_slope(df: DataFrame, y: str, xs: list[str], group: str, reml: bool, ci_level: float, slope: str) -> dict[str, DataFrame]:
    """mixed_effects with intercept and slope of each group drawn together, their covariance a matrix of three numbers.

    A group enters through 2 x 2 and 2 x (columns) sums, stored once; the likelihood at any covariance is an aggregate over
    groups, taken at 27 covariances at once. A rough grid is tried first, then cubes around its best point. Only a row for
    each covariance tried reaches the driver. The slope column is centred and scaled inside; results are for it as given,
    so that var_random_intercept holds where it is 0. It has to vary. aic and bic count the fixed effects and the three.
    """
    columns = [*xs, y]
    known = df.where(reduce(lambda a, b: a & b, [q(c).isNotNull() & ~F.isnan(q(c).cast("double")) for c in [*columns, slope]]) & q(group).isNotNull())
    *means, middle, spread = known.agg(*(F.avg(q(c).cast("double")) for c in columns), F.avg(q(slope).cast("double")), F.stddev_pop(q(slope).cast("double"))).first()
    if middle is None:
        raise OperatorError("no row has all columns")
    if not spread > 1e-12 * max(1.0, abs(middle)):
        raise OperatorError("the column of the slope does not vary")
    v = [F.lit(1.0), *(q(c).cast("double") - F.lit(float(m)) for c, m in zip(columns, means, strict=True))]
    u = (q(slope).cast("double") - F.lit(float(middle))) / F.lit(float(spread))
    m = len(v)
    p = m - 1
    cells = [(i, j) for i in range(m) for j in range(i, m)]
    groups = stored(known.groupBy(q(group).alias("group")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(u).alias("su"), F.sum(u * u).alias("suu"),
        *(F.sum(v[i]).alias(f"s{i}") for i in range(m)), *(F.sum(u * v[i]).alias(f"t{i}") for i in range(m)), *(F.sum(v[i] * v[j]).alias(f"p{i}_{j}") for i, j in cells),
    ))
    n, n_groups, *sums = groups.agg(F.sum("n"), F.count(F.lit(1)), *(F.sum(f"p{i}_{j}") for i, j in cells)).first()
    inner = np.zeros((m, m))
    for (i, j), x in zip(cells, sums, strict=True):
        inner[i, j] = inner[j, i] = x

    def value(points):
        return [r[0] for r in _evaluated(groups, inner, n, reml, points)]

    grid = [np.array([a, b * r, b * (1 - r * r) ** 0.5]) for a, b, r in product((0.0, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0), (0.0, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0), (-0.6, 0.0, 0.6))]
    found = value(grid)
    start = int(np.argmax(found))
    a, c, d = _climbed(value, grid[start], found[start])
    likelihood, beta, inverse, variance = _evaluated(groups, inner, n, reml, [np.array([a, c, d])])[0]

    psi = np.array([[a * a, a * c], [a * c, c * c + d * d]])
    given = np.array([[1, -middle / spread], [0, 1 / spread]])  # from intercept and slope of u to those of the column
    cov = given @ psi @ given.T * variance
    _, m11, m12, m22 = _inside(tuple(F.lit(float(x)) for x in (a * a, a * c, c * c + d * d)))
    s, t = (F.col(f"{k}{p}") - reduce(lambda x, z: x + z, [F.col(f"{k}{i}") * float(beta[i]) for i in range(p)]) for k in "st")
    first, second = m11 * s + m12 * t, m12 * s + m22 * t
    effects = stored(groups.select("group", (first - second * float(middle / spread)).alias("intercept"), (second / float(spread)).alias("slope")))
    drop_stored(groups)
    spark, terms = df.sparkSession, p + 3
    summary = (int(n), int(n_groups), float(likelihood), float(-2 * likelihood + 2 * terms), float(-2 * likelihood + np.log(n) * terms), *map(float, (cov[0, 0], cov[1, 1], cov[0, 1], variance, cov[0, 0] / (cov[0, 0] + variance))), "REML" if reml else "ML")
    return {
        "fixed_effects": _fixed(spark, xs, list(means), beta, inverse, variance, ci_level),
        "random_effects": effects,
        "summary": spark.createDataFrame([summary], "n_obs long, n_groups long, log_likelihood double, aic double, bic double, var_random_intercept double, var_random_slope double, cov_random double, var_residual double, icc double, method string"),
    }
