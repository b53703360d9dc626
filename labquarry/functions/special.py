"""Distribution functions, vectorised in numpy, and as Spark columns for small result tables.

They are meant for the handful of rows that a test yields, not for raw data: there the statistics are Spark aggregates.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])
erf = np.vectorize(math.erf, otypes=[float])
erfc = np.vectorize(math.erfc, otypes=[float])
_TINY = 1e-300


def _beta_fraction(a, b, x):
    """Lentz's continued fraction of the incomplete beta function."""
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def betainc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    out = np.full(a.shape, np.nan)
    ok = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    out[ok & (x == 0)], out[ok & (x == 1)] = 0.0, 1.0
    ok = ok & (x > 0) & (x < 1)
    if ok.any():
        p, q, y = a[ok], b[ok], x[ok]
        swap = y > (p + 1) / (p + q + 2)
        p2, q2, y2 = np.where(swap, q, p), np.where(swap, p, q), np.where(swap, 1 - y, y)
        front = np.exp(_lgamma(p2 + q2) - _lgamma(p2) - _lgamma(q2) + p2 * np.log(y2) + q2 * np.log1p(-y2)) / p2
        value = front * _beta_fraction(p2, q2, y2)
        out[ok] = np.where(swap, 1 - value, value)
    return out


def gammainc(a, x) -> np.ndarray:
    """Regularised lower incomplete gamma function."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    ok = (a > 0) & (x >= 0)
    out[ok & (x == 0)] = 0.0
    out[ok & np.isinf(x)] = 1.0
    for i in zip(*np.nonzero(ok & (x > 0) & np.isfinite(x)), strict=True) if a.shape else [()]:
        s, y = float(a[i]), float(x[i])
        if not (s > 0 and y > 0 and math.isfinite(y)):
            continue
        front = math.exp(s * math.log(y) - y - math.lgamma(s))
        if y < s + 1:
            term = total = 1 / s
            k = s
            while abs(term) > abs(total) * 1e-16:
                k += 1
                term *= y / k
                total += term
            out[i] = front * total
        else:
            b, c = y + 1 - s, 1 / _TINY
            d = 1 / b
            h = d
            for k in range(1, 10_000):
                top = -k * (k - s)
                b += 2
                d = 1 / (top * d + b or _TINY)
                c = b + top / c or _TINY
                h *= d * c
                if abs(d * c - 1) < 1e-16:
                    break
            out[i] = 1 - front * h
    return out


def normal_sf(z):
    return 0.5 * erfc(np.asarray(z, float) / math.sqrt(2))


def t_sf(t, df):
    """P(T > t)."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    tail = 0.5 * betainc(df / 2, 0.5, df / (df + t * t))
    return np.where(t >= 0, tail, 1 - tail)


def f_sf(f, d1, d2):
    f, d1, d2 = np.broadcast_arrays(*(np.asarray(v, float) for v in (f, d1, d2)))
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_sf(x, df):
    return 1 - gammainc(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def kolmogorov_sf(x):
    """P(K > x) of the limiting distribution of sqrt(n) times the largest gap."""
    x = np.asarray(x, float)
    k = np.arange(1, 101)[:, None]
    with np.errstate(all="ignore"):
        value = 2 * ((-1.0) ** (k - 1) * np.exp(-2 * k * k * np.atleast_1d(x)[None, :] ** 2)).sum(0)
    return np.where(np.atleast_1d(x) < 0.2, 1.0, np.clip(value, 0, 1)).reshape(x.shape)


def range_sf(q, k, df):
    """P(Q > q) of the studentized range of k means with df degrees of freedom, by Gauss-Legendre sums over the scale and the place."""
    q, k, df = np.broadcast_arrays(*(np.atleast_1d(np.asarray(v, float)) for v in (q, k, df)))
    node, weight = np.polynomial.legendre.leggauss(200)
    z = 9 * node
    phi, upto = np.exp(-z * z / 2) / math.sqrt(2 * math.pi), 1 - normal_sf(z)
    out = np.full(q.shape, np.nan)
    for i, (x, m, d) in enumerate(zip(q.ravel(), k.ravel(), df.ravel(), strict=True)):
        if not (x >= 0 and m >= 2 and d >= 1):
            continue
        low, high = max(0.0, 1 - 9 / math.sqrt(2 * d)), 1 + 9 / math.sqrt(2 * d)
        s = (low + high) / 2 + (high - low) / 2 * node
        log_density = (d - 1) * np.log(s) - d * (s * s - 1) / 2
        scale = weight * np.exp(log_density - log_density.max())
        inside = np.maximum(0, upto - (1 - normal_sf(z - x * s[:, None])))
        within = 9 * m * (weight * phi * inside ** (m - 1)).sum(1)
        out.ravel()[i] = min(1.0, max(0.0, 1 - (scale * within).sum() / scale.sum()))
    return out


def _inverse(sf, p, low, high):
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if float(sf(mid)) > p else (low, mid)
    return (low + high) / 2


def t_quantile(q: float, df: float) -> float:
    """x with P(T <= x) = q."""
    return _inverse(lambda x: t_sf(x, df), 1 - q, -1e6, 1e6)


def normal_quantile(q: float) -> float:
    return _inverse(normal_sf, 1 - q, -40.0, 40.0)


def _column(function, *arguments: Column) -> Column:
    @F.pandas_udf("double")
    def run(frame: pd.DataFrame) -> pd.Series:
        # Rows are the few of a result table; nulls give nulls.
        with np.errstate(all="ignore"):
            return pd.Series(np.asarray(function(*(frame[c].to_numpy(float) for c in frame.columns)), float), dtype=float)

    return F.nanvl(run(F.struct(*(a.cast("double").alias(f"a{k}") for k, a in enumerate(arguments)))), F.lit(None).cast("double"))


def p_t(t: Column, df: Column, alternative: str = "two-sided") -> Column:
    if alternative == "two-sided":
        return _column(lambda x, d: 2 * t_sf(np.abs(x), d), t, df)
    return _column(t_sf, t if alternative == "greater" else -t, df)


def p_normal(z: Column, alternative: str = "two-sided") -> Column:
    if alternative == "two-sided":
        return _column(lambda x: 2 * normal_sf(np.abs(x)), z)
    return _column(normal_sf, z if alternative == "greater" else -z)


def p_f(f: Column, d1: Column, d2: Column) -> Column:
    return _column(f_sf, f, d1, d2)


def p_chi2(x: Column, df: Column) -> Column:
    return _column(chi2_sf, x, df)


def p_kolmogorov(x: Column) -> Column:
    return _column(kolmogorov_sf, x)


def p_range(q: Column, k: Column, df: Column) -> Column:
    return _column(range_sf, q, k, df)


# The published rational approximations of the normal quantile (Wichura, 1988, algorithm AS 241, PPND16),
# numerators and denominators by rising power: near the middle, and for the tails in sqrt(-ln p) up to 5 and beyond.
_QUANTILE = {
    "middle": (
        [3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727],
        [1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610],
    ),
    "tail": (
        [1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4],
        [1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9],
    ),
    "far": (
        [6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
        [1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15],
    ),
}


def quantile_normal_sql(p: str) -> str:
    """The normal quantile of an SQL expression strictly between 0 and 1, as an expression that Spark and other engines read."""

    def ratio(part: str, x: str) -> str:
        powers = [reduce(lambda s, c: f"({s} * ({x}) + CAST({c!r} AS DOUBLE))", reversed(side[:-1]), f"CAST({side[-1]!r} AS DOUBLE)") for side in _QUANTILE[part]]
        return f"({powers[0]} / {powers[1]})"

    r = f"sqrt(-ln(least({p}, 1 - ({p}))))"
    middle = f"(({p}) - 0.5) * {ratio('middle', f'0.180625 - (({p}) - 0.5) * (({p}) - 0.5)')}"
    tail = f"CASE WHEN {r} <= 5 THEN {ratio('tail', f'{r} - 1.6')} ELSE {ratio('far', f'{r} - 5')} END"
    return f"(CASE WHEN abs(({p}) - 0.5) <= 0.425 THEN {middle} WHEN ({p}) < 0.5 THEN -({tail}) ELSE {tail} END)"


#: The Euler-Mascheroni constant.
EULER = 0.57721566490153286


def digamma(n: Column) -> Column:
    """psi of whole numbers from 1: harmonic sums below 10, the asymptotic series from there."""
    small = F.array(*(F.lit(sum(1 / j for j in range(1, i)) - EULER) for i in range(1, 10)))
    x = n.cast("double")
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    return F.when(n < 10, F.element_at(small, F.greatest(n, F.lit(1)).cast("int"))).otherwise(series)
