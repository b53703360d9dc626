"""Nonlinear curves fitted by sums: each step of Levenberg and Marquardt's method is one aggregate over the rows of all groups.

A curve is a column of x and its parameters. A step needs, for each group, sums of products of its slopes and residuals,
whatever the rows; the small systems of all groups are then solved beside each other. Equal points are counted, not
repeated. Steps are stored, so a lost executor costs one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..storage import drop_stored, stored
from .tabular import OperatorError, as_text, q


@dataclass(frozen=True)
class Curve:
    """names of parameters, the curve, its start from y_min, y_max, y_first, y_last, x_mid and x_span, and x of a y (None: not told)."""

    names: tuple[str, ...]
    f: Callable[..., Column]
    start: Callable[..., list[Column]]
    inverse: Callable[..., Column] | None = None


def _least(c: Column, low: float) -> Column:
    return F.greatest(c, F.lit(low))


CURVES: dict[str, Curve] = {
    "4pl": Curve(
        ("bottom", "top", "ec50", "hill"),
        lambda x, b, t, e, h: b + (t - b) / (1 + F.pow(_least(x, 1e-300) / e, -h)),
        lambda s: [s["y_min"], s["y_max"], _least(s["x_mid"], 1e-6), F.when(s["y_last"] >= s["y_first"], 1.0).otherwise(-1.0)],
        lambda y, b, t, e, h: e * F.pow((y - b) / (t - y), 1 / h),
    ),
    "hill": Curve(
        ("vmax", "k", "n"),
        lambda x, v, k, n: v * F.pow(_least(x, 0.0), n) / (F.pow(F.abs(k), n) + F.pow(_least(x, 0.0), n)),
        lambda s: [s["y_max"], _least(s["x_mid"], 1e-6), F.lit(1.0)],
        lambda y, v, k, n: F.abs(k) * F.pow(y / (v - y), 1 / n),
    ),
    "one_phase_decay": Curve(
        ("y0", "plateau", "k"),
        lambda x, a, p, k: (a - p) * F.exp(-k * x) + p,
        lambda s: [s["y_first"], s["y_last"], 3 / _least(s["x_span"], 1e-9)],
        lambda y, a, p, k: -F.log((y - p) / (a - p)) / k,
    ),
    "two_phase_decay": Curve(
        ("a1", "k1", "a2", "k2", "plateau"),
        lambda x, a, k, b, m, p: a * F.exp(-k * x) + b * F.exp(-m * x) + p,
        lambda s: [(s["y_max"] - s["y_min"]) / 2, 5 / _least(s["x_span"], 1e-9), (s["y_max"] - s["y_min"]) / 2, 1 / _least(s["x_span"], 1e-9), s["y_min"]],
    ),
    "exponential_growth": Curve(("y0", "k"), lambda x, a, k: a * F.exp(k * x), lambda s: [_least(s["y_first"], 1e-6), 1 / _least(s["x_span"], 1e-9)], lambda y, a, k: F.log(y / a) / k),
    "michaelis_menten": Curve(("vmax", "km"), lambda x, v, k: v * x / (k + x), lambda s: [s["y_max"] * 1.2, _least(s["x_mid"], 1e-6)], lambda y, v, k: k * y / (v - y)),
    "gompertz": Curve(
        ("a", "b", "c"),
        lambda x, a, b, c: a * F.exp(-b * F.exp(-c * x)),
        lambda s: [s["y_max"], F.lit(2.0), 3 / _least(s["x_span"], 1e-9)],
        lambda y, a, b, c: -F.log(-F.log(y / a) / b) / c,
    ),
    "sigmoid": Curve(
        ("top", "x0", "k"),
        lambda x, a, m, k: a / (1 + F.exp(-k * (x - m))),
        lambda s: [s["y_max"], s["x_mid"], 4 / _least(s["x_span"], 1e-9)],
        lambda y, a, m, k: m - F.log(a / y - 1) / k,
    ),
}


def _slopes(curve: Curve, x: Column, p: Column) -> list[Column]:
    """The curve's slope by each parameter, from differences to both sides."""
    own = [p[k] for k in range(len(curve.names))]
    out = []
    for k, value in enumerate(own):
        h = F.greatest(F.abs(value), F.lit(1e-4)) * 1e-5
        moved = lambda d, k=k, h=h: curve.f(x, *(v + d * h if j == k else v for j, v in enumerate(own)))
        out.append((moved(1) - moved(-1)) / (2 * h))
    return out


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


_STATE = "g string, n long, total double, p array<double>, trial array<double>, damping double, sse double, a array<double>, b array<double>, done boolean"


def _steps(k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Takes the trial's sums into each group's state, or more damping where it was no better, and sets the next trial."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.to_dict("records"):
                r["done"] = bool(r["done"])
                if not r["done"]:
                    sums = np.array([r[f"s{i}"] for i in range(1 + k + len(_pairs(k)))], float)
                    first = r["a"] is None
                    if np.isfinite(sums).all() and (first or sums[0] < r["sse"]):
                        a = np.zeros((k, k))
                        for v, (i, j) in zip(sums[1 + k :], _pairs(k), strict=True):
                            a[i, j] = a[j, i] = v
                        r["done"] = not first and r["sse"] - sums[0] <= 1e-11 * r["sse"] or sums[0] <= 1e-20 * (r["total"] or 0.0)
                        r |= {"p": r["trial"], "sse": sums[0], "a": a.ravel(), "b": sums[1 : 1 + k], "damping": r["damping"] if first else max(r["damping"] / 5, 1e-12)}
                    else:
                        r["damping"] *= 4
                        r["done"] = first or r["damping"] > 1e14
                    if r["a"] is not None and not r["done"]:
                        a, p = np.asarray(r["a"], float).reshape(k, k), np.asarray(r["p"], float)
                        d = np.linalg.lstsq(a + r["damping"] * np.diag(np.maximum(np.diag(a), 1e-12)), np.asarray(r["b"], float), rcond=None)[0]
                        r["trial"] = p + d
                        r["done"] = bool(d @ np.asarray(r["b"], float) <= 1e-11 * r["sse"])  # what the step promises to gain
                rows.append([r[c.split()[0]] for c in _STATE.split(", ")])
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _STATE.split(", ")])

    return run


def fit_curves(df: DataFrame, x: str, y: str, model: str = "4pl", group: str | None = None, rounds: int = 200) -> DataFrame:
    """(group, n, sse, total, p, cov): least-squares parameters of a curve of CURVES for each group, their covariances (row by row) and the sums of squares.

    Groups of fewer than 4 points, or fewer than parameters, and groups whose start has no finite residuals are left out.
    Null x or y are left out, a null group is none. Fits that need more than `rounds` steps keep what they have reached.
    """
    if model not in CURVES:
        raise OperatorError(f"no curve {model!r}")
    curve = CURVES[model]
    k = len(curve.names)
    rows = df.where(q(x).isNotNull() & q(y).isNotNull()).select((as_text(q(group)) if group else F.lit("all")).alias("g"), q(x).cast("double").alias("x"), q(y).cast("double").alias("y")).where("g is not null")
    cells = stored(rows.groupBy("g", "x", "y").agg(F.count(F.lit(1)).alias("w")))
    seen = cells.groupBy("g").agg(
        F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("sy"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.min_by("y", "x").alias("y_first"), F.max_by("y", "x").alias("y_last"),
        F.percentile_approx("x", 0.5).alias("x_mid"), (F.max("x") - F.min("x")).alias("x_span"),
    ).where(F.col("n") >= max(4, k))
    spread = cells.join(seen.select("g", (F.col("sy") / F.col("n")).alias("mean")), "g").groupBy("g").agg(F.sum(F.col("w") * (F.col("y") - F.col("mean")) ** 2).alias("total"))
    at = {c: F.col(c) for c in ("y_min", "y_max", "y_first", "y_last", "x_mid", "x_span")}
    start = F.array(*(c.cast("double") for c in curve.start(at)))
    none = F.lit(None).cast("array<double>")
    now = stored(seen.join(spread, "g").select("g", "n", "total", start.alias("p"), start.alias("trial"), F.lit(1e-3).alias("damping"), F.lit(None).cast("double").alias("sse"), none.alias("a"), none.alias("b"), F.lit(False).alias("done")))
    p = F.col("trial")
    r = F.col("y") - curve.f(F.col("x"), *(p[i] for i in range(k)))
    for _ in range(rounds):
        told = cells.join(now.where("not done").select("g", "trial"), "g").select("g", "w", r.alias("r"), *(s.alias(f"j{i}") for i, s in enumerate(_slopes(curve, F.col("x"), p))))
        w, j = F.col("w"), [F.col(f"j{i}") for i in range(k)]
        sums = [w * F.col("r") * F.col("r"), *(w * v * F.col("r") for v in j), *(w * j[a] * j[b] for a, b in _pairs(k))]
        found = told.groupBy("g").agg(*(F.sum(s).alias(f"s{i}") for i, s in enumerate(sums)))
        after = stored(now.join(found, "g", "left").mapInPandas(_steps(k), _STATE))
        drop_stored(now)
        now = after
        if now.where("not done").isEmpty():
            break
    drop_stored(cells)

    def covariances(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            cov = [np.linalg.pinv(np.asarray(a, float).reshape(k, k)).ravel() * s / max(1, n - k) for a, s, n in zip(pdf["a"], pdf["sse"], pdf["n"], strict=True)]
            own = [np.abs(v) if model == "hill" else v for v in pdf["p"]]  # k enters by its size
            yield pd.DataFrame({"group": pdf["g"], "n": pdf["n"], "sse": pdf["sse"], "total": pdf["total"], "p": own, "cov": cov})

    return now.where("a is not null").mapInPandas(covariances, "group string, n long, sse double, total double, p array<double>, cov array<double>")


def _t_quantiles(fits: DataFrame, k: int, level: float) -> DataFrame:
    """fits with t: the two-sided quantile of each group's degrees of freedom."""
    t = special._column(lambda n: np.array([special.t_quantile((1 + level) / 2, max(1.0, v - k)) for v in np.atleast_1d(n)]), F.col("n").cast("double"))
    return fits.withColumn("t", t)


def parameters(fits: DataFrame, model: str, level: float = 0.95) -> DataFrame:
    """(group, parameter, value, std_error, t_value, p, ci_low, ci_high, r_squared, rmse, aic, bic, n) of fit_curves()."""
    names = CURVES[model].names
    k = len(names)
    n, sse = F.col("n").cast("double"), F.col("sse")
    own = F.array(*(F.struct(F.lit(name).alias("parameter"), F.col("p")[i].alias("value"), F.sqrt(F.greatest(F.col("cov")[i * k + i], F.lit(0.0))).alias("std_error")) for i, name in enumerate(names)))
    fits = _t_quantiles(fits, k, level)
    logs = F.when(sse > 0, n * (F.log(2 * math.pi * sse / n) + 1))  # minus twice the log-likelihood
    out = fits.select("group", "n", "t", "sse", "total", F.inline(own))
    t_value = F.try_divide("value", "std_error")
    return out.select(
        "group", "parameter", "value", "std_error", t_value.alias("t_value"), special.p_t(t_value, F.greatest(n - k, F.lit(1.0))).alias("p"), (F.col("value") - F.col("t") * F.col("std_error")).alias("ci_low"),
        (F.col("value") + F.col("t") * F.col("std_error")).alias("ci_high"), F.when(F.col("total") > 0, 1 - sse / F.col("total")).alias("r_squared"), F.sqrt(sse / n).alias("rmse"), (2 * k + logs).alias("aic"), (k * F.log(n) + logs).alias("bic"), "n",
    )


def nonlinear_fit(df: DataFrame, x: str, y: str, model: str = "4pl", group: str | None = None) -> DataFrame:
    """parameters() of fit_curves()."""
    return parameters(fit_curves(df, x, y, model, group), model)


def curve_band(fits: DataFrame, model: str, low: float, high: float, points: int = 200, level: float = 0.95) -> DataFrame:
    """(group, x, fit, ci_low, ci_high) on an even grid; the band is of the curve's own error (delta method)."""
    curve = CURVES[model]
    k = len(curve.names)
    step = (high - low) / max(1, points - 1)
    grid = _t_quantiles(fits, k, level).withColumn("x", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(float(low)) + i * F.lit(step))))
    slopes = _slopes(curve, F.col("x"), F.col("p"))
    rows = grid.withColumns({"fit": curve.f(F.col("x"), *(F.col("p")[i] for i in range(k)))} | {f"j{i}": s for i, s in enumerate(slopes)})
    var = reduce(lambda a, b: a + b, [F.col(f"j{i}") * F.col(f"j{j}") * F.col("cov")[i * k + j] for i in range(k) for j in range(k)])
    half = F.col("t") * F.sqrt(F.greatest(var, F.lit(0.0)))
    return rows.select("group", "x", "fit", (F.col("fit") - half).alias("ci_low"), (F.col("fit") + half).alias("ci_high"))


def _with_fit(df: DataFrame, fits: DataFrame, group: str | None) -> DataFrame:
    own = fits.select(F.col("group").alias("_g"), F.col("p").alias("_p"))
    return df.join(own, (as_text(q(group)) if group else F.lit("all")) == F.col("_g"), "left").drop("_g")


def predict(df: DataFrame, fits: DataFrame, model: str, x: str, group: str | None = None, name: str = "prediction") -> DataFrame:
    """df with the curve's y at x; null where the group has no fit."""
    curve = CURVES[model]
    return _with_fit(df, fits, group).withColumn(name, curve.f(q(x).cast("double"), *(F.col("_p")[i] for i in range(len(curve.names))))).drop("_p")


def inverse_predict(df: DataFrame, fits: DataFrame, model: str, y: str, group: str | None = None, name: str = "x_of_y") -> DataFrame:
    """df with the x at which the curve has y; null beyond the curve's range, or where the group has no fit."""
    curve = CURVES[model]
    if curve.inverse is None:
        raise OperatorError(f"{model!r} cannot be solved for x")
    x = curve.inverse(q(y).cast("double"), *(F.col("_p")[i] for i in range(len(curve.names))))
    return _with_fit(df, fits, group).withColumn(name, F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)).drop("_p")


def curve(model: str, parameters: dict[str, float], low: float, high: float, points: int, spark) -> DataFrame:
    """(x, y) of a curve on an even grid."""
    own = CURVES[model]
    step = (high - low) / max(1, points - 1)
    return spark.range(points).select((F.lit(float(low)) + F.col("id") * step).alias("x")).withColumn("y", own.f(F.col("x"), *(F.lit(float(parameters[n])) for n in own.names)))
