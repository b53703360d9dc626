"""Segmentation and shape operations on image rows: thresholds, skeletons, watersheds, edges, lines, circles, blobs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .images import _along, _flat, _kernel, _map, _shifted, connected, distance, histogram


def threshold_local(df: DataFrame, block: int = 25, offset: float = 0.0) -> DataFrame:
    """1 where a pixel exceeds the Gaussian mean of its block."""
    sigma = (block - 1) / 6

    def run(a: np.ndarray) -> np.ndarray:
        mean = _along(_along(a, _kernel(sigma), 0), _kernel(sigma), 1)
        return (a > mean - offset).astype(float)

    return _map(df, _flat(run))


def bandpass(df: DataFrame, small: float = 3, large: float = 100) -> DataFrame:
    """Difference of two Gaussian means: structures between the two sizes stay."""

    def run(a: np.ndarray) -> np.ndarray:
        mean = lambda s: _along(_along(a, _kernel(s), 0), _kernel(s), 1)
        return mean(small / 2) - mean(large / 2)

    return _map(df, _flat(run))


def equalize(df: DataFrame, bins: int = 256) -> DataFrame:
    """Values replaced by their share of smaller or equal ones."""

    def run(a: np.ndarray) -> np.ndarray:
        counts, cuts = np.histogram(a, bins)
        share = np.cumsum(counts) / max(1, a.size)
        return np.interp(a, (cuts[:-1] + cuts[1:]) / 2, share)

    return _map(df, _flat(run))


def multi_otsu(df: DataFrame, classes: int = 3, bins: int = 64) -> DataFrame:
    """(key, thresholds): cuts that part the histogram into the classes farthest apart. Histograms, not pixels, are searched."""
    h = histogram(df, bins).groupBy("key").agg(F.collect_list(F.struct("bin", "count")).alias("h"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, rows in pdf.itertuples(index=False):
                n = np.zeros(bins)
                for r in rows:
                    n[r["bin"]] += r["count"]
                center = (np.arange(bins) + 0.5) / bins
                w, m = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * center)])
                best, cuts = -1.0, ()
                for c in combinations(range(1, bins), classes - 1):
                    e = (0, *c, bins)
                    s = sum((m[b] - m[a]) ** 2 / (w[b] - w[a]) for a, b in zip(e, e[1:], strict=False) if w[b] > w[a])
                    if s > best + 1e-12:
                        best, cuts = s, c
                out.append((key, [float(center[c - 1]) for c in cuts]))
            yield pd.DataFrame(out, columns=["key", "thresholds"])

    return h.mapInPandas(run, "key string, thresholds array<double>")


def skeleton(mask: np.ndarray) -> np.ndarray:
    """One pixel wide lines of the mask, thinned from both sides in turn until nothing changes."""
    a = np.pad(mask > 0, 1)
    around = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    while True:
        changed = False
        for turn in range(2):
            p = [_shifted(a, (-dy, -dx), False) for dy, dx in around]
            n = sum(x.astype(int) for x in p)
            steps = sum((~x & y).astype(int) for x, y in zip(p, p[1:] + p[:1], strict=True))
            north, east, south, west = p[0], p[2], p[4], p[6]
            sides = ~(north & east & south) & ~(east & south & west) if turn == 0 else ~(north & east & west) & ~(north & south & west)
            gone = a & (n >= 2) & (n <= 6) & (steps == 1) & sides
            if gone.any():
                a, changed = a & ~gone, True
        if not changed:
            return a[1:-1, 1:-1].astype(float)


def skeletonize(df: DataFrame) -> DataFrame:
    return _map(df, _flat(skeleton))


def skeleton_statistics(df: DataFrame) -> DataFrame:
    """(key, pixels, ends, junctions) of skeletons."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                a = np.asarray(r.pixels).reshape(r.h, r.w, r.c)[:, :, 0] > 0
                n = sum(_shifted(a, (dy, dx), False).astype(int) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)
                out.append((r.key, int(a.sum()), int((a & (n == 1)).sum()), int((a & (n >= 3)).sum())))
            yield pd.DataFrame(out, columns=["key", "pixels", "ends", "junctions"])

    return df.select("key", "h", "w", "c", "pixels").mapInPandas(run, "key string, pixels long, ends long, junctions long")


def _peaks(d: np.ndarray, apart: int) -> np.ndarray:
    """Places of local maxima, at least `apart` from each other, highest first."""
    top = d > 0
    for dy in range(-1, 2):
        for dx in range(-1, 2):
            if dy or dx:
                top &= d >= _shifted(d, (dy, dx), -np.inf)
    at = np.argwhere(top)
    at = at[np.argsort(-d[tuple(at.T)], kind="stable")]
    kept: list[np.ndarray] = []
    for p in at:
        if all(max(abs(p - k)) >= apart for k in kept):
            kept.append(p)
    return np.array(kept, int).reshape(-1, 2)


def flooded(mask: np.ndarray, apart: int = 10) -> np.ndarray:
    """Labels of the mask's parts: basins of the distance to its edge, flooded from its peaks, highest first."""
    import heapq

    d = distance(mask)
    label = np.zeros(mask.shape, int)
    heap: list = []
    for k, (y, x) in enumerate(_peaks(d, apart), 1):
        label[y, x] = k
        heapq.heappush(heap, (-d[y, x], k, int(y), int(x)))
    h, w = mask.shape
    while heap:
        _, k, y, x = heapq.heappop(heap)
        for v, u in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if 0 <= v < h and 0 <= u < w and mask[v, u] > 0 and not label[v, u]:
                label[v, u] = label[y, x]
                heapq.heappush(heap, (-d[v, u], k, v, u))
    return label


def watershed(df: DataFrame, apart: int = 10) -> DataFrame:
    return _map(df, lambda a: flooded(a[:, :, 0], apart))


def canny(df: DataFrame, sigma: float = 1.0, low: float = 0.1, high: float = 0.2) -> DataFrame:
    """Edges one pixel wide: maxima of the gradient along its direction, above high or connected with such above low."""

    def run(a: np.ndarray) -> np.ndarray:
        s = _along(_along(a, _kernel(sigma), 0), _kernel(sigma), 1)
        slope, smooth = np.array([-1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0]) / 4
        gy, gx = _along(_along(s, slope, 0), smooth, 1), _along(_along(s, slope, 1), smooth, 0)
        g = np.hypot(gy, gx)
        sector = (np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4).astype(int)
        thin = np.zeros(a.shape, bool)
        for k, (dy, dx) in enumerate([(0, 1), (1, 1), (1, 0), (1, -1)]):
            thin |= (sector == k) & (g >= _shifted(g, (dy, dx), 0)) & (g > _shifted(g, (-dy, -dx), 0))
        weak = thin & (g >= low)
        labels = connected(weak, 8)
        strong = np.unique(labels[thin & (g >= high)])
        return (np.isin(labels, strong[strong > 0])).astype(float)

    return _map(df, _flat(run))


def _tables(df: DataFrame, f, columns: list[str], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(r.key, *row) for r in pdf.itertuples(index=False) for row in f(np.asarray(r.pixels, float).reshape(r.h, r.w, r.c)[:, :, 0])]
            yield pd.DataFrame(out, columns=["key", *columns])

    return df.select("key", "h", "w", "c", "pixels").mapInPandas(run, schema)


def hough_lines(df: DataFrame, peaks: int = 10, share: float = 0.5) -> DataFrame:
    """(key, angle, offset, votes): lines x cos + y sin = offset with the most mask pixels, at least a share of the best."""

    def find(a: np.ndarray) -> list[tuple]:
        y, x = np.nonzero(a)
        if not len(y):
            return []
        angles = np.linspace(-np.pi / 2, np.pi / 2, 180, endpoint=False)
        reach = int(np.ceil(np.hypot(*a.shape)))
        votes = np.zeros((2 * reach + 1, len(angles)))
        for k, t in enumerate(angles):
            votes[:, k] = np.bincount(np.round(x * np.cos(t) + y * np.sin(t)).astype(int) + reach, minlength=2 * reach + 1)
        at = [p for p in _peaks(votes, 5) if votes[tuple(p)] >= share * votes.max()][:peaks]
        return [(float(angles[k]), float(o - reach), int(votes[o, k])) for o, k in at]

    return _tables(df, find, ["angle", "offset", "votes"], "key string, angle double, offset double, votes long")


def hough_circles(df: DataFrame, low: int = 10, high: int = 60, peaks: int = 10, share: float = 0.5) -> DataFrame:
    """(key, y, x, radius, score): circles with the largest part of their rim on the mask, at least `share` of it."""

    def find(a: np.ndarray) -> list[tuple]:
        out = []
        on = np.argwhere(a > 0)
        for r in range(low, high + 1):
            n = max(8, int(2 * np.pi * r))
            t = np.arange(n) * 2 * np.pi / n
            rim = np.unique(np.round(np.stack([r * np.sin(t), r * np.cos(t)], 1)).astype(int), axis=0)
            votes = np.zeros(a.shape)
            for y, x in on:
                c = rim + (y, x)
                c = c[(c >= 0).all(1) & (c < a.shape).all(1)]
                votes[c[:, 0], c[:, 1]] += 1
            votes /= len(rim)
            out += [(float(votes[y, x]), int(y), int(x), r) for y, x in _peaks(votes, low) if votes[y, x] >= share]
        kept: list[tuple] = []
        for s, y, x, r in sorted(out, reverse=True):
            if all(max(abs(y - v), abs(x - u)) >= low / 2 for _, v, u, _ in kept):
                kept.append((s, y, x, r))
        return [(y, x, r, s) for s, y, x, r in kept[:peaks]]

    return _tables(df, find, ["y", "x", "radius", "score"], "key string, y int, x int, radius int, score double")


def blobs(df: DataFrame, low: float = 3, high: float = 20, threshold: float = 0.1, steps: int = 8) -> DataFrame:
    """(key, y, x, radius, strength): bright spots, by the strongest response of scaled Laplacians."""

    def find(a: np.ndarray) -> list[tuple]:
        sigmas = np.geomspace(low, high, steps) / np.sqrt(2)
        cube = np.stack([-(s**2) * sum(_along(_along(_along(a, _kernel(s), 0), _kernel(s), 1), np.array([1.0, -2.0, 1.0]), k) for k in range(2)) for s in sigmas])
        found = []
        top = cube.max(0)
        for y, x in _peaks(top, max(1, int(low))):
            if top[y, x] >= threshold:
                found.append((int(y), int(x), float(sigmas[cube[:, y, x].argmax()] * np.sqrt(2)), float(top[y, x])))
        return found

    return _tables(df, find, ["y", "x", "radius", "strength"], "key string, y int, x int, radius double, strength double")


# Absorbance of red, green and blue by the common stains, one row a stain, as published by Ruifrok and
# Johnston and by G. Landini; a row of zeros stands for what is at right angles to the other two.
STAINS = {
    "hematoxylin_eosin": [(0.65, 0.70, 0.29), (0.07, 0.99, 0.11), (0.27, 0.57, 0.78)],
    "hematoxylin_dab": [(0.650, 0.704, 0.286), (0.268, 0.570, 0.776), (0.0, 0.0, 0.0)],
    "hematoxylin_eosin_dab": [(0.650, 0.704, 0.286), (0.072, 0.990, 0.105), (0.268, 0.570, 0.776)],
    "feulgen_light_green": [(0.46420921, 0.83008335, 0.30827187), (0.94705542, 0.25373821, 0.19650764), (0.0, 0.0, 0.0)],
    "giemsa": [(0.834750233, 0.513556283, 0.196330403), (0.092789, 0.954111, 0.283111), (0.0, 0.0, 0.0)],
    "fast_red_fast_blue_dab": [(0.21393921, 0.85112669, 0.47794022), (0.74890292, 0.60624161, 0.26731082), (0.268, 0.570, 0.776)],
    "methyl_green_dab": [(0.98003, 0.144316, 0.133146), (0.268, 0.570, 0.776), (0.0, 0.0, 0.0)],
    "hematoxylin_aec": [(0.650, 0.704, 0.286), (0.2743, 0.6796, 0.6803), (0.0, 0.0, 0.0)],
    "blue_red_orange": [(0.853033, 0.508733, 0.112656), (0.09289875, 0.8662008, 0.49098468), (0.10732849, 0.36765403, 0.9237484)],
    "methylene_blue_ponceau": [(0.7995107, 0.5913521, 0.10528667), (0.09997159, 0.73738605, 0.6680326), (0.0, 0.0, 0.0)],
    "alcian_blue_hematoxylin": [(0.874622, 0.457711, 0.158256), (0.552556, 0.7544, 0.353744), (0.0, 0.0, 0.0)],
    "hematoxylin_pas": [(0.644211, 0.716556, 0.266844), (0.175411, 0.972178, 0.154589), (0.0, 0.0, 0.0)],
}


def stain_matrix(stains: str) -> np.ndarray:
    """The three absorbances, each of length 1; a third stain that is not given is the cross product of the others."""
    m = np.array(STAINS[stains], float)
    if not m[2].any():
        m[2] = np.cross(m[0], m[1])
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def color_deconvolution(df: DataFrame, stains: str = "hematoxylin_eosin") -> dict[str, DataFrame]:
    """ch1, ch2, ch3: how much of each stain a pixel holds, from the logarithms of red, green and blue."""
    inverse = np.linalg.inv(stain_matrix(stains))

    def channel(k: int) -> DataFrame:
        weights = inverse[:, k]
        return _map(df, lambda a: np.maximum(0, (-np.log(np.clip(a, 1e-6, 1)) * weights).sum(2)))

    return {f"ch{k + 1}": channel(k) for k in range(3)}


def hsv_mask(df: DataFrame, hue: tuple[float, float], saturation: tuple[float, float] = (0, 1), value: tuple[float, float] = (0, 1)) -> DataFrame:
    """1 where hue (0 to 1, may wrap), saturation and value are in their ranges."""

    def run(a: np.ndarray) -> np.ndarray:
        r, g, b = a[:, :, 0], a[:, :, 1], a[:, :, 2]
        top, low = a.max(2), a.min(2)
        span = np.where(top > low, top - low, 1)
        h = np.where(top == r, ((g - b) / span) % 6, np.where(top == g, (b - r) / span + 2, (r - g) / span + 4)) / 6
        h = np.where(top > low, h, 0)
        s = np.where(top > 0, (top - low) / np.where(top > 0, top, 1), 0)
        inside = (h >= hue[0]) & (h <= hue[1]) if hue[0] <= hue[1] else (h >= hue[0]) | (h <= hue[1])
        return (inside & (s >= saturation[0]) & (s <= saturation[1]) & (top >= value[0]) & (top <= value[1])).astype(float)

    return _map(df, run)


def rotate(df: DataFrame, degrees: float) -> DataFrame:
    """Turned about its centre, bilinear, same size; what comes from outside is 0."""
    t = np.deg2rad(degrees)

    def run(a: np.ndarray) -> np.ndarray:
        h, w = a.shape
        y, x = np.mgrid[:h, :w]
        cy, cx = (h - 1) / 2, (w - 1) / 2
        v, u = (y - cy) * np.cos(t) + (x - cx) * np.sin(t) + cy, -(y - cy) * np.sin(t) + (x - cx) * np.cos(t) + cx
        y0, x0 = np.floor(v).astype(int), np.floor(u).astype(int)
        p = np.pad(a, 1)
        fy, fx = v - y0, u - x0
        inside = (y0 >= -1) & (y0 < h) & (x0 >= -1) & (x0 < w)
        y0, x0 = np.clip(y0 + 1, 0, h), np.clip(x0 + 1, 0, w)
        return np.where(inside, p[y0, x0] * (1 - fy) * (1 - fx) + p[y0 + 1, x0] * fy * (1 - fx) + p[y0, x0 + 1] * (1 - fy) * fx + p[y0 + 1, x0 + 1] * fy * fx, 0)

    return _map(df, _flat(run))


def contours(df: DataFrame, level: float = 0.5, min_area: int = 0) -> DataFrame:
    """(key, contour, area, y, x): border pixels of each region above the level, regions in scan order."""

    def find(a: np.ndarray) -> list[tuple]:
        on = a > level
        labels = connected(on, 8)
        inner = np.min([_shifted(on.astype(float), s, 0.0) for s in ((0, 1), (0, -1), (1, 0), (-1, 0))], 0) > 0
        area = np.bincount(labels.ravel())
        y, x = np.nonzero(on & ~inner)
        return [(int(labels[v, u]), int(area[labels[v, u]]), int(v), int(u)) for v, u in zip(y, x, strict=True) if area[labels[v, u]] >= min_area]

    return _tables(df, find, ["contour", "area", "y", "x"], "key string, contour int, area long, y int, x int")


def line_profile(df: DataFrame, y0: float, x0: float, y1: float, x1: float) -> DataFrame:
    """(key, step, value): bilinear values along a line, a pixel apart."""

    def find(a: np.ndarray) -> list[tuple]:
        n = int(np.hypot(y1 - y0, x1 - x0)) + 1
        y, x = (np.clip(np.linspace(s, e, n), 0, m - 1) for s, e, m in ((y0, y1, a.shape[0]), (x0, x1, a.shape[1])))
        p = np.pad(a, ((0, 1), (0, 1)), mode="edge")
        i, j = y.astype(int), x.astype(int)
        fy, fx = y - i, x - j
        v = p[i, j] * (1 - fy) * (1 - fx) + p[i + 1, j] * fy * (1 - fx) + p[i, j + 1] * (1 - fy) * fx + p[i + 1, j + 1] * fy * fx
        return list(enumerate(v.tolist()))

    return _tables(df, find, ["step", "value"], "key string, step int, value double")
