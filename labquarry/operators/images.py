"""Images and volumes: one row an image, its pixels an array; neighbourhood operations run in numpy, image by image, in
parallel over images. Measurements come out as tables, which the other operators take further.

An image row is (key string, h int, w int, c int, pixels array<double>), row by row, channels last; a volume has d too.
A mask holds 0 and 1, a label image 0 and the numbers of its regions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tabular import OperatorError

IMAGE = "key string, h int, w int, c int, pixels array<double>"
VOLUME = "key string, d int, h int, w int, pixels array<double>"


def from_arrays(spark, images: dict[str, np.ndarray]) -> DataFrame:
    """Image rows from arrays (h, w) or (h, w, c); for small inputs and tests."""
    rows = []
    for key, a in images.items():
        a = np.asarray(a, float)
        a = a[:, :, None] if a.ndim == 2 else a
        rows.append((key, *a.shape, a.ravel().tolist()))
    return spark.createDataFrame(rows, IMAGE)


def volumes_from_arrays(spark, volumes: dict[str, np.ndarray]) -> DataFrame:
    return spark.createDataFrame([(k, *np.shape(a), np.asarray(a, float).ravel().tolist()) for k, a in volumes.items()], VOLUME)


def _map(df: DataFrame, function: Callable[[np.ndarray], np.ndarray], volume: bool = False) -> DataFrame:
    """function over each array; its result may have another shape."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                shape = (row.d, row.h, row.w) if volume else (row.h, row.w, row.c)
                a = np.asarray(function(np.asarray(row.pixels, float).reshape(shape)), float)
                a = a[:, :, None] if not volume and a.ndim == 2 else a
                out.append((row.key, *a.shape, a.ravel()))
            yield pd.DataFrame(out, columns=["key", *(("d", "h", "w") if volume else ("h", "w", "c")), "pixels"])

    schema = VOLUME if volume else IMAGE
    return df.select(*[x.split()[0] for x in schema.split(", ")]).mapInPandas(run, schema)


# Pixel by pixel: plain columns


def pixelwise(df: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return df.withColumn("pixels", F.transform("pixels", f))


def with_bit_depth(df: DataFrame, depth: int = 8) -> DataFrame:
    """df with bit_depth, the range that savers and displays scale to; pixels stay from 0 to 1."""
    if depth not in (8, 12, 14, 16):
        raise OperatorError(f"no bit depth {depth}")
    return df.withColumn("bit_depth", F.lit(depth))


def with_scale(df: DataFrame, um_per_pixel: float = 1.0, known_distance: float = 0.0, distance_pixels: float = 0.0) -> DataFrame:
    """df with scale_um, micrometres a pixel: given, or a known distance over its pixels if both are."""
    scale = known_distance / distance_pixels if known_distance > 0 and distance_pixels > 0 else um_per_pixel
    if scale <= 0:
        raise OperatorError("a scale must be above 0")
    return df.withColumn("scale_um", F.lit(float(scale)))


def invert(df: DataFrame) -> DataFrame:
    return pixelwise(df, lambda x: 1 - x)


def gamma(df: DataFrame, gamma: float = 1.0, gain: float = 1.0) -> DataFrame:
    return pixelwise(df, lambda x: F.least(F.lit(1.0), F.lit(gain) * F.pow(x, F.lit(gamma))))


def brightness_contrast(df: DataFrame, low: float, high: float) -> DataFrame:
    return pixelwise(df, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low))))


def threshold(df: DataFrame, low: float, high: float = float("inf")) -> DataFrame:
    return pixelwise(df, lambda x: ((x >= low) & (x <= high)).cast("double"))


GRAY = {"rec601": (0.299, 0.587, 0.114), "rec709": (0.2125, 0.7154, 0.0721), "average": (1 / 3, 1 / 3, 1 / 3), "red": (1.0, 0.0, 0.0), "green": (0.0, 1.0, 0.0), "blue": (0.0, 0.0, 1.0)}


def to_gray(df: DataFrame, method: str = "rec601") -> DataFrame:
    r, g, b = GRAY[method]
    at = lambda k: F.element_at("pixels", k)
    gray = F.transform(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1), lambda i: at(i * 3 + 1) * r + at(i * 3 + 2) * g + at(i * 3 + 3) * b)
    return df.withColumn("pixels", F.when(F.col("c") == 3, gray).otherwise(F.col("pixels"))).withColumn("c", F.lit(1))


def split_channels(df: DataFrame) -> dict[str, DataFrame]:
    pick = lambda k: df.withColumn("pixels", F.transform(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1), lambda i: F.element_at("pixels", i * F.col("c") + k + 1))).withColumn("c", F.lit(1))
    return {"red": pick(0), "green": pick(1), "blue": pick(2)}


def merge_channels(red: DataFrame, green: DataFrame, blue: DataFrame) -> DataFrame:
    parts = [x.select("key", F.col("pixels").alias(n)) for x, n in ((green, "g"), (blue, "b"))]
    out = red.withColumnRenamed("pixels", "r").join(parts[0], "key").join(parts[1], "key")
    merged = F.flatten(F.transform(F.arrays_zip("r", "g", "b"), lambda x: F.array(x["r"], x["g"], x["b"])))
    return out.select("key", "h", "w", F.lit(3).alias("c"), merged.alias("pixels"))


IMAGE_MATH: dict[str, Callable[[Column, Column, float], Column]] = {
    "add": lambda a, b, v: F.least(F.lit(1.0), a + b), "subtract": lambda a, b, v: F.greatest(F.lit(0.0), a - b), "multiply": lambda a, b, v: a * b,
    "mask": lambda a, b, v: F.when(b > 0, a).otherwise(0.0), "and": lambda a, b, v: ((a > 0) & (b > 0)).cast("double"), "or": lambda a, b, v: ((a > 0) | (b > 0)).cast("double"),
    "max": lambda a, b, v: F.greatest(a, b), "min": lambda a, b, v: F.least(a, b), "blend": lambda a, b, v: a * v + b * (1 - v),
}


def image_math(a: DataFrame, b: DataFrame, operation: str, value: float = 0.5) -> DataFrame:
    """Two images of equal shape and key, pixel by pixel."""
    both = a.join(b.select("key", F.col("pixels").alias("_b")), "key")
    return both.withColumn("pixels", F.zip_with("pixels", "_b", lambda x, y: IMAGE_MATH[operation](x, y, value))).select(*a.columns)


# Neighbourhoods


def _shifted(a: np.ndarray, steps: tuple[int, ...], fill: float) -> np.ndarray:
    out = np.full_like(a, fill)
    src = tuple(slice(max(0, -s), a.shape[k] - max(0, s)) for k, s in enumerate(steps))
    dst = tuple(slice(max(0, s), a.shape[k] - max(0, -s)) for k, s in enumerate(steps))
    out[dst] = a[src]
    return out


def element(ndim: int, radius: int = 1, kind: str = "ball") -> list[tuple[int, ...]]:
    """Offsets of a structuring element: ball, cube or octahedron (cross)."""
    span = range(-radius, radius + 1)
    inside = {"ball": lambda o: sum(x * x for x in o) <= radius * radius, "cube": lambda o: True, "octahedron": lambda o: sum(map(abs, o)) <= radius}[kind]
    return [o for o in product(span, repeat=ndim) if inside(o)]


def dilated(a: np.ndarray, offsets: list[tuple[int, ...]]) -> np.ndarray:
    return np.max([_shifted(a, o, -np.inf) for o in offsets], 0)


def eroded(a: np.ndarray, offsets: list[tuple[int, ...]], border: float = np.inf) -> np.ndarray:
    return np.min([_shifted(a, o, border) for o in offsets], 0)


def _flat(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """f on each channel."""
    return lambda a: np.stack([f(a[:, :, k]) for k in range(a.shape[2])], 2)


def morphology(df: DataFrame, operation: str, iterations: int = 1, radius: int = 1, kind: str = "octahedron", volume: bool = False) -> DataFrame:
    """erode, dilate, open, close, white_tophat or black_tophat, for masks, gray images and volumes."""
    offsets = element(3 if volume else 2, radius, kind)

    def many(a, f, n=iterations):
        for _ in range(n):
            a = f(a, offsets)
        return a

    def run(a: np.ndarray) -> np.ndarray:
        opened = lambda x: many(many(x, eroded), dilated)
        closed = lambda x: many(many(x, dilated), eroded)
        return {"erode": lambda: many(a, eroded), "dilate": lambda: many(a, dilated), "open": lambda: opened(a), "close": lambda: closed(a), "white_tophat": lambda: a - opened(a), "black_tophat": lambda: closed(a) - a}[operation]()

    return _map(df, run if volume else _flat(run), volume)


def connected(mask: np.ndarray, connectivity: int | None = None) -> np.ndarray:
    """Labels from 1, in scan order, of connected regions; connectivity 4 or 8, in volumes 6, 18 or 26."""
    nd = mask.ndim
    near = {4: 1, 8: 2, 6: 1, 18: 2, 26: 3, None: nd}[connectivity]
    steps = [o for o in product((-1, 0, 1), repeat=nd) if 0 < sum(map(abs, o)) <= near]
    on = mask > 0
    label = np.where(on, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    parent = np.arange(mask.size + 1)
    big = mask.size + 1
    while True:
        low = label.copy()
        for o in steps:
            other = _shifted(np.where(on, label, big), o, big)
            low = np.where(on, np.minimum(low, other), 0)
        if (low == label).all():
            break
        np.minimum.at(parent, label[on], low[on])
        while (parent[parent] != parent).any():  # pointers double, so that long regions take few rounds
            parent = parent[parent]
        label = np.where(on, parent[low], 0)
    ids = np.unique(label[on])
    return np.where(on, np.searchsorted(ids, label) + 1, 0)


def label_regions(df: DataFrame, connectivity: int | None = None, volume: bool = False) -> DataFrame:
    f = lambda a: connected(a, connectivity)
    return _map(df, f if volume else lambda a: f(a[:, :, 0]), volume)


def remove_small(df: DataFrame, size: int = 500, connectivity: int | None = None, volume: bool = False, holes: bool = False) -> DataFrame:
    """Regions of at most `size` pixels go (holes: are filled)."""

    def run(a: np.ndarray) -> np.ndarray:
        target = 1 - (a > 0) if holes else a
        labels = connected(target, connectivity)
        small = np.bincount(labels.ravel()) <= size
        small[0] = False
        if holes:  # what touches the border is no hole
            edge = np.zeros(a.shape, bool)
            for k in range(a.ndim):
                for end in (0, -1):
                    edge[(slice(None),) * k + (end,)] = True
            small[np.unique(labels[edge])] = False
            return ((a > 0) | small[labels]).astype(float)
        return ((a > 0) & ~small[labels]).astype(float)

    return _map(df, run if volume else _flat(run), volume)


def fill_holes(df: DataFrame, volume: bool = False) -> DataFrame:
    """All holes, whatever their size."""
    return remove_small(df, 1 << 62, 6 if volume else 4, volume, True)


def _kernel(sigma: float) -> np.ndarray:
    r = max(1, int(4 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return k / k.sum()


def _along(a: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Correlation along an axis, the image mirrored at its border."""
    r = len(kernel) // 2
    pad = [(0, 0)] * a.ndim
    pad[axis] = (r, r)
    p = np.pad(a, pad, mode="symmetric")
    n = a.shape[axis]
    return sum(w * np.take(p, np.arange(k, k + n), axis) for k, w in enumerate(kernel))


def gaussian(df: DataFrame, sigma: float = 1.0, volume: bool = False, sigma_z: float | None = None) -> DataFrame:
    def run(a: np.ndarray) -> np.ndarray:
        for axis in range(a.ndim):
            s = sigma_z if volume and axis == 0 and sigma_z is not None else sigma
            a = _along(a, _kernel(s), axis) if s > 0 else a
        return a

    return _map(df, run if volume else _flat(run), volume)


EDGE_KERNELS = {"sobel": (1.0, 2.0, 1.0), "prewitt": (1.0, 1.0, 1.0)}


def edges(df: DataFrame, method: str = "sobel", sigma: float = 1.0) -> DataFrame:
    """Gradient magnitude by sobel or prewitt, or the laplacian of the smoothed image."""

    def run(a: np.ndarray) -> np.ndarray:
        if method == "laplacian":
            s = _along(_along(a, _kernel(sigma), 0), _kernel(sigma), 1)
            return sum(_along(s, np.array([1.0, -2.0, 1.0]), k) for k in range(2))
        smooth, slope = np.array(EDGE_KERNELS[method]), np.array([-1.0, 0.0, 1.0]) / 2
        smooth = smooth / smooth.sum()
        return np.sqrt(sum(_along(_along(a, slope, k), smooth, 1 - k) ** 2 for k in range(2)) / 2)

    return _map(df, _flat(run))


def distance(mask: np.ndarray, spacing: tuple[float, ...] | None = None) -> np.ndarray:
    """Euclidean distance of each pixel of the mask to the nearest pixel outside it, axis by axis (lower envelopes)."""
    spacing = spacing or (1.0,) * mask.ndim
    d = np.where(mask > 0, np.inf, 0.0)
    for axis in range(mask.ndim):
        n = d.shape[axis]
        rows = np.moveaxis(d, axis, -1).reshape(-1, n)
        gap = (np.subtract.outer(np.arange(n), np.arange(n)) * spacing[axis]) ** 2
        out = np.empty_like(rows)
        for k in range(0, len(rows), max(1, (1 << 22) // (n * n))):
            part = rows[k : k + max(1, (1 << 22) // (n * n))]
            out[k : k + len(part)] = (part[:, None, :] + gap[None]).min(2)
        d = np.moveaxis(out.reshape(np.moveaxis(d, axis, -1).shape), -1, axis)
    return np.sqrt(d)


def distance_ring(df: DataFrame, width: float, include_original: bool = False, volume: bool = False) -> DataFrame:
    """Pixels outside the mask and at most `width` from it."""

    def run(a: np.ndarray) -> np.ndarray:
        away = distance(1 - (a > 0))
        ring = (away <= width) & ((away > 0) | include_original)
        return ring.astype(float)

    return _map(df, run if volume else _flat(run), volume)


def resize(df: DataFrame, h: int, w: int) -> DataFrame:
    """Bilinear, pixel centres aligned."""

    def run(a: np.ndarray) -> np.ndarray:
        y, x = (np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1) for m, n in ((h, a.shape[0]), (w, a.shape[1])))
        y0, x0 = y.astype(int), x.astype(int)
        y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
        fy, fx = (y - y0)[:, None], (x - x0)[None]
        return a[y0][:, x0] * (1 - fy) * (1 - fx) + a[y1][:, x0] * fy * (1 - fx) + a[y0][:, x1] * (1 - fy) * fx + a[y1][:, x1] * fy * fx

    return _map(df, _flat(run))


def crop(df: DataFrame, top: int, left: int, bottom: int, right: int) -> DataFrame:
    return _map(df, lambda a: a[top:bottom, left:right])


def mirror(df: DataFrame, axis: str = "horizontal") -> DataFrame:
    turn = {"horizontal": lambda a: a[:, ::-1], "vertical": lambda a: a[::-1], "both": lambda a: a[::-1, ::-1]}[axis]
    return _map(df, turn)


def project(df: DataFrame, how: str = "max", axis: str = "z") -> DataFrame:
    """A volume as an image: largest, smallest or mean value along an axis."""
    k = "zyx".index(axis)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                a = getattr(np.asarray(r.pixels, float).reshape(r.d, r.h, r.w), how)(k)
                out.append((r.key, *a.shape, 1, a.ravel()))
            yield pd.DataFrame(out, columns=["key", "h", "w", "c", "pixels"])

    return df.mapInPandas(run, IMAGE)


# Tables from images


def pixel_table(df: DataFrame, value: str = "value") -> DataFrame:
    """(key, y, x, ch, value) of each pixel."""
    out = df.select("key", "w", "c", F.posexplode("pixels").alias("_i", value))
    at = F.col("_i")
    row = F.floor(at / F.col("c"))
    return out.select("key", F.floor(row / F.col("w")).cast("int").alias("y"), (row % F.col("w")).cast("int").alias("x"), (at % F.col("c")).cast("int").alias("ch"), value)


def region_properties(labels: DataFrame, intensity: DataFrame | None = None, min_area: int = 0) -> DataFrame:
    """(key, label, area, centroid_y, centroid_x, bounds, axes, eccentricity[, intensities]) of each region, by aggregates over pixels."""
    p = pixel_table(labels, "label").where("label > 0")
    measures = []
    if intensity is not None:
        p = p.join(pixel_table(intensity, "v").where("ch = 0").drop("ch"), ["key", "y", "x"])
        measures = [F.avg("v").alias("mean_intensity"), F.min("v").alias("min_intensity"), F.max("v").alias("max_intensity")]
    s = p.groupBy("key", F.col("label").cast("int").alias("label")).agg(
        F.count(F.lit(1)).alias("area"), F.avg("y").alias("centroid_y"), F.avg("x").alias("centroid_x"), F.min("y").alias("min_y"), F.min("x").alias("min_x"), (F.max("y") + 1).alias("max_y"), (F.max("x") + 1).alias("max_x"),
        F.var_pop("y").alias("vy"), F.var_pop("x").alias("vx"), F.covar_pop("y", "x").alias("vyx"), *measures,
    )
    a, b = F.col("vy") + 1 / 12, F.col("vx") + 1 / 12  # a pixel has a width
    root = F.sqrt(((a - b) / 2) ** 2 + F.col("vyx") ** 2)
    s = s.withColumns({"major_axis": 4 * F.sqrt((a + b) / 2 + root), "minor_axis": 4 * F.sqrt(F.greatest(F.lit(0.0), (a + b) / 2 - root))})
    s = s.withColumn("eccentricity", F.sqrt(1 - (F.col("minor_axis") / F.col("major_axis")) ** 2))
    return s.where(F.col("area") >= min_area).drop("vy", "vx", "vyx")


def image_statistics(df: DataFrame) -> DataFrame:
    """(key, ch, n, mean, std, min, max, median)."""
    return pixel_table(df).groupBy("key", "ch").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.median("value").alias("median"))


def histogram(df: DataFrame, bins: int = 256, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(key, ch, bin, count); values at the upper end fall into the last bin."""
    at = F.least(F.lit(bins - 1), F.floor((F.col("value") - low) / (high - low) * bins))
    return pixel_table(df).where(F.col("value").between(low, high)).groupBy("key", "ch", at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def otsu(df: DataFrame, bins: int = 256) -> DataFrame:
    """(key, threshold): the cut that parts the histogram into the two classes farthest apart; windows run over bins.

    Distances of classes are compared at 9 decimal places, so that sums which differ by rounding alone tie; ties go to the lower cut.
    """
    h = histogram(df, bins).groupBy("key", "bin").agg(F.sum("count").alias("n"))
    upto, whole = Window.partitionBy("key").orderBy("bin"), Window.partitionBy("key")
    center = (F.col("bin") + 0.5) / bins
    h = h.withColumns({"a": F.sum("n").over(upto), "sa": F.sum(F.col("n") * center).over(upto), "t": F.sum("n").over(whole), "st": F.sum(F.col("n") * center).over(whole)})
    gap = F.try_divide(F.col("sa"), F.col("a")) - F.try_divide(F.col("st") - F.col("sa"), F.col("t") - F.col("a"))
    h = h.withColumn("between", F.round(F.col("a") * (F.col("t") - F.col("a")) * gap * gap * 1e9))
    return h.groupBy("key").agg(F.min_by((F.col("bin") + 0.5) / bins, F.struct(-F.coalesce("between", F.lit(0.0)), "bin")).alias("threshold"))


def colocalization(first: DataFrame, second: DataFrame) -> DataFrame:
    """(key, n, pearson, moc, m1, m2, icq) of two images of one channel, with Otsu's cuts for m1 and m2."""
    p = pixel_table(first, "a").drop("ch").join(pixel_table(second, "b").drop("ch"), ["key", "y", "x"])
    p = p.join(otsu(first).withColumnRenamed("threshold", "ta"), "key").join(otsu(second).withColumnRenamed("threshold", "tb"), "key")
    means = p.groupBy("key").agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"))
    p = p.join(means, "key")
    return p.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.corr("a", "b").alias("pearson"), F.try_divide(F.sum(F.col("a") * F.col("b")), F.sqrt(F.sum(F.col("a") ** 2) * F.sum(F.col("b") ** 2))).alias("moc"),
        F.try_divide(F.sum(F.when(F.col("b") > F.col("tb"), F.col("a")).otherwise(0.0)), F.sum("a")).alias("m1"), F.try_divide(F.sum(F.when(F.col("a") > F.col("ta"), F.col("b")).otherwise(0.0)), F.sum("b")).alias("m2"),
        (F.avg((((F.col("a") - F.col("ma")) * (F.col("b") - F.col("mb"))) > 0).cast("double")) - 0.5).alias("icq"),
    )


def glcm(df: DataFrame, distance: int = 1, levels: int = 64) -> DataFrame:
    """(key, contrast, dissimilarity, homogeneity, energy, asm, correlation): means over four angles of co-occurring levels."""
    p = pixel_table(df).where("ch = 0").select("key", "y", "x", F.least(F.lit(levels - 1), F.floor(F.col("value") * levels)).cast("int").alias("i"))
    d = distance
    # Offsets of the angles 0, 45, 90 and 135 degrees.
    steps = F.array(*(F.struct(F.lit(k).alias("angle"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for k, (dy, dx) in enumerate([(0, d), (d, d), (d, 0), (d, -d)])))
    sent = p.withColumn("s", F.explode(steps)).select("key", "s.angle", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "i")
    c = sent.join(p.withColumnRenamed("i", "j"), ["key", "y", "x"]).groupBy("key", "angle", "i", "j").agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("key", "angle")))
    i, j, w = F.col("i").cast("double"), F.col("j").cast("double"), F.col("p")
    s = c.groupBy("key", "angle").agg(F.sum(w * (i - j) ** 2).alias("contrast"), F.sum(w * F.abs(i - j)).alias("dissimilarity"), F.sum(w / (1 + (i - j) ** 2)).alias("homogeneity"), F.sum(w * w).alias("asm"), F.sum(w * i).alias("mi"), F.sum(w * j).alias("mj"), F.sum(w * i * i).alias("ii"), F.sum(w * j * j).alias("jj"), F.sum(w * i * j).alias("ij"))
    spread = F.sqrt((F.col("ii") - F.col("mi") ** 2) * (F.col("jj") - F.col("mj") ** 2))
    s = s.withColumns({"energy": F.sqrt("asm"), "correlation": F.coalesce(F.try_divide(F.col("ij") - F.col("mi") * F.col("mj"), spread), F.lit(1.0))})
    return s.groupBy("key").agg(*(F.avg(x).alias(x) for x in ("contrast", "dissimilarity", "homogeneity", "energy", "asm", "correlation")))


def select_regions(labels: DataFrame, properties: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """A mask of the regions whose properties hold all rules (column, operator, value)."""
    tests = {">": lambda c, v: c > v, "<": lambda c, v: c < v, ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v, "=": lambda c, v: c == v, "!=": lambda c, v: c != v}
    kept = properties
    for column, op, value in rules:
        kept = kept.where(tests[op](F.col(column), value))
    ids = kept.groupBy("key").agg(F.collect_set(F.col("label").cast("double")).alias("_ids"))  # the regions of one image
    out = labels.join(ids, "key", "left")
    return out.withColumn("pixels", F.transform("pixels", lambda x: F.coalesce(F.array_contains("_ids", x), F.lit(False)).cast("double"))).drop("_ids").select(*labels.columns)
