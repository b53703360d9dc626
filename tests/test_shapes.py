import numpy as np
import pytest

from labquarry.operators import images as im
from labquarry.operators import shapes as sh


def one(df):
    r = df.first()
    return np.asarray(r["pixels"]).reshape(r["h"], r["w"], r["c"])[:, :, 0]


def disc(n, y, x, r):
    v, u = np.mgrid[:n, :n]
    return ((v - y) ** 2 + (u - x) ** 2 <= r * r).astype(float)


def test_skeleton_and_watershed(spark):
    bar = np.zeros((11, 25))
    bar[3:8, 3:22] = 1
    thin = one(sh.skeletonize(im.from_arrays(spark, {"a": bar})))
    assert 0 < thin.sum() < 25 and (thin <= bar).all() and thin.sum(0).max() <= 2
    line = np.zeros((5, 9))
    line[2, 1:8] = 1
    s = sh.skeleton_statistics(im.from_arrays(spark, {"a": line})).first()
    assert (s["pixels"], s["ends"], s["junctions"]) == (7, 2, 0)
    two = np.maximum(disc(40, 14, 12, 9), disc(40, 26, 27, 9))
    labels = one(sh.watershed(im.from_arrays(spark, {"a": two}), 6))
    assert set(np.unique(labels)) == {0, 1, 2} and labels[14, 12] != labels[26, 27] and ((labels > 0) == (two > 0)).all()


def test_edges_lines_circles_blobs(spark):
    step = np.zeros((20, 20))
    step[:, 10:] = 1
    e = one(sh.canny(im.from_arrays(spark, {"a": step})))
    assert e[5:15].sum(1).tolist() == [1.0] * 10 and set(np.nonzero(e[10])[0]) <= {9, 10}
    line = np.zeros((30, 30))
    line[12] = 1
    best = sh.hough_lines(im.from_arrays(spark, {"a": line})).orderBy("votes", ascending=False).first()
    assert best["votes"] == 30 and abs(best["angle"]) == pytest.approx(np.pi / 2) and abs(best["offset"]) == 12
    t = np.linspace(0, 2 * np.pi, 200)
    ring = np.zeros((40, 40))
    ring[np.round(20 + 9 * np.sin(t)).astype(int), np.round(18 + 9 * np.cos(t)).astype(int)] = 1
    c = sh.hough_circles(im.from_arrays(spark, {"a": ring}), 7, 11).first()
    assert (c["y"], c["x"], c["radius"]) == (20, 18, 9)
    b = sh.blobs(im.from_arrays(spark, {"a": disc(41, 20, 22, 5)}), 2, 10).orderBy("strength", ascending=False).first()
    assert abs(b["y"] - 20) <= 1 and abs(b["x"] - 22) <= 1 and 3 < b["radius"] < 8


def test_thresholds_and_colors(spark):
    rng = np.random.default_rng(0)
    a = rng.choice([0.1, 0.5, 0.9], (20, 20))
    cuts = sh.multi_otsu(im.from_arrays(spark, {"a": a}), 3, 32).first()["thresholds"]
    assert 0.1 <= cuts[0] < 0.5 <= cuts[1] < 0.9
    local = one(sh.threshold_local(im.from_arrays(spark, {"a": np.linspace(0, 1, 900).reshape(30, 30) + disc(30, 15, 15, 2)}), 13))
    assert local[15, 15] == 1 and local[5, 5] in (0, 1)
    assert one(sh.equalize(im.from_arrays(spark, {"a": a}))).max() <= 1
    rgb = np.zeros((2, 3, 3))
    rgb[0] = (1, 0, 0)
    rgb[1] = (0, 0, 1)
    assert one(sh.hsv_mask(im.from_arrays(spark, {"a": rgb}), (0.9, 0.1), (0.5, 1))).tolist() == [[1] * 3, [0] * 3]
    m = np.array(sh.STAINS["hematoxylin_eosin"])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    amounts = rng.random((3, 4, 3))
    parts = sh.color_deconvolution(im.from_arrays(spark, {"a": np.exp(-amounts @ m)}))
    assert np.allclose(one(parts["ch2"]), amounts[:, :, 1])


def test_geometry(spark):
    a = np.random.default_rng(1).random((6, 6))
    assert np.allclose(one(sh.rotate(im.from_arrays(spark, {"a": a}), 180)), a[::-1, ::-1])
    c = sh.contours(im.from_arrays(spark, {"a": disc(12, 5, 5, 3)})).collect()
    assert {r["contour"] for r in c} == {1} and c[0]["area"] == disc(12, 5, 5, 3).sum()
    p = [r["value"] for r in sh.line_profile(im.from_arrays(spark, {"a": a}), 0, 0, 0, 5).orderBy("step").collect()]
    assert np.allclose(p, a[0])
    assert one(sh.bandpass(im.from_arrays(spark, {"a": np.ones((8, 8))}))).std() < 1e-12
