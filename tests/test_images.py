import numpy as np
import pytest

from labquarry.operators import images as im


def arrays(df):
    return {r["key"]: np.asarray(r["pixels"]).reshape(r["h"], r["w"], r["c"])[:, :, 0] for r in df.collect()}


@pytest.fixture(scope="module")
def masks():
    m = np.zeros((9, 11))
    m[1:5, 1:5] = 1
    m[2, 2] = 0
    m[6, 8], m[7, 9] = 1, 1
    return {"m": m, "empty": np.zeros((4, 4))}


def test_morphology(spark, masks):
    df = im.from_arrays(spark, masks)
    assert arrays(im.morphology(df, "dilate"))["m"].sum() > masks["m"].sum() > arrays(im.morphology(df, "erode"))["m"].sum()
    opened = arrays(im.morphology(df, "open"))["m"]
    assert (opened <= masks["m"]).all() and opened[6, 8] == 0
    assert arrays(im.fill_holes(df))["m"][2, 2] == 1
    assert arrays(im.remove_small(df, 2))["m"].sum() == 15


def test_labels_and_properties(spark, masks):
    df = im.from_arrays(spark, masks)
    assert arrays(im.label_regions(df, 8))["m"].max() == 2 and arrays(im.label_regions(df, 4))["m"].max() == 3
    labels = im.label_regions(df, 8)
    p = {(r["key"], r["label"]): r for r in im.region_properties(labels).collect()}
    assert p["m", 1]["area"] == 15 and (p["m", 1]["min_y"], p["m", 1]["max_x"]) == (1, 5) and p["m", 2]["centroid_y"] == 6.5
    big = im.select_regions(labels, im.region_properties(labels), [("area", ">", 3)])
    assert arrays(big)["m"].sum() == 15 and arrays(big)["empty"].sum() == 0


def test_distance_and_ring(spark):
    m = np.zeros((7, 7))
    m[3, 3] = 1
    want = np.sqrt(np.add.outer((np.arange(7) - 3) ** 2, (np.arange(7) - 3) ** 2))
    assert np.allclose(im.distance(1 - m), want)
    assert arrays(im.distance_ring(im.from_arrays(spark, {"a": m}), 1.0))["a"].sum() == 4


def test_pixels_and_filters(spark):
    rng = np.random.default_rng(0)
    a = rng.random((8, 6))
    df = im.from_arrays(spark, {"a": a})
    assert np.allclose(arrays(im.invert(df))["a"], 1 - a)
    assert np.allclose(arrays(im.image_math(df, im.invert(df), "add"))["a"], 1)
    assert arrays(im.gaussian(df, 2.0))["a"].std() < a.std()
    assert np.allclose(arrays(im.edges(im.from_arrays(spark, {"c": np.ones((5, 5))})))["c"], 0)
    rgb = rng.random((4, 5, 3))
    color = im.from_arrays(spark, {"k": rgb})
    assert np.allclose(arrays(im.to_gray(color, "average"))["k"], rgb.mean(2))
    parts = im.split_channels(color)
    assert np.allclose(arrays(parts["green"])["k"], rgb[:, :, 1])
    merged = im.merge_channels(parts["red"], parts["green"], parts["blue"]).first()
    assert np.allclose(merged["pixels"], rgb.ravel())
    assert np.allclose(arrays(im.mirror(df))["a"], a[:, ::-1]) and arrays(im.resize(df, 4, 3))["a"].shape == (4, 3)


def test_measures(spark):
    rng = np.random.default_rng(1)
    a = np.concatenate([rng.normal(0.2, 0.03, 200), rng.normal(0.8, 0.03, 200)]).clip(0, 1).reshape(20, 20)
    df = im.from_arrays(spark, {"a": a})
    assert 0.25 < im.otsu(df).first()["threshold"] < 0.75
    s = im.image_statistics(df).first()
    assert s["mean"] == pytest.approx(a.mean()) and s["std"] == pytest.approx(a.std())
    assert sum(r["count"] for r in im.histogram(df, 16).collect()) == 400
    c = im.colocalization(df, im.invert(df)).first()
    assert c["pearson"] == pytest.approx(-1) and c["icq"] < 0
    g = im.glcm(im.from_arrays(spark, {"b": np.tile([0.0, 0.99], (6, 3))}), 1, 2).first()
    assert g["contrast"] == pytest.approx(0.75) and g["dissimilarity"] == pytest.approx(0.75)


def test_volumes(spark):
    v = np.arange(24, dtype=float).reshape(2, 3, 4)
    df = im.volumes_from_arrays(spark, {"v": v})
    assert np.allclose(arrays(im.project(df, "max", "z"))["v"], v.max(0)) and np.allclose(arrays(im.project(df, "mean", "x"))["v"], v.mean(2))
    labels = im.label_regions(im.volumes_from_arrays(spark, {"v": (v % 2 == 0).astype(float)}), 6, True).first()
    assert max(labels["pixels"]) == 2
