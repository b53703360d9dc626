import numpy as np
import pytest
from pyspark.sql import functions as F

from labquarry.functions import special
from labquarry.operators import cells, figures, images, mixed, molecules
from labquarry.operators import statistics as s
from labquarry.operators import tracking as tr
from labquarry.operators.tabular import OperatorError


# Published upper 5 % and 1 % points of the studentized range.
@pytest.mark.parametrize(("q", "k", "df", "p"), [(3.877, 3, 10, 0.05), (3.578, 3, 20, 0.05), (4.102, 5, 30, 0.05), (3.314, 3, 1e6, 0.05), (5.270, 3, 10, 0.01), (17.97, 2, 1, 0.05)])
def test_studentized_range(q, k, df, p):
    assert float(special.range_sf(q, k, df)[0]) == pytest.approx(p, rel=2e-3)


def test_two_means_are_a_t_test(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 4, 7)] + [("b", float(x)) for x in (3, 6, 8)] + [("c", None), (None, 1.0)], "g string, v double")
    tukey, t = s.tukey(df, "v", "g").first(), s.pairwise_t(df, "v", "g", "student").first()
    assert tukey["p"] == pytest.approx(t["p"], rel=1e-6) and tukey["q"] == pytest.approx(abs(t["statistic"]) * 2**0.5)


def test_fisher_z(spark):
    rows = [("a", 0.9)] * 10 + [("b", 0.5)] * 8 + [("c", 0.1)] * 3 + [("d", 1.0)] * 5
    got = {(r["group1"], r["group2"]): r for r in s.fisher_z(spark.createDataFrame(rows, "g string, r double"), "r", "g").collect()}
    z = (np.arctanh(0.9) - np.arctanh(0.5)) / np.sqrt(1 / 7 + 1 / 5)
    assert got["a", "b"]["z"] == pytest.approx(z) and got["a", "b"]["p"] == pytest.approx(2 * float(special.normal_sf(z)))
    assert got["a", "c"]["z"] is None and got["a", "c"]["p_adj"] is None and np.isfinite(got["a", "d"]["z"])


def dense(y, x, g, ratio, reml):
    v = np.eye(len(y)) + ratio * (g[:, None] == g[None, :])
    i = np.linalg.inv(v)
    a = x.T @ i @ x
    b = np.linalg.solve(a, x.T @ i @ y)
    r = y - x @ b
    free = len(y) - x.shape[1] if reml else len(y)
    scale = r @ i @ r / free
    value = free * np.log(2 * np.pi * scale) + free + np.linalg.slogdet(v)[1] + (np.linalg.slogdet(a)[1] if reml else 0)
    effects = np.array([ratio * (i @ r)[g == k].sum() for k in np.unique(g)])
    return -value / 2, b, np.sqrt(np.diag(np.linalg.inv(a)) * scale), scale, effects


@pytest.mark.parametrize("reml", [True, False])
def test_mixed_like_dense_matrices(spark, reml):
    rng = np.random.default_rng(4)
    g = np.repeat(np.arange(12), rng.integers(1, 9, 12))
    x = rng.normal(50, 2, len(g))
    y = 3 + 0.7 * x + rng.normal(0, 1.5, 12)[g] + rng.normal(0, 1, len(g))
    rows = [(int(a), float(b), float(c)) for a, b, c in zip(g, x, y, strict=True)] + [(1, None, 2.0), (None, 1.0, 2.0)]
    got = mixed.mixed_effects(spark.createDataFrame(rows, "g long, x double, y double"), "y", ["x"], "g", reml)
    summary, fixed = got["summary"].first(), got["fixed_effects"].collect()
    ratio = summary["var_random_intercept"] / summary["var_residual"]
    value, b, error, scale, effects = dense(y, np.column_stack([np.ones(len(x)), x]), g, ratio, reml)
    assert summary["log_likelihood"] == pytest.approx(value, abs=1e-7) and summary["var_residual"] == pytest.approx(scale, rel=1e-7)
    assert [r["coefficient"] for r in fixed] == pytest.approx(b.tolist(), rel=1e-7) and [r["std_error"] for r in fixed] == pytest.approx(error.tolist(), rel=1e-6)
    assert [r["intercept"] for r in got["random_effects"].orderBy("group").collect()] == pytest.approx(effects.tolist(), abs=1e-7)
    best = max(dense(y, np.column_stack([np.ones(len(x)), x]), g, r, reml)[0] for r in np.geomspace(1e-3, 1e3, 400))
    assert summary["log_likelihood"] >= best - 1e-9 and summary["n_obs"] == len(g) and summary["n_groups"] == 12


def test_mixed_without_groups_apart(spark):
    rows = [(k % 4, float(k // 4), float(k // 4) * 2 + (1 if k % 8 < 4 else -1)) for k in range(40)]
    got = mixed.mixed_effects(spark.createDataFrame(rows, "g long, x double, y double"), "y", ["x"], "g")
    assert got["summary"].first()["var_random_intercept"] == 0.0 and {r["intercept"] for r in got["random_effects"].collect()} == {0.0}
    with pytest.raises(OperatorError):
        mixed.mixed_effects(spark.createDataFrame([], "g long, x double, y double"), "y", ["x"], "g")


def test_displacement_counts_points_not_frames(spark):
    rows = [(1, f, float(k), 0.0) for k, f in enumerate([0, 1, 5, 9, 10])] + [(2, f, 0.0, 0.0) for f in range(3)] + [(-1, 0, 9.0, 9.0), (None, 1, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "track_id long, frame long, centroid_x double, centroid_y double")
    got = {(r["track_id"], r["lag"]): (r["msd"], r["n"]) for r in tr.mean_squared_displacement(df, per_track=True).collect()}
    assert got == {(1, 1): (1.0, 4), (1, 2): (4.0, 3), (2, 1): (0.0, 2), (2, 2): (0.0, 1)}
    assert tr.mean_squared_displacement(df.limit(0)).count() == 0
    assert tr.trajectories(df).count() == 6 and tr.trajectories(df, tail_frames=2).count() == 2
    assert sorted(r["color"] for r in tr.trajectories(df, "speed").where("track_id = 1").collect()) == [0.25, 0.25, 1.0, 1.0]


def test_figures_of_odd_tables(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a"), (1.0, None, "b"), (1.0, 5.0, None)], "x double, y double, h string")
    got = figures.joint(df, "x", "y", 4, "h")
    assert got["points"].count() == 2 and sorted(tuple(r) for r in got["cells"].collect()) == [(0, 0, 1), (0, 3, 1)]
    assert figures.joint(df.limit(0), "x", "y")["cells"].count() == 0
    assert figures.regression_scatter(df, "x", "y")["fit"].first()["r2"] == 0.0
    assert figures.cluster_scatter(df, "x", "y")["centers"].count() == 1
    assert set(figures.double_variable(df, "h", "y", "box")) == {"boxes"}
    with pytest.raises(OperatorError):
        figures.double_variable(df, "x", "y", "pie")


def test_cells(spark):
    df = spark.createDataFrame([("a", 2.0, 1.0, 8.0, None), ("a", 4.0, 2.0, 8.0, None), ("b", 3.0, None, 0.0, 2.0), ("c", None, None, None, None)], "cell string, filopodia_length_px double, filopodia_length_um double, edge_length_px double, edge_length_um double")
    got = {r["cell_key"]: r for r in cells.filopodia_summary(df, "cell").collect()}
    assert got["a"]["density"] == 0.25 and got["b"]["density"] == 0.5 and got["c"]["density"] == 0.0
    assert got["a"]["mean_length_px"] == 3.0 and got["c"]["mean_length_px"] is None and got["c"]["total_length_px"] == 0.0
    none = cells.filopodia_summary(df.limit(0)).first()
    assert none["filopodia_count"] == 0 and none["density"] == 0.0 and none["mean_length_um"] is None


def test_metadata(spark):
    df = images.from_arrays(spark, {"a": np.zeros((2, 2))})
    assert images.with_scale(df, known_distance=5, distance_pixels=10).first()["scale_um"] == 0.5
    for wrong in (lambda: images.with_scale(df, -1), lambda: images.with_bit_depth(df, 10)):
        with pytest.raises(OperatorError):
            wrong()


def test_molecule_tables(spark):
    df = spark.createDataFrame([("x", "CCO", 1), ("y", "C[C", 2), (None, " CCO ", 3), ("z", None, 4), ("w", "not smiles", 5), ("v", "C/C=C\\C", 6)], "id string, smiles string, p long")
    assert sorted(map(tuple, molecules.from_table(df, properties=["p"]).collect()), key=str) == [("v", "C/C=C\\C", 6), ("x", "CCO", 1), (None, "CCO", 3)]
    numbered = molecules.from_table(df, name=None)
    assert sorted(r["name"] for r in numbered.collect()) == ["Mol_1", "Mol_2", "Mol_3"]
    assert molecules.nth_molecule(numbered, 2)["name"] is not None and molecules.nth_molecule(numbered, 2).first()["name"] == "Mol_3"
    for row in (-1, 3):
        with pytest.raises(OperatorError):
            molecules.nth_molecule(numbered, row)


def dense_slope(y, x, z, g, psi, reml):
    """Log likelihood, coefficients, errors, residual variance and effects of intercept and slope, by n x n matrices."""
    n, p = x.shape
    v = np.eye(n)
    for k in np.unique(g):
        own = np.where(g == k)[0]
        v[np.ix_(own, own)] += z[own] @ psi @ z[own].T
    i = np.linalg.inv(v)
    a = x.T @ i @ x
    b = np.linalg.solve(a, x.T @ i @ y)
    r = y - x @ b
    free = n - p if reml else n
    scale = r @ i @ r / free
    value = free * np.log(2 * np.pi * scale) + free + np.linalg.slogdet(v)[1] + (np.linalg.slogdet(a)[1] if reml else 0)
    effects = np.array([psi @ z[g == k].T @ (i @ r)[g == k] for k in np.unique(g)])
    return -value / 2, b, np.sqrt(np.diag(np.linalg.inv(a)) * scale), scale, effects


@pytest.mark.parametrize("reml", [True, False])
def test_random_slope_like_dense_matrices(spark, reml):
    rng = np.random.default_rng(9)
    g = np.repeat(np.arange(10), 6)
    x, w = rng.normal(20, 3, 60), rng.normal(0, 1, 60)
    y = 3 + 0.7 * x - w + rng.normal(0, 2, 10)[g] + rng.normal(0, 0.6, 10)[g] * (x - 20) + rng.normal(0, 1, 60)
    rows = [(int(a), float(b), float(c), float(d)) for a, b, c, d in zip(g, x, w, y, strict=True)] + [(1, None, 0.0, 2.0), (None, 1.0, 0.0, 2.0)]
    got = mixed.mixed_effects(spark.createDataFrame(rows, "g long, x double, w double, y double"), "y", ["x", "w"], "g", reml, slope="x")
    one, fixed = got["summary"].first(), got["fixed_effects"].collect()
    psi = np.array([[one["var_random_intercept"], one["cov_random"]], [one["cov_random"], one["var_random_slope"]]]) / one["var_residual"]
    design, z = np.column_stack([np.ones(60), x, w]), np.column_stack([np.ones(60), x])
    value, b, error, scale, effects = dense_slope(y, design, z, g, psi, reml)
    assert one["log_likelihood"] == pytest.approx(value, abs=1e-6) and one["var_residual"] == pytest.approx(scale, rel=1e-6)
    assert [r["coefficient"] for r in fixed] == pytest.approx(b.tolist(), rel=1e-6) and [r["std_error"] for r in fixed] == pytest.approx(error.tolist(), rel=1e-6)
    own = got["random_effects"].orderBy("group").collect()
    assert np.allclose([(r["intercept"], r["slope"]) for r in own], effects, atol=1e-5) and one["n_obs"] == 60 and one["n_groups"] == 10
    root = np.linalg.cholesky(psi)
    for size in (1e-3, 1e-2, 0.1, 0.5):
        for _ in range(100):
            near = root @ (np.eye(2) + rng.normal(0, size, (2, 2)))
            assert dense_slope(y, design, z, g, near @ near.T, reml)[0] <= value + 1e-6


def test_random_slope_at_the_edge(spark):
    """Groups that do not differ: both variances near 0, the line that of least squares; a column that does not vary is refused."""
    rows = [(k % 4, float(k // 4), float(k // 4) * 2 + (1 if k % 8 < 4 else -1)) for k in range(40)]
    df = spark.createDataFrame(rows, "g long, x double, y double")
    got = mixed.mixed_effects(df, "y", ["x"], "g", slope="x")
    one = got["summary"].first()
    assert one["var_random_intercept"] < 1e-3 and one["var_random_slope"] < 1e-3 and one["log_likelihood"] >= mixed.mixed_effects(df, "y", ["x"], "g")["summary"].first()["log_likelihood"] - 1e-6
    with pytest.raises(OperatorError):
        mixed.mixed_effects(df.withColumn("x", F.lit(2.0)), "y", ["x"], "g", slope="x")
    with pytest.raises(OperatorError):
        mixed.mixed_effects(df.limit(0), "y", ["x"], "g", slope="x")
