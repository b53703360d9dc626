"""Cases that were once answered wrongly, and running sums without a hot task."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labquarry.operators import advanced, evaluation, images, molecules, neighbours, running, screening, shapes, statistics, tabular, tracking


def test_pairs_at_the_threshold(spark):
    """0.55 * 100 rounds up past 55 in floating point: the pair shares exactly 55 of 100 bits."""
    rows = [(0, [1.0 if i < 100 else 0.0 for i in range(128)]), (1, [1.0 if 45 <= i < 100 else 0.0 for i in range(128)])]
    df = spark.createDataFrame(rows, "k long, v array<double>").select("k", neighbours.bits(F.col("v")).alias("fp"))
    assert [tuple(r) for r in neighbours.similarity_pairs(df, "k", "fp", 128, 0.55).collect()] == [(0, 1, 0.55)]


def test_least_overlap_for_all_sizes():
    """The prefix's arithmetic, in plain numbers: the smallest overlap whose share reaches the threshold."""
    for x in range(1, 2049, 7):
        for least in (h / 100 for h in range(1, 101)):
            up = int(np.ceil(x * least))
            up = up - 1 if (up - 1) / x >= least else up
            assert up <= min(o for o in (up - 1, up, up + 1, up + 2) if o / x >= least)


def test_pairs_like_brute_force(spark):
    rng = np.random.default_rng(5)
    x = (rng.random((120, 70)) < 0.3).astype(float)
    x[40:60] = x[3]
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "k long, v array<double>").select("k", neighbours.bits(F.col("v")).alias("fp"))
    got = {(r["a"], r["b"]): r["similarity"] for r in neighbours.similarity_pairs(df, "k", "fp", 70, 0.4).collect()}
    both, size = x @ x.T, x.sum(1)
    want = {(a, b): both[a, b] / (size[a] + size[b] - both[a, b]) for a in range(120) for b in range(a + 1, 120)}
    assert got == {k: v for k, v in want.items() if v >= 0.4}


def test_backgrounds_of_files_of_one_name(spark):
    cells = spark.createDataFrame([("neg", "F1", 1, 10.0), ("pos", "F1", 1, 10.0)], "`group` string, file_stem string, cell int, v double")
    background = spark.createDataFrame([("neg", "F1", 1.0), ("pos", "F1", 5.0)], "`group` string, file_stem string, v double")
    out = screening.blank_normalize(cells, background, "v", normalize=False)
    assert {r["group"]: r["v"] for r in out.collect()} == {"neg": 9.0, "pos": 5.0}


def test_rule_sets():
    assert ("mol_weight", "<=", 300) in molecules.DRUG_LIKENESS["lead_like"] and len(molecules.DRUG_LIKENESS) == 10
    assert ("molar_refractivity", ">", 40) in molecules.DRUG_LIKENESS["ghose"] and ("n_atoms", ">", 20) in molecules.DRUG_LIKENESS["ghose"]


@pytest.mark.parametrize("name", sorted(shapes.STAINS))
def test_stains_can_be_told_apart(name):
    m = shapes.stain_matrix(name)
    assert np.allclose(np.linalg.norm(m, axis=1), 1) and abs(np.linalg.det(m)) > 1e-3
    if not np.any(shapes.STAINS[name][2]):
        assert np.allclose(m[:2] @ m[2], 0, atol=1e-12)


def test_running_sums(spark):
    rows = [(k % 3, k, k * k % 17) for k in range(500)]
    df = spark.createDataFrame(rows, "g int, o int, v long")
    got = running.accumulated(df, "o", {"s": "v"}, ["g"]).orderBy("g", "o").collect()
    for g in range(3):
        own = [r for r in got if r["g"] == g]
        assert [r["s"] for r in own] == np.cumsum([r["v"] for r in own]).tolist()
    down = running.accumulated(df, "o", {"s": "v"}, descending=True).orderBy(F.desc("o")).collect()
    assert [r["s"] for r in down] == np.cumsum([r["v"] for r in down]).tolist()
    assert running.accumulated(df.limit(0), "o", {"s": "v"}).count() == 0


def test_no_window_over_all_values(spark):
    """Curves and ranks: every window has a key beside the order."""
    df = spark.createDataFrame([(k % 2, float(k * 7 % 101)) for k in range(300)], "y int, s double")
    ranks = statistics.ranked(df.select(F.col("s").alias("v")), [])
    for out in (evaluation.roc_curve(df, "y", "s"), evaluation.roc_auc(df, "y", "s"), evaluation.average_precision(df, "y", "s"), ranks):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert all("_part" in w or "windowspecdefinition(1," in w for w in windows), windows


def test_areas_and_rank_correlations_need_no_task_of_all_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(["a", "a", "b", None][k % 4], float(rng.integers(0, 900)), float(rng.integers(0, 40))) for k in range(3000)]
    rows += [("a", 5.0, 7.0)] * 400 + [("c", 1.0, 2.0), ("d", 1.0, None), ("d", None, 1.0), ("e", 2.0, 2.0), ("e", 2.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")

    def area(own):
        own = sorted((x, y) for x, y in own if x is not None and y is not None)
        return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(own, own[1:])) if len(own) > 1 else None

    whole = tabular.aggregate(df, "auc", None, ["y"], "x")
    assert whole.first()["y"] == pytest.approx(area([r[1:] for r in rows]))
    got = {r["g"]: r["y"] for r in tabular.aggregate(df, "auc", ["g"], ["y"], "x").collect()}
    want = {g: area([r[1:] for r in rows if r[0] == g]) for g in "abcde"}
    assert set(got) == set(want) and all(got[g] == (None if want[g] is None else pytest.approx(want[g])) for g in want) and got["e"] == 0.0 and got["c"] is None
    pairs = statistics.correlations(df.where("y is not null and x is not null"), ["x", "y"], "spearman")
    frame = pd.DataFrame([r for r in rows if None not in r[1:]], columns=["g", "x", "y"])
    found = {(r["a"], r["b"]): r["value"] for r in pairs.collect()}
    assert found["x", "y"] == pytest.approx(frame["x"].rank().corr(frame["y"].rank()), abs=1e-9)
    for out, values in ((whole, ("_x", "x")), (pairs, ("_c0", "_c1"))):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window" in line]
        assert windows and all("_part" in w for w in windows)


def test_equal_cuts_go_to_the_lower_one(spark):
    """A histogram and its mirror image: two cuts part it equally well, but for the rounding of their sums."""
    tied = 0
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for k in range(300):
        half = rng.integers(1, 127, 4)
        bins = np.sort(np.concatenate([half, 255 - half]))
        rows.append((str(k), 1, 8, [float((b + 0.5) / 256) for b in bins]))
        best = {}
        for cut in sorted(set(bins.tolist()))[:-1]:
            low, high = bins[bins <= cut], bins[bins > cut]
            best[cut] = round(len(low) * len(high) * float(low.mean() - high.mean()) ** 2 / 65536, 7)
        tops = [c for c, v in best.items() if v == max(best.values())]
        tied += len(tops) > 1
        want[str(k)] = (tops[0] + 0.5) / 256
    df = spark.createDataFrame([(k, h, w, 1, p) for k, h, w, p in rows], "key string, h int, w int, c int, pixels array<double>")
    assert {r["key"]: r["threshold"] for r in images.otsu(df).collect()} == want and tied > 20


def test_corrections_of_many_tests(spark):
    """200,000 tests, most of them tied with others: no sum over all tests for each of them, no window over all tests."""
    n = 200_000
    p = np.arange(n) * 7919 % 50_021 / 50_021 + 1e-6
    df = spark.createDataFrame(pd.DataFrame({"t": np.arange(n), "p": p})).unionByName(spark.createDataFrame([(-1, None)], "t long, p double"))
    order = np.sort(p)
    i = np.searchsorted(order, order, "right")
    steps = n / i * np.sum(1 / np.arange(1, n + 1)) * order
    want = dict(zip(order.tolist(), np.minimum(np.minimum.accumulate(steps[::-1])[::-1], 1).tolist()))
    out = statistics.adjusted(df, "p", "fdr_by")
    windows = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line]
    assert all("_part" in w or "windowspecdefinition(1," in w for w in windows), windows
    got = out.toPandas().set_index("t")
    assert len(got) == n + 1 and np.isnan(got.loc[-1, "p_adj"])
    assert np.allclose(got.loc[:, "p_adj"].drop(-1).sort_index(), [want[x] for x in p.tolist()], rtol=1e-9)


def test_running_extremes(spark):
    values = [(k, k * 31 % 97) for k in range(400)]
    df = spark.createDataFrame(values, "o int, v int")
    v = [x[1] for x in values]
    assert [r["s"] for r in running.accumulated(df, "o", {"s": "v"}, how="max").orderBy("o").collect()] == np.maximum.accumulate(v).tolist()
    down = running.accumulated(df, "o", {"s": "v"}, descending=True, how="min").orderBy(F.desc("o")).collect()
    assert [r["s"] for r in down] == np.minimum.accumulate(v[::-1]).tolist()


def test_displacements_send_each_point_twice(spark):
    """Pairs by blocks of places: every lag is there, and no point is sent once for each lag."""
    rng = np.random.default_rng(7)
    rows = [(t, f, float(rng.integers(0, 50)), float(rng.integers(0, 50))) for t, n in enumerate([1, 2, 9, 40, 41, 90]) for f in range(n)]
    df = spark.createDataFrame(rows, "track_id int, frame int, centroid_x double, centroid_y double")
    for most in (1, 2, 7, 50):
        want = {}
        for t in range(6):
            own = np.array([r[2:] for r in rows if r[0] == t])
            for lag in range(1, min(most, len(own) - 1) + 1):
                square = ((own[lag:] - own[:-lag]) ** 2).sum(1)
                want[t, lag] = (pytest.approx(square.mean()), len(square))
        out = tracking.mean_squared_displacement(df, most, per_track=True)
        assert {(r["track_id"], r["lag"]): (r["msd"], r["n"]) for r in out.collect()} == want
        assert "sequence" not in out._jdf.queryExecution().optimizedPlan().toString()


def _counted(monkeypatch):
    """Rows of each table that neighbours stores from now on."""
    rows, stored = [], neighbours.stored

    def count(df, by=None):
        out = stored(df, by)
        rows.append(out.count())
        return out

    monkeypatch.setattr(neighbours, "stored", count)
    return rows


def test_density_clusters_without_lists_of_pairs(spark, monkeypatch):
    """Crowds of points, chains between them, points on the rim and far off: as by brute force, and no table of all near pairs."""
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 0.1, (500, 2)), rng.normal(2, 0.3, (300, 2)), np.column_stack([np.linspace(-3, 3, 60), np.full(60, -1.0)]), rng.uniform(-4, 4, (60, 2)), np.zeros((200, 2))])
    x = rng.permutation(np.round(x, 2))
    rows = [(k, float(a), float(b)) for k, (a, b) in enumerate(x)] + [(5000, None, 1.0), (5001, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    stored = _counted(monkeypatch)
    for eps, least in ((0.25, 6), (0.5, 1)):
        stored.clear()
        near = ((x[:, None, 0] - x[None, :, 0]) * (x[:, None, 0] - x[None, :, 0]) + (x[:, None, 1] - x[None, :, 1]) * (x[:, None, 1] - x[None, :, 1])) <= eps * eps
        core, label = near.sum(1) >= least, np.arange(len(x))
        while True:
            told = np.where(near & core[None, :] & core[:, None], label[None, :], len(x)).min(1)
            after = np.where(core, np.minimum(label, told), label)
            if (after == label).all():
                break
            label = after
        reach = np.where(near & core[None, :], label[None, :], len(x)).min(1)
        names = {v: k for k, v in enumerate(sorted(set(label[core].tolist())))}
        want = {k: names.get(int(label[k] if core[k] else reach[k]), -1) for k in range(len(x))}
        want |= {5000: len(names), 5001: len(names) + 1} if least == 1 else {5000: -1, 5001: -1}
        assert {r["id"]: r["cluster"] for r in neighbours.dbscan(df, "id", ["x", "y"], eps, least).collect()} == want
        assert max(stored) < near.sum() / 4


def test_pairs_of_fingerprints_that_prefixes_do_not_tell_apart(spark, monkeypatch):
    """Half the bits set: compared by blocks, copies once; few bits set: by prefixes. Both as by brute force."""
    rng = np.random.default_rng(9)
    for share, least, blocks in ((0.5, 0.55, True), (0.02, 0.5, False)):
        x = (rng.random((400, 63 if blocks else 2000)) < share).astype(float)
        x[100:130], x[130] = x[99], 0
        n_bits = x.shape[1]
        monkeypatch.setattr(neighbours, "MEETING", 64 if blocks else 1, raising=False)  # prefixes pay in a larger table
        df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "k long, v array<double>").select("k", neighbours.bits(F.col("v")).alias("fp"))
        out = neighbours.similarity_pairs(df, "k", "fp", n_bits, least)
        both, size = x @ x.T, x.sum(1)
        want = {(a, b): both[a, b] / (size[a] + size[b] - both[a, b]) for a in range(400) for b in range(a + 1, 400) if both[a, b]}
        assert {(r["a"], r["b"]): r["similarity"] for r in out.collect()} == {k: v for k, v in want.items() if v >= least}
        assert ("CoGroup" in out._jdf.queryExecution().optimizedPlan().toString()) == blocks


def test_leaders_of_a_dense_graph_in_few_rounds(spark, monkeypatch):
    """Nearly all rows are within two links of each other, so that few can be heads at once."""
    rng = np.random.default_rng(4)
    x = (rng.random((700, 30)) < rng.uniform(0.3, 0.7, (700, 1))).astype(float)
    x[300:340] = x[5]
    both, size = x @ x.T, x.sum(1)
    near = both / np.maximum(size[:, None] + size[None, :] - both, 1) >= 0.55
    left, want = np.ones(700, bool), {}
    while left.any():
        n = np.where(left, (near & left[None, :]).sum(1), -1)
        head = int(np.argmax(n))
        taken = np.flatnonzero(near[head] & left) if n[head] else np.array([head])
        want |= dict.fromkeys(taken.tolist(), head)
        left[taken] = False
    stored = _counted(monkeypatch)
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "k long, v array<double>").select("k", neighbours.bits(F.col("v")).alias("fp"))
    monkeypatch.setattr(neighbours, "TURN_ROWS", 40, raising=False)
    monkeypatch.setattr(neighbours, "TURN_LINKS", 10_000, raising=False)
    assert {r["k"]: r["cluster"] for r in neighbours.leader_clusters(df, "k", "fp", 30, 0.45).collect()} == want
    assert len(stored) < 80


def test_percentiles_without_a_task_of_all_values(spark):
    """As F.percentile and F.median, which gather all distinct values in one task; data_summary and distribution_fits take them."""
    rng = np.random.default_rng(8)
    v = [float(x) for x in rng.normal(50, 20, 2001).round(3)] + [7.5] * 300 + [None] * 5
    df = spark.createDataFrame([(x, None if k % 7 == 0 else float(k % 40), "ab"[k % 2]) for k, x in enumerate(v)], "x double, y double, g string")
    for by in ([], ["g"]):
        want = df.groupBy(*by).agg(*(F.percentile("y", p).alias(f"p{k}") for k, p in enumerate((0.0, 0.001, 0.25, 0.5, 0.999, 1.0))))
        got = running.percentiles(df, "y", [0.0, 0.001, 0.25, 0.5, 0.999, 1.0], by)
        assert sorted(got.collect()) == sorted(want.collect())
    assert running.percentiles(df.limit(0), "y", [0.5]).first()[0] is None
    out = statistics.summary(df, ["x", "y"])
    told = {r["stat"]: (r["x"], r["y"]) for r in out.collect()}
    frame = df.toPandas().describe()
    assert all(told[k] == pytest.approx((frame["x"][k], frame["y"][k])) for k in frame.index) and list(told) == list(frame.index)
    for x in (out, advanced.distribution_fits(df, "y")):
        plan = x._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan and "median(" not in plan
