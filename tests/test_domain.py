import math

import numpy as np
import pytest

from labquarry import sources, streaming
from labquarry.operators import evaluation, figures, molecules, neighbours, screening, statistics, tracking
from labquarry.plans import graph


def test_tests_on_known_values(spark):
    rows = [("a", float(x)) for x in (1, 2, 3, 4, 5)] + [("b", float(x)) for x in (2, 4, 6, 8, 10)] + [(None, 1.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    t = statistics.pairwise_t(df, "v", "g", "student").first()
    assert t["statistic"] == pytest.approx(-1.8973666) and t["p"] == pytest.approx(0.0943, abs=1e-4)
    assert statistics.anova(df, "v", "g").first()["f"] == pytest.approx(3.6)
    assert statistics.mann_whitney(df, "v", "g").first()["u"] == 5.0
    assert statistics.f_test(df, "v", "g").first()["f"] == pytest.approx(0.25)
    d = statistics.describe(df, ["v"], "g", 0.95).where("group = 'a'").first()
    assert d["ci_low"] == pytest.approx(3 - 2.776445 * math.sqrt(2.5 / 5), abs=1e-5) and d["skewness"] == pytest.approx(0) and d["kurtosis"] == pytest.approx(-1.2)


def test_corrections(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (None,)], "p double")
    want = {"bonferroni": [0.03, 0.12, 0.09], "holm": [0.03, 0.06, 0.06], "fdr_bh": [0.03, 0.04, 0.04], "simes-hochberg": [0.03, 0.04, 0.04]}
    for method, values in want.items():
        got = {r["p"]: r["p_adj"] for r in statistics.adjusted(df, "p", method).collect()}
        assert [got[p] for p in (0.01, 0.04, 0.03)] == pytest.approx(values) and got[None] is None


def test_grubbs(spark):
    df = spark.createDataFrame([(float(x),) for x in (10, 11, 10, 12, 11, 10, 30)], "v double")
    r = statistics.grubbs(df, "v").first()
    assert r["extreme"] == 30 and r["is_outlier"] and r["critical"] == pytest.approx(2.0200, abs=1e-3)


def test_assignment_is_best():
    import itertools

    rng = np.random.default_rng(0)
    for _ in range(50):
        c = rng.random((rng.integers(1, 5), rng.integers(1, 5)))
        n, m = c.shape
        best = min(sum(c[a, b] for a, b in zip(rows, cols, strict=True)) for k in [min(n, m)] for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k))
        assert sum(c[a, b] for a, b in tracking.assignment(c)) == pytest.approx(best)


def test_linker_and_dbscan(spark):
    rows = [("v", f, 10.0 * k + f, 5.0 * k, k) for f in range(6) for k in range(3) if not (k == 1 and f == 3)] + [("v", 2, 500.0, 500.0, 9)]
    out = tracking.link_particles(spark.createDataFrame(rows, "video string, frame int, centroid_x double, centroid_y double, who int"), "video", 4.0).collect()
    ids = {}
    for r in out:
        ids.setdefault(r["who"], set()).add(r["track_id"])
    assert all(len(v) == 1 for v in ids.values()) and ids[9] == {-1} and len({next(iter(ids[k])) for k in range(3)}) == 3
    points = spark.createDataFrame([(k, float(x), 0.0) for k, x in enumerate([0, 0.3, 0.6, 5, 5.2, 5.4, 20])], "id int, x double, y double")
    got = {r["id"]: r["cluster"] for r in neighbours.dbscan(points, "id", ["x", "y"], 0.5, 2).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: -1}


def test_molecules(spark, tmp_path):
    sdf = "water\n  x\n\n  3  2  0  0  0  0  0  0  0  0999 V2000\n    0.0000    0.0000    0.0000 O   0  0\n    0.9600    0.0000    0.0000 H   0  0\n   -0.2400    0.9300    0.0000 H   0  0\n  1  2  1  0\n  1  3  1  0\nM  END\n>  <id>\n7\n\n$$$$\n"
    (tmp_path / "m.sdf").write_text(sdf * 2)
    got = molecules.structure_descriptors(sources.read_sdf(spark, str(tmp_path / "m.sdf"))).collect()
    assert [r["formula"] for r in got] == ["H2O"] * 2 and got[0]["weight"] == pytest.approx(18.015) and got[0]["props"] == {"id": "7"} and got[0]["n_bonds"] == 2
    (tmp_path / "m.xyz").write_text("3\nw\nO 0 0 0\nH 1 0 0\nH 0 1 0\n1\nx\nHe 0 0 0\n")
    assert [len(r["atoms"]) for r in sources.read_xyz(spark, str(tmp_path / "m.xyz")).collect()] == [3, 1]
    table = spark.createDataFrame([("a", 300.0, 2.0, 1, 3), ("b", 600.0, 2.0, 1, 3), ("c", None, 1.0, 0, 0)], "name string, mol_weight double, logp double, h_donors int, h_acceptors int")
    out = molecules.drug_likeness(table)
    assert [r["name"] for r in out["matches"].collect()] == ["a"] and out["rejects"].count() == 2
    assert molecules.merge(table, table.where("name = 'b'"), "AND").count() == 1 and molecules.merge(table, table).count() == 3
    assert molecules.property_filter(table, "mol_weight", "<", 500)["rejects"].count() == 2


def test_screening(spark, tmp_path):
    for g, stem, cells in (("neg", "n1", (0.10, 0.20)), ("pos", "p1", (0.30, 0.40))):
        (tmp_path / g).mkdir()
        (tmp_path / g / f"{stem}_corrected.csv").write_text("cell,pct\n" + "".join(f"{k},{v}\n" for k, v in enumerate(cells, 1)) + "BG,0.05\n")
    (tmp_path / "pos" / "bad_corrected.csv").write_text("cell,pct\n1,0.5\n")
    found = sources.read_cell_folder(spark, str(tmp_path))
    out = {(r["group"], r["cell"]): round(r["pct"], 9) for r in screening.blank_normalize(found["cells"], found["background"], "pct", "neg").collect()}
    assert out == {("neg", 1): 0.5, ("neg", 2): 1.5, ("pos", 1): 2.5, ("pos", 2): 3.5}
    assert screening.exclude_cells(found["cells"], '{"n1": [2]}').count() == 3 and screening.exclude_cells(found["cells"], "no json").count() == 4
    rng = np.random.default_rng(42)
    rows = [(g, f"{g}{f}", c, float(rng.normal(0.5 if g == "pos" else 0.1, 0.05)), float(rng.normal(0.05, 0.05))) for g in ("neg", "pos") for f in range(5) for c in range(20)]
    ranked = screening.rank_combinations(spark.createDataFrame(rows, "group string, file_stem string, cell int, good double, bad double"), ["bad", "good"], "neg", "pos").collect()
    assert ranked[0]["column"] == "good" and ranked[0]["passes_filter"] and len(ranked) == 2


def test_figures(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 100)] + [("b", 5.0)], "g string, v double")
    b = {r["group"]: r for r in figures.boxes(df, "v", "g").collect()}
    assert b["a"]["outliers"] == 1 and b["a"]["whisker_high"] == 4
    assert sum(r["count"] for r in figures.histogram(df, "v", 5).collect()) == 6
    assert {r["group"]: r["n"] for r in figures.bars(df, "v", "g", "ci").collect()} == {"a": 5, "b": 1}
    grid = figures.density(df.where("v < 50"), "v", 200).orderBy("x").collect()
    assert sum((y["x"] - x["x"]) * (x["density"] + y["density"]) / 2 for x, y in zip(grid, grid[1:], strict=False)) == pytest.approx(1, abs=0.01)
    assert figures.angles(spark.createDataFrame([(-10.0,), (350.0,)], "a double"), "a").first()["count"] == 2


def test_encoders(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), (None, 1.0)], "s string, v double")
    assert sorted(r["s_encoded"] for r in evaluation.label_encode(df, ["s"]).collect()) == [0, 1, 2]
    assert {r["v"] for r in evaluation.scale(df, ["v"])["scaled"].collect()} == {0.0}
    fs = evaluation.feature_scores(spark.createDataFrame([(float(k), float(k * 2), float(k % 3)) for k in range(30)], "y double, a double, b double"), "y", ["a", "b"], "regression")
    assert fs.count() == 2


def test_graph(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0), (3, None)], "k int, v double")
    g = {
        "split": {"op": "tabular.top_n", "inputs": ["filled"], "params": {"column": "v", "n": 1, "order_by": ["k"]}},
        "filled": {"op": "tabular.fill_missing", "inputs": ["t"], "params": {"mode": "constant", "value": "9"}},
        "rest": {"op": "tabular.filter_rows", "inputs": ["split.rest"], "params": {"query": "k > 1"}},
        "own": {"op": lambda d: d.count(), "inputs": ["rest"]},
    }
    out = graph.run(g, {"t": df})
    assert out["own"] == 1 and out["split"]["top_n"].first()["k"] == 3
    with pytest.raises(graph.GraphError, match="cycle"):
        graph.run({"a": {"op": "tabular.filter_rows", "inputs": ["b"]}, "b": {"op": "tabular.filter_rows", "inputs": ["a"]}}, {})
    with pytest.raises(graph.GraphError, match="bad: "):
        graph.run({"bad": {"op": "tabular.filter_rows", "inputs": ["t"], "params": {"query": "nope > 1"}}}, {"t": df})


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", __import__("pyspark.sql.functions", fromlist=["F"]).col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    batch = streaming.windowed(events, "ts", "1 day", ["event_type"], "value")
    stream = streaming.windowed(streaming.read_stream(spark, str(tmp_path / "in"), events.schema), "ts", "1 day", ["event_type"], "value")
    got = streaming.collect_stream(stream, "windows", str(tmp_path / "c1"), "complete")
    a, b = (x.selectExpr("window_start", "event_type", "n", "round(total, 6) AS total") for x in (batch, got))
    assert a.count() == b.count() and a.exceptAll(b).count() == 0
    assert streaming.sessions(events, "ts", "1 hour", ["user_id"]).count() > 0


def test_clean(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "v double, k int")
    assert [r["v"] for r in sources.clean(df).orderBy("k").collect()] == [None, 2.0]
