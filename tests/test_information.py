import math

import numpy as np
import pytest

from labquarry.functions import special
from labquarry.operators import evaluation, information
from labquarry.operators.tabular import OperatorError


def plain(rows, k):
    """The estimate by a double loop."""
    psi = lambda n: sum(1 / j for j in range(1, n)) - special.EULER
    rows = [(g, v) for g, v in rows if g is not None and v is not None and not math.isnan(v)]
    rows = [r for r in rows if sum(x[0] == r[0] for x in rows) > 1]
    if not rows:
        return None
    score = psi(len(rows))
    for i, (g, v) in enumerate(rows):
        own = sorted(abs(v - w) for j, (h, w) in enumerate(rows) if h == g and j != i)
        kk = min(k, len(own))
        r = own[kk - 1]
        m = sum(abs(v - w) < r or w == v for _, w in rows)
        kk = kk if r else 1 + own.count(0)
        score += (psi(kk) - psi(len(own) + 1) - psi(m)) / len(rows)
    return max(0.0, score)


@pytest.mark.parametrize(("k", "block"), [(3, 16), (1, 4096), (5, 11)])
def test_like_a_double_loop(spark, monkeypatch, k, block):
    """Blocks far smaller than a class, ties, one value with a third of the rows, a class of one row, nulls."""
    monkeypatch.setattr(information, "BLOCK", block)
    rng = np.random.default_rng(k)
    rows = []
    for i in range(360):
        g = ["a", "b", "c", None][i % 4] if i < 300 else "a"
        tied = 7.0 if i % 3 == 0 else float(rng.integers(0, 40))
        rows.append((g, float(rng.normal({"a": 0, "b": 1.5}.get(g, 4), 1)), tied, float(rng.integers(0, 2**30)) / 1024, None if i % 5 else 1.0))
    rows += [("alone", 1.0, 1.0, 1.0, 1.0), ("two", 2.5, 9.0, 5.0, None), ("two", 2.75, 9.0, 6.0, None), ("a", None, float("nan"), None, None)]
    df = spark.createDataFrame(rows, "g string, apart double, tied double, noise double, `a b` double")
    got = {r["feature"]: r["score"] for r in information.mutual_information(df, "g", neighbours=k).collect()}
    for i, name in enumerate(["apart", "tied", "noise", "a b"]):
        assert got[name] == pytest.approx(plain([(r[0], r[1 + i]) for r in rows], k), abs=1e-9), name
    assert got["apart"] > 0.3 > got["noise"]


def test_selection_and_empty(spark):
    rows = [("a" if k % 2 else "b", float(k % 2 * 50 + k % 7), float(k % 5), "x") for k in range(80)]
    df = spark.createDataFrame(rows, "g string, told double, other double, f string")
    out = evaluation.select_features(df, "g", 1, task="mutual_information")
    assert out["selected"].columns == ["g", "told"] and out["scores"].count() == 2
    assert [tuple(r) for r in information.mutual_information(df.limit(0), "g", ["told"]).collect()] == [("told", None)]
    with pytest.raises(OperatorError):
        information.mutual_information(df, "g", neighbours=0)
