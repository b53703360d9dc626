"""The range join by blocks: whole, each pair once, and bounded in memory."""

import tracemalloc

import numpy as np
import pytest

from labquarry.llm import rangejoin


def vectors(n, d, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[n // 2 : n // 2 + 90] = x[n // 2] + 0.05 * rng.normal(size=(90, d))  # a crowd
    x[-30:] = x[5]  # copies
    return x


def frame(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "id long, vector array<double>")


def brute(x):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u[:, None] * u[None]).sum(2) >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min(label[k], label[near[k]].min() if near[k].any() else label[k]) for k in range(len(x))])
        if (new == label).all():
            return near.sum(1), label
        label = new


@pytest.mark.parametrize(("d", "blocks", "slices"), [(3, 4, 2), (8, 5, 3), (8, 6, 1)])
def test_blocks_like_brute_force(spark, monkeypatch, d, blocks, slices):
    monkeypatch.setattr(rangejoin, "CHUNK", 16)
    monkeypatch.setattr(rangejoin, "grid", lambda *_: (blocks, slices))
    x = vectors(500, d, d)
    got = rangejoin.linked(frame(spark, x)).toPandas().sort_values("id")
    links, label = brute(x)
    assert (got["n_links"].to_numpy() == links).all() and (got["component_id"].to_numpy() == label).all()


def test_each_pair_of_blocks_meets_once():
    for n in range(1, 10):
        go = rangejoin.sends(np.arange(n), n)
        assert ((go.astype(int) + go.T) == 1 - np.eye(n)).all() and go.sum(1).max() <= n / 2


def test_blocks_fit_and_tasks_do_not_grow_with_the_square():
    for count in (10, 10_000, 600_000, 15_000_000):
        blocks, slices = rangejoin.grid(count, 256, 48)
        assert count * 256 / blocks <= rangejoin.BLOCK_BYTES and slices * blocks <= 48 + blocks and blocks / 2 + slices <= max(16, count * 256 / rangejoin.BLOCK_BYTES)


def test_frames_of_packs_stay_small(spark, monkeypatch):
    """A batch of vectors that nothing prunes went out in one frame, each vector once for every second chunk."""
    monkeypatch.setattr(rangejoin, "CHUNK", 64)
    x = np.random.default_rng(1).normal(size=(3000, 64))
    df = frame(spark, x)
    kind, plain = type(df), type(df).mapInPandas

    def watched(self, func, schema, *a, **b):
        def checked(batches):
            for pdf in func(batches):
                size = sum(len(v) for c in pdf for v in pdf[c] if isinstance(v, bytes))
                assert size < 4 << 20, f"a frame of {size} bytes"
                yield pdf

        return plain(self, checked, schema, *a, **b)

    monkeypatch.setattr(kind, "mapInPandas", watched)
    monkeypatch.setattr(rangejoin, "OUT_BYTES", 1 << 20, raising=False)
    assert rangejoin.linked(df).count() == 3000


def test_a_crowd_of_near_copies_is_compared_in_little_memory():
    """All pairs of two chunks were gathered in double precision at once."""
    d, n = 256, 1024
    x = (1 + 0.01 * np.random.default_rng(2).normal(size=(2 * n, d))).astype(np.float32)
    one, ids = np.ones(n, np.int64), np.arange(2 * n)
    pivot = rangejoin.unit(x[:1].astype(np.float64))
    tracemalloc.start()
    got = next(rangejoin.block_links(ids[:n], one, np.zeros(n, np.int32), x[:n], iter([(ids[n:], one, x[n:])]), {0: (0, 0.0, 0.1)}, pivot, 0.9))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    links = got.groupby("id")["links"].sum()
    assert (links[:n] == 2 * n - 1).all() and (links[n:] == n).all() and (got["other"] == 0).all()
    assert peak < 256 << 20, peak


def test_pairs_at_the_threshold_are_settled_in_double_precision():
    rng = np.random.default_rng(4)
    x = rangejoin.unit(rng.normal(size=(200, 16)))
    y = rng.normal(size=(200, 16))
    y = rangejoin.unit(y - (y * x).sum(1)[:, None] * x)
    cos = 0.9 + np.resize([1e-7, -1e-7, 1e-9, -1e-9, 1e-12, -1e-12], 200)
    y = cos[:, None] * x + np.sqrt(1 - cos**2)[:, None] * y
    p, q = rangejoin.near_pairs(x.astype(np.float32), y.astype(np.float32), x, y, 0.9)
    want = (x[:, None] * y[None]).sum(2) >= 0.9
    assert set(zip(p.tolist(), q.tolist(), strict=True)) == set(zip(*map(list, np.nonzero(want)), strict=True))
    assert (np.diag(want) == (cos > 0.9)).all()


def test_labels_are_the_least_places_of_classes():
    rng = np.random.default_rng(5)
    for n, m in ((50, 20), (200, 180), (400, 3000)):
        label, want = np.arange(n), np.arange(n)
        for _ in range(3):
            a, b = rng.integers(0, n, (2, m))
            rangejoin.join_labels(label, a, b)
            for p, q in zip(want[a], want[b], strict=True):
                p, q = want[p], want[q]
                want[want == max(p, q)] = min(p, q)
            assert (label == want).all()
