"""Searches among all windows of all series against brute force, and the recall of indexes."""

import numpy as np
import pytest

from tessera.functions.dtw import banded
from tessera.operators import neighbours, search
from tests.test_functions import plain_dtw

SHIFT = 1 << 32


@pytest.fixture(scope="module")
def made(spark):
    """Two long series (over 1,000 frames each) and a few short ones, with motifs that recur in other series."""
    rng = np.random.default_rng(5)
    shape = rng.normal(0, 20, 8)
    out = {}
    for s, n in [(0, 1200), (1, 1200), (2, 40), (3, 7), (4, 60)]:
        x = np.round(rng.normal(0, 10, n), 2)
        for at in range(5, n - 8, 100):
            x[at : at + 8] = np.round(shape + rng.normal(0, 1, 8), 2)
        out[s] = x
    rows = [(s, t, float(v)) for s, x in out.items() for t, v in enumerate(x)]
    ids = np.array([s * SHIFT + t for s, x in out.items() for t in range(len(x) - 7)])
    v = np.array([x[t : t + 8] for s, x in out.items() for t in range(len(x) - 7)])
    return spark.createDataFrame(rows, "series_id long, t int, x double").cache(), ids, v


def apart(ids, i, size=8):
    return (ids // SHIFT != ids[i] // SHIFT) | (np.abs(ids - ids[i]) >= size)


def distances(v, i):
    out = np.zeros(len(v))
    for k in range(v.shape[1]):
        out += (v[:, k] - v[i, k]) ** 2
    return np.sqrt(out)


def test_ids_do_not_clash(spark, made):
    rows, ids, _ = made
    assert sorted(r.id for r in search.windows(rows).collect()) == sorted(ids) and len(set(ids)) == len(ids)


@pytest.mark.parametrize("limits", [{}, {"SLICE_ROWS": 20, "BLOCK_ROWS": 64, "PIVOTS": 5, "SAMPLE_ROWS": 40}, {"PIVOTS": 1, "SAMPLE_ROWS": 2}])
def test_nearest(spark, made, monkeypatch, limits):
    """However cells, blocks and slices are cut, the rows are those of brute force."""
    for name, value in limits.items():
        monkeypatch.setattr(search, name, value)
    rows, ids, v = made
    got = {}
    for r in neighbours.window_knn(rows).collect():
        got.setdefault(r.id, []).append((r["rank"], r.nbr))
    want = {}
    for i in np.flatnonzero(ids % 50 == 0):
        order = np.lexsort((ids, np.where(apart(ids, i), distances(v, i), np.inf)))[:3]
        want[ids[i]] = [(k + 1, ids[j]) for k, j in enumerate(order)]
    assert {k: sorted(x) for k, x in got.items()} == want
    assert any(a // SHIFT != b // SHIFT for a, x in want.items() for _, b in x)


def test_warped_nearest_is_exact(made):
    rows, ids, v = made
    got = {(r.id, r["rank"]): r.dist for r in neighbours.window_knn(rows, metric="dtw").collect()}
    for i in np.flatnonzero(ids % 50 == 0)[::9]:
        dist = np.sort([plain_dtw(v[i], x, 1) / 8 if ok else np.inf for x, ok in zip(v, apart(ids, i))])[:3]
        assert np.allclose([got[ids[i], k + 1] for k in range(3)], dist)


def test_within_and_best_per_series(made):
    rows, ids, v = made
    w = search.windows(rows)
    got = {(r.id, r.nbr) for r in search.within(search.asked(w), w, 25.0, apart=8).collect()}
    queries = np.flatnonzero(ids % 50 == 0)
    assert got == {(ids[i], ids[j]) for i in queries for j in np.flatnonzero((distances(v, i) <= 25) & apart(ids, i))} and got
    best = {(r.id, r.series_id): r.dist for r in search.best_per_series(search.asked(w), w, 3, apart=8).collect()}
    for i in queries:
        dist = np.where(apart(ids, i), distances(v, i), np.inf)
        own = sorted((dist[ids // SHIFT == s].min(), s) for s in np.unique(ids // SHIFT))[:3]
        assert {s: best[ids[i], s] for _, s in own if np.isfinite(_)} == pytest.approx({s: d for d, s in own if np.isfinite(d)})


def test_empty_table(spark, made):
    rows, _, _ = made
    none = search.windows(rows.limit(0))
    assert search.nearest(none, none, 3).count() == search.within(none, none, 1.0).count() == search.best_per_series(none, none, 2).count() == 0


@pytest.mark.parametrize("options", [{"by": "ssd", "parts": 4, "probes": 36, "more": 0}, {"by": "dtw", "n_pivots": 32, "probes": 14}])
def test_recall_of_indexes(made, options):
    """Of the windows nearest by warping, nine of ten are found through the index."""
    rows, ids, _ = made
    w = search.windows(rows)
    exact = {(r.id, r.nbr) for r in neighbours.window_knn(rows, k=5, metric="dtw").collect()}
    found = {(r.id, r.nbr) for r in search.indexed(search.asked(w), w, 5, apart=8, **options).collect()}
    recall = len(exact & found) / len(exact)
    print(options, "recall", recall)
    assert recall >= 0.9


def test_large_batches(spark):
    """A batch of over 2,000 vectors is measured as exactly as a small one."""
    rng = np.random.default_rng(7)
    v = rng.normal(0, 1, (3000, 16)) + 1000
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").coalesce(1)
    got = {(r.id, r["rank"]): (r.nbr, r.dist) for r in search.nearest(search.asked(table), table, 3).collect()}
    for i in range(0, 3000, 50):
        dist = distances(v, i)
        dist[i] = np.inf
        order = np.lexsort((np.arange(3000), dist))[:3]
        assert [got[i, k + 1][0] for k in range(3)] == order.tolist() and np.allclose([got[i, k + 1][1] for k in range(3)], dist[order], rtol=1e-12)


def test_pair_stats(made):
    rows, ids, v = made
    w = search.windows(rows).selectExpr("id", "v", "id % 3 AS g")
    got = {(int(r.g1), int(r.g2)): (r.n, r.low, r.mean, r.high) for r in search.pair_stats(search.asked(w), w, apart=8).collect()}
    every = {}
    for i in np.flatnonzero(ids % 50 == 0):
        ok = apart(ids, i)
        for g in range(3):
            every.setdefault((ids[i] % 3, g), []).extend(distances(v, i)[ok & (ids % 3 == g)])
    assert got == {k: pytest.approx((len(x), min(x), np.mean(x), max(x))) for k, x in every.items()}


def sloped_dtw(a, b, share=0.1):
    """Warping of two lengths, cell by cell: place i of the longer meets places within the reach of i laid along the shorter."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    n, m = len(a), len(b)
    r = max(1, int(share * n))
    table = np.full((n + 1, m + 1), np.inf)
    table[0, 0] = 0
    for i in range(n):
        for j in range(m):
            if abs(i * (m - 1) / max(n - 1, 1) - j) <= r + 1e-9:
                table[i + 1, j + 1] = (a[i] - b[j]) ** 2 + min(table[i, j], table[i, j + 1], table[i + 1, j])
    return table[n, m]


def test_warping_of_two_lengths():
    rng = np.random.default_rng(4)
    for n, m in [(8, 8), (6, 10), (10, 6), (5, 9), (30, 21), (1, 4), (7, 1), (40, 20)]:
        a, b = rng.normal(0, 1, (5, n)), rng.normal(0, 1, (5, m))
        got = banded(a, b)
        assert np.allclose(got, [sloped_dtw(x, y) for x, y in zip(a, b)]) and np.allclose(got, banded(b, a)) and np.isfinite(got).all()
        measure = search.Warped()
        far = measure.warp(np.repeat(a, 5, 0), np.tile(b, (5, 1))).reshape(5, 5)
        assert (measure.bound(a, b) / max(n, m) <= far + 1e-9).all() and (measure.upper(a, b) >= far - 1e-9).all()
        cell = search.Cell(b[0], 5, np.sqrt(((b - b[0]) ** 2).sum(1)).max(), b.min(0), b.max(0))
        assert (measure.least(a, cell) <= far.min(1) + 1e-9).all()
        if n == m:
            for metric in (search.Euclid(), search.Euclid(root=False)):
                assert (metric.least(a, cell) <= metric(a, b).min(1) + 1e-9).all()


@pytest.mark.parametrize("limits", [{}, {"SLICE_ROWS": 5, "BLOCK_ROWS": 50, "PIVOTS": 4, "SAMPLE_ROWS": 30}])
def test_windows_of_several_lengths(spark, monkeypatch, limits):
    """Neighbours of any of three lengths, nearest first, none of which overlaps the query or another, by brute force."""
    for name, value in limits.items():
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(9)
    x = {s: np.round(rng.normal(0, 10, n), 2) for s, n in [(0, 90), (1, 70), (2, 9), (3, 4)]}
    for s, at, n in [(0, 50, 10), (1, 0, 8), (1, 40, 6), (0, 10, 10)]:  # one shape, stretched
        x[s][at : at + n] = np.interp(np.linspace(0, 7, n), np.arange(8), [0, 30, -20, 40, 10, -30, 20, 0])
    frames = spark.createDataFrame([(s, t, float(v)) for s, y in x.items() for t, v in enumerate(y)], "series_id long, t int, x double")
    sizes = (6, 8, 10)
    every = [(s * SHIFT + t, n) for s, y in x.items() for n in sizes for t in range(len(y) - n + 1)]
    value = lambda w: x[w[0] // SHIFT][w[0] % SHIFT :][: w[1]]
    apart = lambda a, b: a[0] // SHIFT != b[0] // SHIFT or a[0] + a[1] <= b[0] or b[0] + b[1] <= a[0]
    got = {}
    for r in neighbours.disjoint_any(frames, sizes).orderBy("id", "len", "rank").collect():
        got.setdefault((r.id, r.len), []).append(((r.nbr, r.nbr_len), r.dist))
    asks = [w for w in every if w[0] % 50 == 0]
    assert set(got) == set(asks)
    for w in asks:
        order = sorted((sloped_dtw(value(w), value(o)) / max(w[1], o[1]), o) for o in every if apart(w, o))
        want = []
        for dist, o in order:
            if len(want) < 3 and all(apart(o, p) for p, _ in want):
                want.append((o, pytest.approx(dist)))
        assert got[w] == want
