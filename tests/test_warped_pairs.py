"""Warping of all pairs at a time: the same costs as pair by pair, and far fewer steps."""

import numpy as np
import pytest

from tessera.functions import dtw
from tessera.operators import search

SHIFT = 1 << 32


@pytest.mark.parametrize("n,m", [(8, 8), (8, 5), (5, 12), (1, 4), (1, 1)])
def test_across_is_banded(monkeypatch, n, m):
    monkeypatch.setattr(dtw, "TILE", 40)
    rng = np.random.default_rng(n + m)
    a, b = rng.normal(0, 1, (13, n)), rng.normal(0, 1, (17, m))
    want = dtw.banded(np.repeat(a, 17, axis=0), np.tile(b, (13, 1))).reshape(13, 17)
    assert np.array_equal(dtw.across(a, b), want)


def test_all_pairs_are_not_gathered_one_by_one(monkeypatch):
    monkeypatch.setattr(search.Warped, "warp", lambda *a: 1 / 0)
    v = np.random.default_rng(2).normal(0, 1, (20, 8))
    assert np.array_equal(search.METRICS["dtw"](v[:3], v), dtw.across(v[:3], v) / 8)


def test_pair_stats(spark):
    """Counts and least, mean and greatest warping distances of groups agree with brute force."""
    rng = np.random.default_rng(3)
    table = [(s * SHIFT + t, np.round(rng.normal(0, 5, 8), 1).tolist(), "abc"[(s + t) % 3]) for s in range(6) for t in range(30)]
    w = spark.createDataFrame(table, "id long, v array<double>, g string")
    got = {(r.g1, r.g2): r for r in search.pair_stats(search.asked(w), w, "dtw", 8).collect()}
    ids, v, g = (np.array([r[i] for r in table]) for i in range(3))
    want = {}
    for i in np.flatnonzero(ids % 50 == 0):
        far = dtw.across(v[i : i + 1], v)[0] / 8
        for j in np.flatnonzero((ids // SHIFT != ids[i] // SHIFT) | (np.abs(ids - ids[i]) >= 8)):
            want.setdefault((g[i], g[j]), []).append(far[j])
    assert set(got) == set(want)
    for k, d in want.items():
        assert got[k].n == len(d) and (got[k].low, got[k]["mean"], got[k].high) == pytest.approx((min(d), np.mean(d), max(d)))
