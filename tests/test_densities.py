"""Densities and peeling without a row for each pair of windows, against brute force."""

import numpy as np
import pytest

from tessera.operators import search

SHIFT = 1 << 32


def test_densities_and_near_ids(spark, monkeypatch):
    monkeypatch.setattr(search, "PACK_ROWS", 30)
    rng = np.random.default_rng(4)
    v = np.round(rng.exponential(50, (600, 8)), 1)
    v[100:110] = v[100]
    v[0] += 1e4
    ids = np.arange(600) // 20 * SHIFT + np.arange(600) % 20 * 5
    w = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "id long, v array<double>")
    q = w.where("id % 10 = 0")
    dist = np.sqrt(((v[:, None] - v) ** 2).sum(2))
    dist[(ids[:, None] // SHIFT == ids // SHIFT) & (np.abs(ids[:, None] - ids) < 8)] = np.inf
    asked = ids % 10 == 0
    want = {int(i): np.exp(-0.5 * d[d <= 120] ** 2 / 40).sum() for i, d in zip(ids[asked], dist[asked]) if (d <= 120).any()}
    got = {r.id: r.density for r in search.densities(q, w, 120.0, 8).collect()}
    assert got == {i: pytest.approx(d, rel=1e-12) for i, d in want.items()}
    assert 0 < len(want) < asked.sum()
    dens = spark.createDataFrame([(int(i), x.tolist(), float(k % 7)) for k, (i, x) in enumerate(zip(ids, v))], "id long, v array<double>, density double")
    level = np.arange(600) % 7
    near = dist <= 70
    over = (level > level[:, None]) | ((level == level[:, None]) & (ids < ids[:, None]))
    assert sorted(r.id for r in search.near_ids(dens, dens, 70.0, 8).collect()) == sorted(ids[near.any(1)].tolist())
    assert sorted(r.id for r in search.near_ids(dens, dens, 70.0, 8, True).collect()) == sorted(ids[(near & over).any(1)].tolist())
