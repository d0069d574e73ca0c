"""The greatest distances of groups against brute force, without all pairs being measured one by one."""

import numpy as np
import pytest

from tessera.operators import search


@pytest.mark.parametrize("size", [1.0, 1e-6, 1e25])
def test_farthest_pairs_of_groups(spark, monkeypatch, size):
    monkeypatch.setattr(search, "FAR_ROWS", 90)
    monkeypatch.setattr(search, "GEMM_PAIRS", 700)
    rng = np.random.default_rng(7)
    x, g = rng.normal(0, size, (400, 16)), rng.integers(0, 6, 400)
    x[g == 3] = x[0]
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, g))] + [(900, None, 1), (901, [float("nan")] * 16, 2), (902, [1e30] * 16, None)]
    found = search.pair_farthest(spark.createDataFrame(rows, "id long, v array<double>, g int"))
    dist = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    want = {(str(i), str(j)): dist[g == i][:, g == j].max() for i in range(6) for j in range(i + 1, 6)}
    assert {(r.g1, r.g2): r.high for r in found.collect()} == {k: pytest.approx(d, rel=1e-12) for k, d in want.items()}


def test_pairs_are_left_out():
    """Two blocks of 1,000 rows: few of the million pairs are measured one by one."""
    rng = np.random.default_rng(8)
    q, x = rng.normal(0, 1, (1000, 64)), rng.normal(0, 1, (1000, 64))
    measured = []

    class Counted(search.Euclid):
        def paired(self, a, b):
            measured.append(len(a))
            return super().paired(a, b)

    top = np.full((1, 1), -1.0)
    none = np.zeros(1000, int)
    assert search._farther(Counted(), q, none, x, none, top) == [(0, 0)]
    assert top[0, 0] == pytest.approx(search.Euclid()(q, x).max()) and sum(measured) < 100
