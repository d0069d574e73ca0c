"""A search within a block warps few pairs: limits come down as packs are met, and envelopes of both sides leave out pairs."""

import numpy as np
import pytest

from tessera.operators import search

SHIFT = 1 << 32


@pytest.mark.parametrize("sizes", [(8, 8), (6, 10), (10, 6)])
def test_few_pairs_are_warped(monkeypatch, sizes):
    rng = np.random.default_rng(2)
    q, x = np.round(rng.exponential(50, (40, sizes[0])), 2), np.round(rng.exponential(50, (20_000, sizes[1])), 2)
    x[100:140] = x[100]
    ids, own = np.arange(40) * SHIFT, np.arange(20_000) * SHIFT + 100
    measure, warped = search.Warped(), []
    warp = measure.warp
    monkeypatch.setattr(measure, "warp", lambda a, b: warped.append(len(a)) or warp(a, b))
    a, nbr, dist = search.Packs((own, x, None)).near(measure, ids, q, np.full(40, np.inf), 5, True, True)
    assert sum(warped) < 40 * 20_000 // 5
    every = measure(q, x)
    for i in range(40):
        order = np.lexsort((own, every[i]))[:5]
        assert nbr[a == i].tolist() == own[order].tolist() and dist[a == i] == pytest.approx(every[i, order])
