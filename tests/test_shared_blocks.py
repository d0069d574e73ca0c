"""Cells that lie together share a block: a query that must see most cells of a table is sent to a few blocks, not to each cell."""

import numpy as np
import pytest

from tessera.operators import search

SHIFT = 1 << 32


@pytest.mark.parametrize("metric", ["l2", "dtw"])
def test_queries_are_sent_to_few_blocks(spark, monkeypatch, metric):
    rng = np.random.default_rng(12)
    v = np.round(rng.exponential(50, (1500, 12)), 1)
    v[700:720] = v[700]
    ids = np.arange(1500) // 30 * SHIFT + np.arange(1500) % 30 * 12
    w = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "id long, v array<double>")
    sent, streamed = [], search._streamed

    def kept(rows, queries, blocks, *args, **more):
        sent.append((queries.count(), blocks))
        return streamed(rows, queries, blocks, *args, **more)

    monkeypatch.setattr(search, "_streamed", kept)
    monkeypatch.setattr(search, "PACK_ROWS", 40)
    monkeypatch.setattr(search, "KEPT_PAIRS", 50)
    got = {(r.id, r["rank"]): (round(r.dist, 6), r.nbr) for r in search.nearest(search.asked(w), w, 3, metric, 12).collect()}
    queries = np.flatnonzero(ids % 50 == 0)
    assert all(blocks <= 2 and n <= 2 * len(queries) for n, blocks in sent) and len(sent) == 2
    for i in queries:
        dist = search.METRICS[metric](v[i : i + 1], v)[0]
        dist[(ids // SHIFT == ids[i] // SHIFT) & (np.abs(ids - ids[i]) < 12)] = np.inf
        order = np.lexsort((ids, dist))[:3]
        assert [got[ids[i], k + 1] for k in range(3)] == [(round(dist[j], 6), ids[j]) for j in order]


@pytest.mark.parametrize("size", [1e-3, 1.0, 1e25, 1e170])
@pytest.mark.parametrize("metric", ["l2", "ssd", "dtw"])
def test_pairs_within_limits_are_all_found(metric, size):
    """Single precision only leaves out pairs that are surely farther, whatever the values' size and offset."""
    rng = np.random.default_rng(3)
    x, q = rng.normal(0, size, (300, 8)) + 1e4 * size, rng.normal(0, size, (40, 8)) + 1e4 * size
    q[:5] = x[:5]
    with np.errstate(all="ignore"):
        dist = search.METRICS[metric](q, x)
        limit = np.sort(dist, axis=1)[:, 7]
        a, b, far = search.METRICS[metric].close(q, x, limit)
    want = dist <= limit[:, None]
    if size < 1e100:
        assert {(i, j) for i, j in zip(a.tolist(), b.tolist())} == {(int(i), int(j)) for i, j in zip(*np.nonzero(want))} and len(a) >= 320
    else:
        assert set(map(tuple, zip(a.tolist(), b.tolist()))) <= set(map(tuple, np.argwhere(want).tolist()))
