"""The best exemplar is the best of all windows, whatever their ids, by brute force."""

import numpy as np
import pytest

from tessera.operators import search
from tessera.plans import discovery

SHIFT = 1 << 32


@pytest.mark.parametrize("kind", ["many", "ties", "few", "one"])
def test_best_of_all_windows(spark, kind):
    rng = np.random.default_rng(8)
    x = [np.round(rng.normal(0, 10, n), 2) for n in {"many": [70] * 8, "ties": [60] * 7, "few": [70] * 3, "one": [90]}[kind]]
    if kind != "one":
        for i, s in enumerate(x):  # a shape at a start that 50 does not divide
            s[13 + i : 21 + i] = np.arange(8) * 5 + (0 if kind == "ties" else 0.01 * i ** 1.7)
    rows = spark.createDataFrame([(s, t, float(v)) for s, own in enumerate(x) for t, v in enumerate(own)], "series_id long, t int, x double")
    ids = np.array([s * SHIFT + t for s, own in enumerate(x) for t in range(len(own) - 7)])
    v = np.array([own[t : t + 8] for own in x for t in range(len(own) - 7)])
    scores, matches = [], {}
    for i in range(len(ids)):
        dist = np.sqrt(((v - v[i]) ** 2).sum(1))
        dist[(ids // SHIFT == ids[i] // SHIFT) & (np.abs(ids - ids[i]) < 8)] = np.inf
        own = sorted((dist[o].min(), int(ids[o][np.lexsort((ids[o], dist[o]))[0]])) for s in range(len(x)) if np.isfinite(dist[o := ids // SHIFT == s]).any())[:5]
        scores.append((round(sum(d for d, _ in own), 9), ids[i]))
        matches[ids[i]] = [n for _, n in own]
    best = min(scores)[1]
    got = discovery.best_exemplar(search.windows(rows), 8).collect()
    assert {r.id for r in got} == {best} and best % 50
    assert sorted(r.nbr for r in got) == sorted(matches[best])
