"""Motifs in one of two dimensions, and greedy choice within free spans."""

import numpy as np
import pytest

from tessera.operators.neighbours import FreeSpans, greedy_in_free, spaced
from tessera.plans import subspace


@pytest.mark.parametrize("dim", [0, 1])
def test_planted_in_one_dimension(spark, dim):
    """The motif is found with the dimension that has it alone, at all its places."""
    rng = np.random.default_rng(7 + dim)
    shape = np.array([0, 60, -40, 80, 20, -70, 50, 0], float)
    rows, places = [], []
    for s in range(5):
        v = rng.normal(0, 20, (150, 2))
        for at in range(8, 140, 30):
            at += int(rng.integers(0, 8))
            v[at : at + 8, dim] = shape + rng.normal(0, 1, 8)
            places.append((s, at))
        rows += [(s, t, float(a), float(b)) for t, (a, b) in enumerate(v)]
    frames = spark.createDataFrame(rows, "series_id long, t int, x double, h double")
    got = subspace.subspace_rounds(frames, rounds=1).collect()
    assert {tuple(r.dims) for r in got} == {(dim,)}
    found = {(r.series_id, r.start) for r in got}
    assert set(places) <= found and len(found) <= len(places) + 6
    taken = sorted(found)
    assert all(a[0] != b[0] or b[1] - a[1] >= 8 for a, b in zip(taken, taken[1:]))


def test_sums_of_collisions(spark):
    """Each window's collisions with all others, over both dimensions, by counting pairs."""
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(0, t, float(rng.normal()), float(rng.normal())) for t in range(60)], "series_id long, t int, x double, h double")
    free = subspace.worded(rows, 8, ("x", "h"))
    w = {r.start: (r.w0, r.w1, r.hits) for r in subspace.summed(free, 2).collect()}
    n = [subspace.guarded_columns(subspace.word_counts(free.selectExpr(f"w{i} AS word"))) for i in (0, 1)]
    from itertools import combinations

    for a, (*words, hits) in w.items():
        want = sum(all(words[i][c] == other[i][c] for c in cols) for b, other in w.items() if b != a for i in (0, 1) for cols in combinations(range(4), n[i]))
        assert hits == want


def test_free_spans():
    rng = np.random.default_rng(0)
    for _ in range(50):
        free = set(np.flatnonzero(rng.random(80) < 0.8).tolist())
        at, spans = sorted(free), []
        for t in at:
            if spans and spans[-1][1] == t - 1:
                spans[-1] = (spans[-1][0], t)
            else:
                spans.append((t, t))
        own = FreeSpans(spans)
        for _ in range(60):
            a = int(rng.integers(0, 80))
            b = a + int(rng.integers(0, 6))
            fits = set(range(a, b + 1)) <= free
            assert own.take(a, b) == fits
            free -= set(range(a, b + 1)) if fits else set()
        starts = rng.integers(0, 60, 40).tolist()
        kept = []
        for s in starts:
            if all(abs(s - k) >= 5 for k in kept):
                kept.append(s)
        assert spaced(starts, 5) == sorted(kept)


def test_greedy_in_free(spark):
    hits = spark.createDataFrame([(0, 5, 4, 1.0), (0, 7, 3, 0.5), (0, 12, 4, 2.0), (0, 1, 3, 0.1), (1, 0, 3, 1.0), (2, 0, 2, 1.0)], "series_id long, start int, len int, dist double")
    free = spark.createDataFrame([(0, 2, 20), (1, 0, 9), (3, 0, 9)], "series_id long, a int, b int")
    assert sorted(tuple(r) for r in greedy_in_free(hits, free).collect()) == [(0, 7, 3), (0, 12, 4), (1, 0, 3)]
    assert greedy_in_free(hits.limit(0), free).count() == 0
