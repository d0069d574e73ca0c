"""Queries that take all windows of all series as queries, not those alone whose id 50 divides."""

import numpy as np
import pytest

import __spark_entry__ as entry
from tessera.sources.frames import frames

SHIFT = 1 << 32


@pytest.fixture(scope="module")
def every(spark, data):
    """ids and values of all windows, and their distances to each other, infinite where they overlap."""
    own = {}
    for r in frames(spark, data).orderBy("series_id", "t").collect():
        own.setdefault(r.series_id, []).append(r.x)
    ids = np.array([s * SHIFT + t for s, x in own.items() for t in range(len(x) - 7)])
    v = np.array([x[t : t + 8] for x in own.values() for t in range(len(x) - 7)])
    dist = np.sqrt(sum((v[:, i, None] - v[:, i]) ** 2 for i in range(8)))
    dist[(ids[:, None] // SHIFT == ids // SHIFT) & (np.abs(ids[:, None] - ids) < 8)] = np.inf
    return ids, v, dist


@pytest.fixture(scope="module")
def seeds(every):
    """Local optima: windows none of whose three neighbours has a nearer third neighbour; with the distance of the third."""
    ids, _, dist = every
    near = np.array([np.lexsort((ids, d))[:3] for d in dist])
    third = dist[np.arange(len(ids)), near[:, 2]]
    return {int(ids[i]): float(third[i]) for i in range(len(ids)) if not (third[near[i]] < third[i]).any()}


def test_local_optima(spark, data, seeds):
    got = {r.series_id * SHIFT + r.start: r.dist for r in entry.queries()["local_optima"](spark, data).collect()}
    assert got == {i: pytest.approx(d, abs=1e-5) for i, d in seeds.items()} and any(i % 50 for i in got)


def test_dtw_knn(spark, data, every):
    from tessera.functions.dtw import banded

    ids, v, dist = every
    got = {(r.series_id * SHIFT + r.start, r["rank"]): r.dist for r in entry.queries()["dtw_knn"](spark, data).collect()}
    assert {i for i, _ in got} == set(ids.tolist())
    for i in range(3, len(ids), 97):
        far = np.where(np.isfinite(dist[i]), banded(np.repeat(v[i : i + 1], len(v), 0), v, 0.1) / 8, np.inf)
        assert [got[ids[i], k] for k in (1, 2, 3)] == pytest.approx(np.sort(far)[:3], abs=1e-4)


def test_density_curve(spark, data, every):
    got = {(r.series_id * SHIFT + r.start, r["rank"]): r.density for r in entry.queries()["density_curve"](spark, data).collect()}
    ids, _, dist = every
    assert {i for i, _ in got} == set(ids.tolist())
    for i in range(3, len(ids), 97):
        taken = []
        for j in np.lexsort((ids, dist[i])):
            if len(taken) < 3 and all(ids[j] // SHIFT != ids[t] // SHIFT or abs(ids[j] - ids[t]) >= 8 for t in taken):
                taken.append(j)
        assert [got[ids[i], k + 1] for k in range(3)] == [pytest.approx((k + 2) / dist[i, j], abs=1e-4) for k, j in enumerate(taken)]


def test_attractor_knn(spark, data, every):
    got = {r.series_id * SHIFT + r.start for r in entry.queries()["attractor_knn"](spark, data).collect()}
    assert got == set(every[0].tolist())


def test_density_seeds(spark, data, seeds):
    """Of each series' local optima the densest first, each that is two frames or more from all taken before."""
    taken = []
    for _, i in sorted((d, i) for i, d in seeds.items()):
        if all(i // SHIFT != t // SHIFT or abs(i - t) >= 2 for t in taken):
            taken.append(i)
    got = [r.series_id * SHIFT + r.start for r in entry.queries()["density_seeds"](spark, data).collect()]
    assert sorted(got) == sorted(taken) and any(i % 50 for i in got)


def test_seed_pool(spark, data, seeds):
    got = {r.series_id * SHIFT + r.start for r in entry.queries()["seed_pool"](spark, data).where("strategy = 'cluster'").collect()}
    assert got == set(seeds)


def test_mixture_hmms(spark, data, seeds):
    assert {r.model_id for r in entry.queries()["mixture_hmms"](spark, data).collect()} == set(seeds)


def test_parse_mixture_scores(spark, data, seeds):
    got = {r.series_id * SHIFT + r.start for r in entry.queries()["parse_mixture_scores"](spark, data).collect()}
    assert got == {i for _, i in sorted((d, i) for i, d in seeds.items())[:5]}
