"""Distances, models and selections against hand-checked values and brute force."""

from itertools import permutations

import numpy as np
import pandas as pd
import pytest

from tessera.functions import dtw, hmm
from tessera.operators import spans
from tessera.operators.neighbours import components, sweep
from tessera.operators.windows import lengths, sliding
from tessera.plans.discovery import knee


def plain_dtw(a, b, r):
    n = len(a)
    d = np.full((n + 1, n + 1), np.inf)
    d[0, 0] = 0
    for i in range(n):
        for j in range(max(0, i - r), min(n, i + r + 1)):
            d[i + 1, j + 1] = (a[i] - b[j]) ** 2 + min(d[i, j], d[i, j + 1], d[i + 1, j])
    return d[n, n]


def test_dtw():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(50, 16)), rng.normal(size=(50, 16))
    got = dtw.banded(a, b, 0.15)
    assert np.allclose(got, [plain_dtw(x, y, 2) for x, y in zip(a, b)])
    assert np.allclose(dtw.banded(a, a), 0)


def test_dtw_column(spark):
    rows = [([1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 3.0]), ([1.0, 2.0], [1.0, 5.0])]
    got = spark.createDataFrame(rows, "a array<double>, b array<double>").select(dtw.dtw("a", "b").alias("d")).collect()
    assert [r.d for r in got] == [0.0, 9.0]


def test_lower_bound_holds(spark, data):
    from tessera.operators.neighbours import dtw_pairs

    rows = dtw_pairs(spark, data).collect()
    assert rows and all(r.lb <= r.dtw + 1e-6 <= r.ssd + 2e-6 for r in rows)


def test_viterbi_and_em():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (20, 1)), rng.normal(8, 1, (15, 1)), rng.normal(0, 1, (10, 1))])
    quiet, loud = hmm.background(np.zeros(1), np.ones(1)), hmm.background(np.full(1, 8.0), np.ones(1))
    joint, owner = hmm.join([quiet, loud])
    path, ll = hmm.viterbi(joint, x)
    assert owner[path].tolist() == [0] * 20 + [1] * 15 + [0] * 10
    e = joint.emit(x)
    for _ in range(20):
        other = rng.integers(0, 2, len(x))
        score = joint.start[other[0]] + e[0, other[0]] + sum(joint.trans[other[t - 1], other[t]] + e[t, other[t]] for t in range(1, len(x)))
        assert score <= ll + 1e-9
    p, moves, total = hmm.forward_backward(joint, x)
    assert np.allclose(p.sum(1), 1) and total >= ll and np.isclose(moves.sum(), len(x) - 1)


def test_assignment():
    rng = np.random.default_rng(2)
    for _ in range(20):
        gain = rng.integers(0, 50, (4, 4)).astype(float)
        got = hmm.assignment(gain)
        assert sorted(got) == [0, 1, 2, 3]
        assert sum(gain[i, j] for i, j in enumerate(got)) == max(sum(gain[i, j] for i, j in enumerate(p)) for p in permutations(range(4)))


def test_linkage_and_t():
    d = np.array([[0, 1, 5], [1, 0, 4], [5, 4, 0]], float)
    assert hmm.linkage(d, "complete") == [(0, 1, 1.0), (0, 2, 5.0)]
    assert hmm.linkage(d, "average") == [(0, 1, 1.0), (0, 2, 4.5)]
    assert hmm.t_tail(2.228, 10) == pytest.approx(0.025, abs=2e-4)
    assert hmm.t_tail(0.0, 5) == pytest.approx(0.5)


def test_windows(spark):
    rows = spark.createDataFrame([(0, t, float(t)) for t in range(8)], "series_id int, t int, x double")
    assert [r.start for r in sliding(rows, 4, 2).orderBy("start").collect()] == [0, 2, 4]
    assert lengths(24, 40) == [24, 28, 32, 36, 40] and lengths(5, 5) == [5]


def test_spans(spark):
    one = lambda rows: spark.createDataFrame(rows, "series_id int, a int, b int")
    get = lambda df: sorted((r.a, r.b) for r in df.collect())
    full, gone = one([(0, 0, 9)]), one([(0, 3, 5)])
    left = spans.subtract(full, gone, full)
    assert get(left) == [(0, 2), (6, 9)]
    assert get(spans.coalesce(left, 4)) == [(0, 9)]
    assert get(spans.complement(left, full)) == [(3, 5)]
    assert get(spans.complement(one([]), full)) == [(0, 9)]


def test_sweep(spark):
    hits = spark.createDataFrame([(0, s) for s in (0, 1, 3, 4, 8)], "series_id int, start int")
    assert sorted(r.start for r in sweep(hits, 3).collect()) == [0, 3, 8]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (6, 6)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def test_knee():
    assert knee([0, 0, 0, 0, 10]) == 3
    assert knee([1.0]) == 0


def planted(spark, n=60, at=(8, 40), series=1, noise=1.0, shape=(0, 9, 0, 9, 0, 9, 0, 9)):
    """Synthetic series (series_id, t, x): noise with one shape at the places given, in every series."""
    rng, rows = np.random.default_rng(3), []
    for s in range(series):
        x = rng.normal(0, noise, n)
        for a in at:
            x[a : a + 8] = shape
        rows += [(s, t, float(v)) for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "series_id long, t int, x double")


def test_planted_motif(spark):
    """A shape planted twice in noise is its own nearest window."""
    from tessera.operators.search import nearest, windows

    w = windows(planted(spark))
    best = nearest(w, w, 1, apart=8).orderBy("dist", "id").first()
    assert (best.id, best.nbr) == (8, 40)


def test_viterbi_of_many_series():
    rng = np.random.default_rng(2)
    joint, _ = hmm.join([hmm.background(np.zeros(2), np.ones(2)), hmm.left_right([rng.normal(3, 1, (9, 2))], 3, np.ones(2), 0.5), hmm.from_window(rng.normal(size=(8, 2)), np.ones(2))])
    xs = [rng.normal(0, 2, (n, 2)) for n in (1, 30, 7, 30, 2, 55)]
    paths, scores = hmm.viterbi_many(joint, xs, block=4)
    for x, path, score in zip(xs, paths, scores):
        want, ll = hmm.viterbi(joint, x)
        assert np.array_equal(path, want) and score == pytest.approx(ll)


def test_models_of_examples():
    rng = np.random.default_rng(4)
    shape = np.stack([np.linspace(0, 20, 9), np.linspace(5, -5, 9)], axis=1)
    xs = [shape + rng.normal(0, 0.3, shape.shape) for _ in range(6)]
    floor = np.full(2, 0.01)
    m = hmm.from_occurrences(xs, floor)
    assert len(m.mean) == 9 and np.all(np.diff(m.mean[:, 0]) > 0) and np.allclose(np.exp(m.trans)[:-1].sum(1), 1, atol=1e-6)
    first = hmm.left_right(xs, 9, floor, 0.3)
    total = lambda model: sum(hmm.forward_backward(model, x)[2] for x in xs)
    scores = [total(hmm.trained(first, xs, floor, n)) for n in range(4)]
    assert all(b >= a - 1e-6 for a, b in zip(scores, scores[1:]))
    assert total(m) > total(hmm.from_window(rng.normal(10, 5, (9, 2)), np.full(2, 4.0)))
    g = hmm.from_group(xs, floor)
    assert len(g.mean) % 2 == 1
    mix = hmm.mixture([m, g])
    assert len(mix.mean) == len(m.mean) + len(g.mean) and np.exp(mix.start).sum() == pytest.approx(1)
    assert hmm.forward_backward(mix, xs[0])[2] <= np.logaddexp(total(m), 0) + 1e9


def test_overlapping_pieces():
    assert [p.tolist() for p in hmm.overlapping(np.arange(8), 4, 0.25)] == [[0, 1, 2], [1, 2, 3, 4], [3, 4, 5, 6], [5, 6, 7]]
    assert all(len(p) for p in hmm.overlapping(np.arange(2), 5))


def test_dim_groups():
    from tessera.operators.windows import dim_groups

    assert dim_groups("AB, C ab") == [[0, 1], [2], [26, 27]]
    with pytest.raises(ValueError):
        dim_groups("A1")


def test_viterbi_in_blocks(spark, monkeypatch):
    """The products of blocks give the path and the likelihood of one pass, for blocks of any size, on 10^6 frames of one series too."""
    from tessera.plans import models

    rng = np.random.default_rng(3)
    one = lambda n: hmm.left_right([rng.normal(m, 2, (9, 2)) for m in (n, n + 3)], 3, np.full(2, 0.5), 0.7)
    parts = [one(k) for k in (0, 4, 8)]
    joint, _ = hmm.join(parts)
    x = rng.normal(4, 4, (1000, 2))
    path, ll = hmm.viterbi(joint, x)
    for size in (1, 7, 250, 1000):
        cut = [x[i : i + size] for i in range(0, 1000, size)]
        before, enters, ends, total = hmm.composed(hmm.block_products(joint, cut, [i == 0 for i in range(len(cut))]))
        got = np.concatenate([hmm.viterbi_within(joint, c, b, e) for c, b, e in zip(cut, before, ends)])
        assert (got == path).all() and total == pytest.approx(ll) and enters == [-1, *ends[:-1]]
    n = {0: 1_000_000, 1: 3, 2: 4096, 3: 4097}
    values = {s: rng.normal(4, 4, (k, 2)).round(3) for s, k in n.items()}
    frames = spark.createDataFrame(pd.DataFrame({"series_id": np.repeat(list(n), list(n.values())), "t": np.concatenate([np.arange(k) for k in n.values()]), "x": np.concatenate([v[:, 0] for v in values.values()]), "h": np.concatenate([v[:, 1] for v in values.values()])})).repartition(4)
    paths, scores = hmm.viterbi_many(joint, list(values.values()))
    owner, first = np.repeat([0, 1, 2], 3), np.tile([True, False, False], 3)
    names = ["a", "b", "c"]
    for size, series in ((4096, [0, 1, 2, 3]), (5, [1, 2])):
        got = {}
        for r in models.decode(frames.where(frames.series_id.isin(series)), names, parts, size).collect():
            got.setdefault(r.series_id, []).append((r.start, r.stop, r.tag, r.ll))
        for s in series:
            want = [(a, b, names[m]) for m, a, b in hmm.segments(paths[s], owner, first)]
            own = sorted(got[s])
            assert [o[:3] for o in own] == want and own[0][3] == pytest.approx(scores[s])
