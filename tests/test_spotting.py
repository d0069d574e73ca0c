"""Trained models against sums over all paths, training that never loses likelihood, planted words, renamed classes."""

from itertools import permutations, product

import numpy as np
import pytest

from tessera.functions import hmm
from tessera.plans import spotting
from tessera.plans.spotting import LETTERS, VALUES, Kind


def brute(model, x):
    """The likelihood of x, summed over every path of states."""
    e, k = model.emit(x), len(model.start)
    logs = [model.start[p[0]] + sum(model.trans[a, b] for a, b in zip(p, p[1:])) + sum(e[t, s] for t, s in enumerate(p)) for p in product(range(k), repeat=len(x))]
    return float(np.logaddexp.reduce(logs))


def test_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(1)
    with np.errstate(divide="ignore"):
        for k, n in [(2, 1), (3, 5), (2, 7)]:
            trans, start = np.log(rng.dirichlet(np.ones(k), k)), np.log(rng.dirichlet(np.ones(k)))
            trans[0, -1] = -np.inf
            for m, x in [(hmm.Discrete(np.log(rng.dirichlet(np.ones(4), k)), trans, start, np.zeros(k)), rng.integers(0, 4, (n, 1))), (hmm.Hmm(rng.normal(0, 1, (k, 2)), rng.uniform(0.5, 2, (k, 2)), trans, start, np.zeros(k)), rng.normal(0, 1, (n, 2)))]:
                assert hmm.forward(m, x) == pytest.approx(brute(m, x)) == pytest.approx(hmm.forward_backward(m, x)[2])


def spoken(spark, seed, series=8):
    """Words of three kinds, each a ramp of its own, between stretches of noise."""
    rng = np.random.default_rng(seed)
    shapes = {"up": np.linspace(-40, 40, 9), "down": np.linspace(40, -40, 9), "peak": np.concatenate([np.linspace(-40, 40, 5), np.linspace(40, -40, 5)])}
    rows = []
    for s in range(series):
        t = 0
        for _ in range(6):
            for word in rng.permutation(list(shapes)):
                n = int(rng.integers(7, 12))
                v = np.interp(np.linspace(0, 1, n), np.linspace(0, 1, len(shapes[word])), shapes[word]) + rng.normal(0, 3, n)
                rows += [(s, t + i, str(word), float(a), float(rng.normal(0, 1))) for i, a in enumerate(v)]
                t += n
    return spotting.quantised(spark.createDataFrame(rows, "series_id long, t int, tag string, x double, h double")).cache()


@pytest.mark.parametrize("kind", [VALUES, LETTERS])
def test_training_never_loses_likelihood(spark, kind):
    """Sums by class equal training on each class's examples one by one; Baum-Welch raises each class's likelihood in every round."""
    rows = spoken(spark, 2, 3)
    own = spotting.sequences(rows, kind.columns).cache()
    exact = Kind(kind.columns, kind.symbols, 0.0)
    models, seen = spotting.train(own, exact, rounds=5)
    for a, b in zip(seen, seen[1:]):
        assert all(b[t] >= a[t] - 1e-6 for t in a) and set(a) == {"up", "down", "peak"}
    got = own.collect()
    start, _ = spotting.train(own, exact, rounds=4)
    x = {t: [np.column_stack([r[c] for c in kind.columns]).astype(float) for r in got if r.tag == t] for t in models}
    for tag, m in start.items():
        parts = [(*hmm.forward_backward(m, v), v) for v in x[tag]]
        moves = sum(p[1] for p in parts)
        assert seen[4][tag] == pytest.approx(sum(p[2] for p in parts))
        with np.errstate(divide="ignore", invalid="ignore"):
            want = np.where(moves.sum(1, keepdims=True) > 1e-12, np.log(moves / moves.sum(1, keepdims=True)), m.trans)
        assert np.allclose(np.exp(models[tag].trans), np.exp(want))
        if kind.symbols:
            c = np.array([[sum((p[0][:, s] * (p[3][:, 0] == q)).sum() for p in parts) for q in range(kind.symbols)] for s in range(3)])
            assert np.allclose(np.exp(models[tag].symbols), c / c.sum(1, keepdims=True))
    assert len(spotting.train(own, kind, how="viterbi")[0]) == 3


@pytest.mark.parametrize("kind", [VALUES, LETTERS])
def test_words_are_spotted(spark, kind):
    rows = spoken(spark, 4, 4)
    own = spotting.sequences(rows, kind.columns)
    models, _ = spotting.train(own, kind)
    scored = {(r.series_id, r.start): r for r in spotting.scores(own, models, kind).collect()}
    for r in own.limit(20).collect():
        x = np.column_stack([r[c] for c in kind.columns]).astype(float)
        assert scored[r.series_id, r.start].score == pytest.approx(hmm.forward(models[r.tag], x) / len(x)) and scored[r.series_id, r.start].n == len(x)
    d = {r.tag: r for r in spotting.distribution(spotting.scores(own, models, kind)).collect()}
    for tag, r in d.items():
        s = [v.score for v in scored.values() if v.tag == tag]
        assert (r.n, r["mean"], r.sd) == (len(s), pytest.approx(np.mean(s)), pytest.approx(np.std(s, ddof=1)))
    found = spotting.spotted(rows, models, kind, None).collect()
    truth = {(r.series_id, r.t): r.tag for r in rows.collect()}
    right = sum(truth[r.series_id, t] == r.tag for r in found for t in range(r.start, r.stop))
    assert sum(r.stop - r.start for r in found) == len(truth) and right > 0.6 * len(truth)  # a third by chance; a peak begins like a rise
    some = spotting.spotted(rows, models, kind, -1.0).collect()
    assert sorted((r.series_id, r.start) for r in some) == sorted((r.series_id, r.start) for r in found if r.z is None or r.z >= -1.0) and len(some) < len(found)


def test_classes_are_renamed(spark):
    """Of all one-to-one names the ones that agree with most frames, also with fewer classes found than there are."""
    labels = [(0, "a", 0, 10), (0, "b", 10, 25), (0, "c", 25, 40), (1, "a", 0, 30)]
    found = [(0, "p", 0, 12), (0, "q", 12, 26), (0, "p", 26, 40), (1, "q", 0, 8), (1, "p", 8, 30)]
    schema = "series_id long, tag string, start int, stop int"
    for own in (found, found[:2], [("x", *f)[1:] for f in found] + [(1, "r", 30, 31)]):
        got, to = spotting.remapped(spark.createDataFrame(own, schema), spark.createDataFrame(labels, schema))
        over = lambda f, t: sum(max(0, min(b, d) - max(a, c)) for s, n, a, b in own if n == f for u, m, c, d in labels if (u, m) == (s, t))
        names = sorted({n for _, n, *_ in own if any(over(n, t) for t in "abc")})
        best = max(sum(over(n, t) for n, t in zip(names, p)) for p in permutations("abc", len(names)))
        assert sum(over(n, t) for n, t in to.items()) == best and len(set(to.values())) == len(to)
        assert sorted(r.tag for r in got.collect()) == sorted(to.get(n, n) for _, n, *_ in own)
    none, to = spotting.remapped(spark.createDataFrame([], schema), spark.createDataFrame(labels, schema))
    assert none.count() == 0 and to == {}
