"""Seeds beyond the number of models that are held at a time are tried in slices, and the best of all is taken."""

import numpy as np
import pytest

import __spark_entry__ as entry
from tessera.functions import hmm
from tessera.plans import seeds


def test_slices_of_models(spark, data, monkeypatch):
    want = [tuple(r) for r in entry.queries()["greedy_motifs"](spark, data).orderBy("place").collect()]
    monkeypatch.setattr(seeds, "MODELS_AT_MOST", 5)
    got = [tuple(r) for r in entry.queries()["greedy_motifs"](spark, data).orderBy("place").collect()]
    assert len(want) == 3 and [r[:2] for r in got] == [r[:2] for r in want] and all(abs(a[2] - b[2]) < 1e-6 * abs(b[2]) for a, b in zip(got, want))


def test_totals_are_those_of_joined_models():
    rng = np.random.default_rng(6)
    xs = [np.cumsum(rng.normal(0, 3, (n, 2)), 0) for n in (30, 1, 55, 30, 8)]
    var = np.array([9.0, 4.0])
    base = [hmm.background(np.zeros(2), 5 * var), hmm.from_window(xs[0][3:11], var)]
    tried = hmm.from_windows([xs[2][a : a + n] for a, n in ((0, 8), (9, 8), (20, 12), (30, 8), (40, 5))], var)
    want = [sum(hmm.viterbi(hmm.join([*base, m])[0], x)[1] for x in xs) for m in tried]
    assert hmm.best_totals(base, tried, xs) == pytest.approx(want, rel=1e-12)
    assert hmm.best_totals(base[:1], tried, xs) == pytest.approx([sum(hmm.viterbi(hmm.join([base[0], m])[0], x)[1] for x in xs) for m in tried], rel=1e-12)
