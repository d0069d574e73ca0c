"""Models are trained on all their occurrences, and those with many of them are summed where they lie."""

import numpy as np
import pytest

from tessera.functions import hmm
from tessera.plans import seeds


@pytest.fixture(scope="module")
def made(spark):
    """Two motifs, of 260 occurrences of two lengths and of 3, and a model of them all by plain numpy."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(0, 3, (3000, 2)) + 50, 3)
    occs = [(0, 0, 10 * i, 8 if i % 3 else 6) for i in range(260)] + [(1, 0, 2700 + 10 * i, 8) for i in range(3)]
    for _, _, at, n in occs:
        x[at : at + n] += np.linspace(0, 30, n)[:, None]
    rows = spark.createDataFrame([(0, t, float(a), float(b)) for t, (a, b) in enumerate(x)], "series_id long, t int, x double, h double").cache()
    return rows, spark.createDataFrame(occs, "model_id long, series_id long, start int, len int").cache(), {m: [x[at : at + n] for i, _, at, n in occs if i == m] for m in (0, 1)}, x.var(0)


@pytest.mark.parametrize("at_once", [2048, 100, 2])
@pytest.mark.parametrize("how", ["occurrences", "group"])
def test_all_examples(made, monkeypatch, how, at_once):
    monkeypatch.setattr(seeds, "EXAMPLES_AT_ONCE", at_once, raising=False)
    rows, occs, own, var = made
    names, got = seeds.held(seeds.built_models(rows, occs, how))
    assert names == ["m0", "m1"]
    for m, xs in zip(got, own.values()):
        want = (hmm.from_occurrences if how == "occurrences" else hmm.from_group)(xs, 0.05 * var)
        for k in ("mean", "var", "trans", "start", "leave"):
            assert np.allclose(np.exp(getattr(m, k)) if k in ("trans", "start", "leave") else getattr(m, k), np.exp(getattr(want, k)) if k in ("trans", "start", "leave") else getattr(want, k), rtol=1e-6, atol=1e-8)


def test_windows_are_trained_as_one_by_one():
    rng = np.random.default_rng(1)
    xs, var = [rng.normal(0, 10, (n, 2)) for n in (8, 5, 8, 12, 1)], np.array([100.0, 40.0])
    for x, m in zip(xs, hmm.from_windows(xs, var)):
        states = hmm.odd(max(3, round(len(x) * 0.75)))
        first = hmm.left_right([x], states, var, hmm._stay(len(x), states))
        first.var[:] = var
        want = hmm.blended(hmm.trained(first, [x], var, keep_var=True), first.trans)
        for k in ("mean", "var", "trans", "start", "leave"):
            assert np.allclose(np.exp(getattr(m, k)) if k in ("trans", "start", "leave") else getattr(m, k), np.exp(getattr(want, k)) if k in ("trans", "start", "leave") else getattr(want, k))
