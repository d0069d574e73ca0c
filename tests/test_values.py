"""Values of queries that SQL does not express, against plain Python on the smallest scale."""

import collections
from itertools import permutations

import numpy as np
import pytest

import __spark_entry__ as entry
from tessera.functions import hmm
from tessera.plans import models
from tessera.sources.frames import frames


@pytest.fixture(scope="module")
def plain(spark, data):
    """Frames by series, labels as runs, and the class models by plain numpy."""
    series = collections.defaultdict(list)
    for r in frames(spark, data).orderBy("series_id", "t").collect():
        series[r.series_id].append((r.x, r.h, r.tag))
    runs = []
    for s, rows in series.items():
        begin = 0
        for t in range(1, len(rows) + 1):
            if t == len(rows) or rows[t][2] != rows[begin][2]:
                runs.append((s, rows[begin][2], begin, t))
                begin = t
    x = {s: np.array([r[:2] for r in rows], float) for s, rows in series.items()}
    return x, runs


@pytest.fixture(scope="module")
def built(spark, data):
    e = models.examples(frames(spark, data))
    return models.built(models.class_models(e), e)


@pytest.fixture(scope="module")
def found(plain, built):
    """Segments of all series by the best joint path."""
    x, (names, own) = plain[0], built
    joint, owner = hmm.join(own)
    first = np.concatenate([np.arange(len(m.mean)) == 0 for m in own])
    paths, lls = hmm.viterbi_many(joint, list(x.values()))
    return {s: (p, [(names[m], a, b) for m, a, b in hmm.segments(p, owner, first)], ll) for s, p, ll in zip(x, paths, lls)}


def overlap(runs, found):
    out = collections.Counter()
    for s, tag, a, b in runs:
        for name, c, d in found[s][1]:
            if min(b, d) > max(a, c):
                out[tag, name] += min(b, d) - max(a, c)
    return out


def test_decoded_segments(spark, data, found):
    got = collections.defaultdict(list)
    for r in entry.queries()["hmm_decode"](spark, data).collect():
        got[r.series_id].append((r.tag, r.start, r.stop))
        assert r.ll == pytest.approx(found[r.series_id][2])
    assert {s: sorted(x, key=lambda r: r[1]) for s, x in got.items()} == {s: x[1] for s, x in found.items()}


def test_spot_scores_and_mapping(spark, data, plain, found):
    want = overlap(plain[1], found)
    assert {(r.truth, r.found): r.frames for r in entry.queries()["hmm_spot_scores"](spark, data).collect()} == want
    got = entry.queries()["best_label_mapping"](spark, data).collect()
    truth, names = sorted({t for t, _ in want}), sorted({n for _, n in want})
    best = max(sum(want[t, n] for t, n in zip(truth, p)) for p in permutations(names + [None] * max(0, len(truth) - len(names)), len(truth)))
    assert sum(r.frames for r in got) == best and len({r.truth for r in got}) == len(truth)


def test_state_distributions(spark, data, plain, built, found):
    names, own = built
    begin = np.concatenate([[0], np.cumsum([len(m.mean) for m in own])])
    owner = np.repeat(np.arange(len(own)), [len(m.mean) for m in own])
    values = collections.defaultdict(list)
    for s, (path, _, _) in found.items():
        for p, v in zip(path, plain[0][s]):
            for d in range(2):
                values[names[owner[p]], int(p - begin[owner[p]]), d].append(v[d])
    got = {(r.tag, r.state, r.dim): (r.n, r["mean"], r["var"]) for r in entry.queries()["state_distributions"](spark, data).collect()}
    assert got == {k: (len(v), pytest.approx(np.mean(v)), pytest.approx(np.var(v), abs=1e-6)) for k, v in values.items()}


def test_events_of_supervised_models(spark, data, plain):
    e = models.examples(frames(spark, data))
    names, own = models.built(models.supervised_models(e), e)
    joint, owner = hmm.join(own)
    first = np.concatenate([np.arange(len(m.mean)) == 0 for m in own])
    paths, _ = hmm.viterbi_many(joint, list(plain[0].values()))
    spots = {s: [(names[m], a, b) for m, a, b in hmm.segments(p, owner, first)] for s, p in zip(plain[0], paths)}
    right = collections.Counter()
    for s, tag, a, b in plain[1]:
        right[tag] += any(n == tag and min(b, d) > max(a, c) and 2 * (min(b, d) - max(a, c)) >= min(b - a, d - c) for n, c, d in spots[s])
    total = collections.Counter(r[1] for r in plain[1])
    assert {r.tag: (r.labels, r.correct, r.recall) for r in entry.queries()["supervised_hmm_events"](spark, data).collect()} == {t: (n, right[t], round(right[t] / n, 6)) for t, n in total.items()}


def test_greedy_cover(spark, data, plain, built):
    names, own = built
    every = np.concatenate(list(plain[0].values()))
    wide = hmm.background(every.mean(0), 5 * every.var(0))
    chosen, want = [], []
    for place in range(min(3, len(own))):
        ll = {i: sum(hmm.viterbi_many(hmm.join([wide, *[own[c] for c in chosen], own[i]])[0], list(plain[0].values()))[1]) for i in range(len(own)) if i not in chosen}
        best = max(ll, key=lambda i: (ll[i], -i))
        chosen.append(best)
        want.append((place, names[best], pytest.approx(ll[best])))
    assert [tuple(r) for r in entry.queries()["greedy_cover"](spark, data).orderBy("place").collect()] == want


def test_noise_dimension(spark, data, plain):
    rows = entry.queries()["noise_dimension"](spark, data).orderBy("series_id", "t").collect()
    again = entry.queries()["noise_dimension"](spark, data).orderBy("series_id", "t").collect()
    assert rows == again and len(rows) == sum(map(len, plain[0].values()))
    white = np.array([r.white for r in rows])
    assert abs(white.mean()) < 0.5 and abs(white.var() - 10) < 2
    steps = [abs(b.walk - (a.walk if a.series_id == b.series_id else 0)) for a, b in zip(rows, rows[1:])]
    assert min(steps) >= 0.1 - 1e-9 and max(steps) <= 2.1 + 1e-9 and len({round(s, 6) for s in steps}) > 0.9 * len(steps)


def test_growth_accepted(spark, data, plain):
    """Welch's t of first frames against the rest, and its chance by sampling Student's t."""
    first, rest = collections.defaultdict(list), collections.defaultdict(list)
    for s, tag, a, b in plain[1]:
        first[tag].append(plain[0][s][a, 0])
        rest[tag] += plain[0][s][a + 1 : b, 0].tolist()
    rng = np.random.default_rng(0)
    for r in entry.queries()["growth_accepted"](spark, data).collect():
        a, b = np.array(first[r.tag]), np.array(rest[r.tag])
        va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
        t = (a.mean() - b.mean()) / np.sqrt(va + vb)
        df = (va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1))
        assert (r.t, r.df) == (pytest.approx(t), pytest.approx(df)) and r.accepted == (r.p >= 0.05)
        assert abs((rng.standard_t(df, 200_000) > abs(t)).mean() - r.p) < 0.01


def test_models_of_all_strategies(spark, data, plain):
    """A model of each seed's window, whatever strategy gave the seed."""
    pool = {(r.strategy, r.series_id * (1 << 32) + r.start) for r in entry.queries()["seed_pool"](spark, data).collect()}
    want = {(s, i) for s, i in pool if s != "exhaustive" or i % 50 == 0}
    got = {(r.strategy, r.model_id): r for r in entry.queries()["seed_pool_hmms"](spark, data).collect()}
    assert set(got) == want and {s for s, _ in want} == {"random", "unlikely", "cluster", "projection", "exhaustive"}
    var = np.concatenate(list(plain[0].values())).var(0)
    for (s, i), r in list(got.items())[::7]:
        x = plain[0][i >> 32][i % (1 << 32) :][:8]
        m = hmm.from_window(x, np.maximum(var, 1e-3))
        assert (r.states, r["mean"], r["var"]) == (len(m.start), pytest.approx(m.mean.mean(), abs=1e-5), pytest.approx(m.var.mean(), abs=1e-5))


def test_motif_scan(spark, data, plain):
    """Occurrences of the closest pair of a query window and any other, for each length and radius."""
    got = {(r["size"], r.radius): (r.n, r.n_series) for r in entry.queries()["motif_scan"](spark, data).collect()}
    want = {}
    for size in (6, 8, 10):
        w = [(s * (1 << 32) + t, s, t, v[t : t + size, 0]) for s, v in sorted(plain[0].items()) for t in range(len(v) - size + 1)]
        x = np.array([v for *_, v in w])
        far = lambda i: np.sqrt(((x - x[i]) ** 2).sum(1))
        best = None
        for i, (a, s, t, _) in enumerate(w):
            if a % 50 == 0:
                for j in np.argsort(far(i), kind="stable")[: 4 * size]:
                    if w[j][1] != s or abs(w[j][2] - t) >= size:
                        best = min(best or (np.inf,), (far(i)[j], a, i, j))
                        break
        near = np.minimum(far(best[2]), far(best[3]))
        for radius in (40.0, 80.0, 120.0):
            kept = []
            for k in np.flatnonzero(near < radius):
                if not kept or kept[-1][0] != w[k][1] or w[k][2] >= kept[-1][1] + size:
                    kept.append((w[k][1], w[k][2]))
            want[size, radius] = (len(kept), len({s for s, _ in kept}))
    assert got == want


def test_mixtures_of_all_classes(spark):
    """A mixture a class, all in one grouping: likelihoods by plain numpy from the same start; one Gaussian is exact; classes of one frame, or of equal frames."""
    rng = np.random.default_rng(2)
    x = {"a": np.concatenate([rng.normal(0, 1, (60, 2)), rng.normal(9, 2, (40, 2))]).round(4), "b": rng.normal(3, 1, (50, 2)).round(4), "c": np.array([[1.0, 2.0]]), "d": np.array([[5.0, 5.0]] * 4)}
    rows = spark.createDataFrame([(t, [float(p) for p in q]) for t, v in x.items() for q in v], "tag string, v array<double>").cache()

    def logs(parts, v):
        return np.array([np.log(w) - 0.5 * (np.log(2 * np.pi * np.array(z)) + (v - np.array(m)) ** 2 / np.array(z)).sum(1) for w, m, z in parts])

    for k in (1, 2):
        start = {r.tag: [(p.w, p["mean"], p["var"]) for p in r.parts] for r in models.mixtures(rows, k, 0).collect()}
        assert {t: len(p) for t, p in start.items()} == {"a": k, "b": k, "c": 1, "d": 1}
        got = {r.tag: (r.n, r.ll) for r in models.model_scores(rows, k).collect()}
        for t, v in x.items():
            parts = start[t]
            for _ in range(5 if k > 1 else 1):
                share = logs(parts, v)
                share = np.exp(share - np.logaddexp.reduce(share, axis=0))
                n = share.sum(1)
                mean = [s @ v / m for s, m in zip(share, n)]
                parts = [(m / len(v), mu, np.maximum(s @ (v * v) / m - mu**2, 1e-3)) for s, m, mu in zip(share, n, mean)]
            assert got[t] == (len(v), pytest.approx(np.logaddexp.reduce(logs(parts, v), axis=0).mean(), abs=1e-5))
