"""Loops of discovery against brute force and on planted motifs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import symbols
from tessera.plans import discovery, models, seeds
from tessera.sources.frames import frames


def starts(df, *keys):
    return sorted(tuple(r[k] for k in (*keys, "series_id", "start")) for r in df.collect())


@pytest.fixture(scope="module")
def rows(spark, data):
    return frames(spark, data).cache()


def tagged(spark, strings):
    return spark.createDataFrame([(s, t, c, 0.0, 0.0) for s, x in enumerate(strings) for t, c in enumerate(x)], "series_id long, t int, tag string, x double, h double")


def greedy(places, size):
    out = []
    for s, t in sorted(places):
        if not out or out[-1][0] != s or t >= out[-1][1] + size:
            out.append((s, t))
    return out


def test_tail_radius(spark):
    rng = np.random.default_rng(1)
    near, far = rng.uniform(1, 2, 30), rng.uniform(40, 100, 970)
    df = spark.createDataFrame([(float(x),) for x in np.concatenate([near, far])], "dist double")
    assert 1 <= discovery.tail_radius(df) <= 45
    assert discovery.tail_radius(spark.createDataFrame([(0.0,)] * 3, "dist double")) == 0.0


def collision_words(words, size):
    """The best pair of brute force: most shared choices of two columns, then the first by place."""
    from itertools import combinations

    cols = list(combinations(range(4), 2))
    best = None
    for i, (a, w) in enumerate(words):
        for b, v in words[i + 1 :]:
            if a[0] != b[0] or abs(a[1] - b[1]) >= size:
                hits = sum(all(w[k] == v[k] for k in c) for c in cols)
                if hits and (best is None or (-hits, a, b) < best):
                    best = (-hits, a, b)
    return best


def test_top_collision_also_without_equal_words(spark):
    rng = np.random.default_rng(2)
    for trial in range(4):
        some = rng.permutation(256)[: 12 + trial]
        words = sorted(((int(rng.integers(0, 2)), int(i) * 3), "".join("abcd"[(w >> (2 * k)) & 3] for k in range(4))) for i, w in enumerate(some))
        df = spark.createDataFrame([(*a, w) for a, w in words], "series_id long, start int, word string")
        got, want = symbols.top_collision(df).first(), collision_words(words, 8)
        assert (got is None) == (want is None) and (got is None or (-got.hits, (got.series1, got.start1), (got.series2, got.start2)) == want)


def test_warped(spark):
    """Stretched occurrences of a pattern against a search of every place and length."""
    rng = np.random.default_rng(3)
    strings = ["".join("abcd"[i] for i in np.repeat(rng.integers(0, 4, 30), rng.integers(1, 6, 30))) for _ in range(4)]
    got = sorted((r.series_id, r.start, r.len, r.others) for r in symbols.warped(tagged(spark, strings), ("a", "b", "c")).collect())
    want = []
    for s, x in enumerate(strings):
        ends = [0] + [i for i in range(1, len(x)) if x[i] != x[i - 1]] + [len(x)]
        for r in range(len(ends) - 3):
            runs = [x[ends[r + k]] for k in range(3)]
            lens = [ends[r + k + 1] - ends[r + k] for k in range(3)]
            others = sum(p != q for p, q in zip(runs, "abc"))
            if others <= 1 and lens[1] <= 3:
                want += [(s, ends[r + 1] - k, k + lens[1] + min(lens[2], 3), others) for k in range(1, min(lens[0], 3) + 1)]
    assert got == sorted(want) and want


def test_hash_rounds(spark, rows):
    """The loop, entry by entry, as plain Python does it."""
    names = sorted({r.tag for r in rows.select("tag").distinct().collect()})
    series = {}
    for r in rows.orderBy("series_id", "t").collect():
        series.setdefault(r.series_id, []).append(chr(97 + names.index(r.tag)))
    limit, size = -12.0, 6
    free = {(s, t): x[t : t + size] for s, x in series.items() for t in range(len(x) - size + 1)}
    want = []
    while True:
        groups = {}
        for at, q in free.items():
            c = [a for i, a in enumerate(q) if not i or a != q[i - 1]]
            if len(set(q)) >= 2 and len(c) >= 3:
                groups.setdefault("".join(c), []).append(at)
        scored = []
        for h, places in groups.items():
            occs = greedy(places, size)
            if len(places) >= 2 and len(occs) >= 2:
                mdl = round(-np.log(len(set(h))) * len(occs) * size + len(occs) * np.log(len(names) + 1), 6)
                scored.append((mdl, -(len(h) - 1), -len(set(h)), -len(occs), -len(places), h, occs))
        if not scored or min(scored)[0] > limit:
            break
        best = min(scored)
        want += [(len({w[0] for w in want}), s, t) for s, t in best[6]]
        gone = {(s, t + k) for s, t in best[6] for k in range(-size + 1, size)}
        free = {at: q for at, q in free.items() if at not in gone}
        if len({w[0] for w in want}) == 4:
            break
    old = symbols.entries.__defaults__
    symbols.entries.__defaults__ = (6, 2, 2)
    try:
        got = discovery.hash_rounds(rows, size, limit)
        assert [w for w in starts(got, "motif") if w[0] < 4] == sorted(want) and want
    finally:
        symbols.entries.__defaults__ = old


def test_projection_rounds(spark, monkeypatch):
    """Two rounds of random projection as plain Python does them, but for the radius, which is tested by itself."""
    from itertools import combinations

    from tests.test_functions import planted

    rows = planted(spark, 50, (8, 30), 4, 2.0, (0, 0, 20, 20, 8, 8, 40, 40))
    monkeypatch.setattr(discovery, "frames", lambda s, d: rows)
    radii, real = [], discovery.tail_radius
    monkeypatch.setattr(discovery, "tail_radius", lambda df: radii.append(real(df)) or radii[-1])
    got = starts(discovery.projection_motifs(spark, "", rounds=2), "motif")
    x = {}
    for r in rows.orderBy("series_id", "t").collect():
        x.setdefault(r.series_id, []).append(r.x)
    free = {(r.series_id, r.start): r.word for r in symbols.sax(rows).collect()}
    v = {(s, t): np.array(x[s][t : t + 8]) for s, t in free}
    want = []
    for n in range(2):
        words = sorted(free.items())
        for columns in (2, 3, 4):
            share = max(sum(k * (k - 1) / 2 for k in np.unique(["".join(w[i] for i in c) for _, w in words], return_counts=True)[1]) for c in combinations(range(4), columns)) / (len(words) * (len(words) - 1) / 2)
            if share <= symbols.MOST_PAIRS:
                break
        cols, best = list(combinations(range(4), columns)), None
        for i, (a, w) in enumerate(words):
            for b, u in words[i + 1 :]:
                hits = sum(all(w[k] == u[k] for k in c) for c in cols)
                if hits and (a[0] != b[0] or abs(a[1] - b[1]) >= 8) and (best is None or (-hits, a, b) < best):
                    best = (-hits, a, b)
        near = [at for at in free if min(np.sqrt(((v[at] - v[s]) ** 2).sum()) for s in best[1:]) <= radii[n] + 1e-9]
        occs = greedy(near, 8)
        want += [(n, s, t) for s, t in occs]
        gone = {(s, t + k) for s, t in occs for k in range(-7, 8)}
        free = {at: w for at, w in free.items() if at not in gone}
    assert got == sorted(want) and len({w[0] for w in want}) == 2


def test_exemplar_finds_planted_motif(spark, monkeypatch):
    from tests.test_functions import planted

    rows = planted(spark, 120, (50, 100), 4, 0.5)
    monkeypatch.setattr(discovery, "frames", lambda s, d: rows)
    got = {(r.series_id, r.start - 1) for r in discovery.exemplar_discover(spark, "", patterns=1).collect()}
    assert sum(any(abs(t - p) < 8 for p in (50, 100)) for _, t in got) >= 3


def test_split_and_merge(spark):
    """Two shapes under one name are split, and merged again where they are near."""
    rng = np.random.default_rng(6)
    x, places = rng.normal(0, 1, 400), list(range(10, 390, 20))
    for i, at in enumerate(places):
        x[at : at + 6] = (200 if i % 2 else -200) + rng.normal(0, 1, 6)
    rows = spark.createDataFrame([(0, t, float(v), 0.0) for t, v in enumerate(x)], "series_id long, t int, x double, h double")
    m = spark.createDataFrame([(0, "ab", 0.0, 0, at, 6) for at in places], "motif int, hash string, mdl double, series_id long, start int, len int")
    out = discovery.split_step(rows, m).collect()
    parts = {k: {r.start for r in out if r.motif == k} for k in {r.motif for r in out}}
    assert sorted(map(sorted, parts.values())) == [places[::2], places[1::2]]
    small = discovery.split_step(rows, m, sample=6).collect()
    assert {r.start: r.motif for r in small}.keys() == set(places) and len({r.motif for r in small}) == 2
    two = spark.createDataFrame([(i % 2, "ab", 0.0, 0, at, 6) for i, at in enumerate(places[::2])], m.schema)
    assert {r.motif for r in discovery.merge_step(rows, two).collect()} == {0}
    apart_ = spark.createDataFrame([(i % 2, "ab", 0.0, 0, at, 6) for i, at in enumerate(places)], m.schema)
    assert {r.motif for r in discovery.merge_step(rows, apart_).collect()} == {0, 1}


def test_affix(spark):
    """A motif that always follows another is joined to it."""
    strings = ["xx" + "abacda" * 1 + "xxx" + "yabacday" + "xx"] * 5
    rows = tagged(spark, strings)
    names = symbols.letters(rows)[1]
    code = lambda p: "".join(chr(97 + names.index(c)) for c in p)
    m = spark.createDataFrame([(k, code(p), 0.0, s, at + o, 3) for s in range(5) for at in (2, 12) for k, p, o in ((0, "aba", 0), (1, "cda", 3))], "motif int, hash string, mdl double, series_id long, start int, len int")
    assert {(r.m1, r.m2, r.k, r.share) for r in discovery.affixed(m).collect()} == {(0, 1, 10, 1.0)}
    out = discovery.affix_step(rows, m)
    assert {(r.motif, r.series_id, r.start, r.len) for r in out.collect()} == {(0, s, at, 6) for s in range(5) for at in (2, 12)}
    assert discovery.affix_step(rows, out) is None


def test_grow(spark):
    """Motifs grow to the side on which their occurrences agree, and stop at frames that are taken."""
    rng = np.random.default_rng(8)
    x, places = rng.normal(0, 30, 300), [20, 80, 140, 200, 260]
    for at in places:
        x[at : at + 10] = np.linspace(0, 50, 10) + rng.normal(0, 1, 10)
    x = x + 0.0
    rows = spark.createDataFrame([(0, t, float(v), float(v)) for t, v in enumerate(x)], "series_id long, t int, x double, h double")
    m = spark.createDataFrame([(0, "a", 0.0, 0, at + 2, 5) for at in places], "motif int, hash string, mdl double, series_id long, start int, len int")
    for _ in range(6):
        new = discovery.grow_step(rows, m, 4.0)
        if new is None:
            break
        m = new
    assert {(r.start - p, r.len) for r, p in zip(sorted(m.collect(), key=lambda r: r.start), places)} <= {(a, n) for a in range(0, 3) for n in range(6, 11)}
    full = spark.createDataFrame([(0, "a", 0.0, 0, at, 5) for at in (20, 25)] + [(1, "b", 0.0, 0, at, 5) for at in (15, 30)], m.schema)
    assert discovery.grow_step(rows, full, 1e9) is None


def plain_growths(x, motifs, limit):
    """(z, motif, side, frames claimed) of every open growth below the limit, by hand. x: series to arrays (frames, dims); motifs: to lists of (series, start, len)."""
    taken = {(s, t) for occs in motifs.values() for s, a, n in occs for t in range(a, a + n)}
    out = []
    for m, occs in motifs.items():
        own = np.array([x[s][a : a + n] for s, a, n in occs]).var(0)
        if len(occs) < 2 or (own.std(0) <= 0).any():
            continue
        for side in ("back", "front"):
            at = [(s, a - 1 if side == "front" else a + n) for s, a, n in occs]
            if all(0 <= t < len(x[s]) and (s, t) not in taken for s, t in at):
                z = ((np.array([x[s][t] for s, t in at]).var(0) - own.mean(0)) / own.std(0)).sum() / np.sqrt(own.shape[1])
                if round(z, 9) < limit:
                    out.append((round(z, 9), m, side, set(at)))
    return sorted(out, key=lambda g: g[:3])


def plain_grow(x, motifs, limit, one):
    """One step of growth: the best of all, or all that no better one wants a frame or the motif of."""
    open_ = plain_growths(x, motifs, limit)
    new = dict(motifs)
    for k, (_, m, side, at) in enumerate(open_):
        if not any(m == other or at & theirs for _, other, _, theirs in open_[:k]) and (not one or k == 0):
            new[m] = [(s, a - (side == "front"), n + 1) for s, a, n in motifs[m]]
    return new if open_ else None


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("one", [False, True])
def test_growth_takes_no_frame_twice(spark, seed, one):
    """Random motifs that stand close together, with a limit that lets all grow: each step is that of brute force, and no frame is ever in two occurrences."""
    rng = np.random.default_rng(seed)
    x = {s: np.round(rng.normal(0, 5, (60, 2)), 3) for s in range(3)}
    rows = spark.createDataFrame([(s, t, float(a), float(b)) for s, v in x.items() for t, (a, b) in enumerate(v)], "series_id long, t int, x double, h double").cache()
    motifs = {m: [] for m in range(4)}
    for s in x:
        at = 1
        while at < 54:
            motifs[int(rng.integers(0, 4))].append((s, at, 4))
            at += 4 + int(rng.integers(1, 4))
    table = lambda m: spark.createDataFrame([(k, s, a, n) for k, occs in m.items() for s, a, n in occs], "motif int, series_id long, start int, len int")
    now, df, limit = motifs, table(motifs), 1e9 if seed % 2 else 0.5
    for _ in range(4 if one else 6):
        now, df = plain_grow(x, now, limit, one), discovery.grow_step(rows, df, limit, one)
        if now is None:
            assert df is None
            break
        got = sorted((r.motif, r.series_id, r.start, r.len) for r in df.collect())
        assert got == sorted((k, *o) for k, occs in now.items() for o in occs)
        frames = [(s, t) for _, s, a, n in got for t in range(a, a + n)]
        assert len(frames) == len(set(frames))


def test_growth_to_the_end(spark):
    """Two motifs with one free frame between their occurrences: the better one takes it, and the other stays."""
    rng = np.random.default_rng(1)
    line = rng.normal(0, 9, 30)
    rows, occs = [], []
    for s in range(6):
        v = line + rng.normal(0, 1, 30) * (1 + np.arange(30) % 2)
        v[10] = line[10] + rng.normal(0, 0.01)
        rows += [(s, t, float(a), float(a)) for t, a in enumerate(v)]
        occs += [(0, s, 5, 5), (1, s, 11, 5)]
    frames = spark.createDataFrame(rows, "series_id long, t int, x double, h double")
    got = discovery.grown(frames, spark.createDataFrame(occs, "motif int, series_id long, start int, len int"), 1e9)
    by = {m: {(r.start, r.len) for r in got.where(f"motif = {m}").collect()} for m in (0, 1)}
    assert all(len(x) == 1 for x in by.values())
    (a, n), (b, k) = by[0].pop(), by[1].pop()
    assert a == 0 and b + k == 30 and a + n == b


def test_mixture_fit(spark):
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.normal(0, 1, (300, 2)), rng.normal(12, 2, (100, 2))])
    rows = spark.createDataFrame([([float(a), float(b)],) for a, b in v], "v array<double>").cache()
    ll, parts = models.mixture_fit(rows, 2)
    (w0, m0, s0), (w1, m1, s1) = sorted(parts, key=lambda p: p[1][0])
    assert abs(w0 - 0.75) < 0.02 and np.allclose(m0, v[:300].mean(0), atol=0.2) and np.allclose(m1, v[300:].mean(0), atol=0.5) and np.allclose(s0, v[:300].var(0), rtol=0.2)
    logs = np.stack([np.log(w) - 0.5 * (np.log(2 * np.pi * np.array(s)) + (v - m) ** 2 / np.array(s)).sum(1) for w, m, s in parts], axis=1)
    assert ll == pytest.approx(np.logaddexp.reduce(logs, axis=1).sum())
    got = rows.select(models.Mixture([(w, models.Gaussian(m, s)) for w, m, s in parts]).log_likelihood("v").alias("ll")).agg(F.sum("ll")).first()[0]
    assert got == pytest.approx(ll)


def test_tree_split(spark):
    rng = np.random.default_rng(10)
    centres = np.array([[0, 0], [0, 40], [200, 0], [200, 40]])
    v = np.concatenate([c + rng.normal(0, 1, (25, 2)) for c in centres])
    rows = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(v)], "id long, v array<double>")
    leaf = {r.id: r.leaf for r in models.tree_split(rows, 2).collect()}
    assert len({leaf[25 * k] for k in range(4)}) == 4 and all(leaf[i] == leaf[25 * (i // 25)] for i in range(100))


def test_models_are_stored(spark, rows, tmp_path):
    occs = seeds.seed_occurrences(rows)
    m = seeds.built_models(rows, occs)
    seeds.save_models(m, f"{tmp_path}/models")
    (names, old), (again, new) = seeds.held(m), seeds.held(seeds.load_models(spark, f"{tmp_path}/models"))
    assert names == again and names
    for a, b in zip(old, new):
        assert all(np.array_equal(getattr(a, k), getattr(b, k)) for k in ("mean", "var", "trans", "start", "leave"))


def test_models_are_cached_and_spots_stored(spark, rows, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return seeds.built_models(rows, seeds.seed_occurrences(rows), "window")

    first, again = (seeds.held(seeds.cached_models(spark, f"{tmp_path}/m", build)) for _ in range(2))
    assert len(calls) == 1 and first[0] == again[0]
    spots = spark.createDataFrame([(1, "a", 2, 5, -1.5), (2, "b", 0, 3, -2.0)], "series_id long, tag string, start int, stop int, ll double")
    seeds.save_spots(spots, f"{tmp_path}/s")
    back = seeds.load_spots(spark, f"{tmp_path}/s").select(spots.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, spots.collect()))


def test_reestimation_raises_likelihood(rows):
    from tessera.functions import hmm

    e = models.examples(rows)
    _, all_ = models.built(models.class_models(e), e)
    series = [np.array([[r.x, r.h] for r in sorted(g, key=lambda r: r.t)]) for g in _by(rows.collect())]
    total = lambda ms: sum(hmm.forward_backward(hmm.join(ms)[0], x)[2] for x in series)
    new = models.reestimated(all_, models.expectations(rows, hmm.join(all_)[0]))
    assert total(new) > total(all_)


def _by(rows):
    out = {}
    for r in rows:
        out.setdefault(r.series_id, []).append(r)
    return out.values()
