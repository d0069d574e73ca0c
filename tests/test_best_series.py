"""What a search for the best series sends on, with many short series."""

import numpy as np

from pyspark.sql import functions as F

from tessera.operators import search
from tessera.plans import exemplars

SHIFT = 1 << 32


def test_blocks_send_the_best_series_only(spark, monkeypatch):
    """A block sends rows of `most` series a query, not of every series; ties and copies go by series and then by window."""
    rng = np.random.default_rng(11)
    base = [np.round(rng.exponential(50, 12), 1) for _ in range(60)]
    table = [(s * SHIFT + t, base[s % 60][t : t + 8].tolist()) for s in range(240) for t in range(5)]
    w = spark.createDataFrame(table, "id long, v array<double>")
    sent, streamed = [], search._streamed

    def kept(*args):
        sent.append(streamed(*args).cache())
        return sent[-1]

    monkeypatch.setattr(search, "_streamed", kept)
    got = {}
    for r in search.best_per_series(search.asked(w), w, 5, apart=8).collect():
        got.setdefault(r.id, []).append((r.dist, r.series_id, r.nbr))
    ids, v = np.array([i for i, _ in table]), np.array([x for _, x in table])
    queries = np.flatnonzero(ids % 50 == 0)
    for i in queries:
        dist = np.sqrt(((v - v[i]) ** 2).sum(1))
        best = {}
        for d, nbr in sorted(zip(dist, ids)):
            if nbr // SHIFT != ids[i] // SHIFT:
                best.setdefault(nbr // SHIFT, (d, nbr // SHIFT, nbr))
        want = sorted(best.values())[:5]
        assert [x[1:] for x in sorted(got[ids[i]])] == [x[1:] for x in want]
    assert sent[-1].count() < len(queries) * 240 / 4


def test_models_are_laid_along_their_best_series_only(spark, monkeypatch):
    """The series that fit a model best are those of brute force, at ends and gaps of series too, and only these are aligned in full."""
    rng = np.random.default_rng(12)
    size, gone = 4, {(1, 9), (3, 4)}
    x = {s: np.round(rng.exponential(1, (25 if s == 1 else rng.integers(2, 25), 2)), 1) for s in range(40)} | {40: np.round(rng.exponential(1, (30, 2)), 1)}
    rows = spark.createDataFrame([(s, t, float(a), float(b)) for s, v in x.items() for t, (a, b) in enumerate(v) if (s, t) not in gone], "series_id long, t int, x double, h double")
    chosen = search.windows(rows.where("series_id >= 10"), size).select("id").union(search.windows(rows.where("series_id = 1"), size).where(F.col("id") % SHIFT == 7).select("id"))  # the last is parted by a gap
    var = exemplars.spread(rows)
    models = exemplars.windows_as_models(rows, chosen, size, var)
    want = {(r.id, r.series_id): r.score for r in exemplars.best_matches(models, exemplars.stretches(rows, size), 3).collect()}
    laid, plain = [], exemplars._laid
    monkeypatch.setattr(exemplars, "_laid", lambda pairs: laid.append(pairs.cache()) or plain(pairs))
    exemplars.scored(rows, chosen, size)
    assert {(r.id, r.series_id) for r in laid[0].select(F.explode("ids").alias("id"), "series_id").collect()} == set(want)
    assert laid[0].select(F.sum(F.size("ids"))).first()[0] <= 10 * models.count()
