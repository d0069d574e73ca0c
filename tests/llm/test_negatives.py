"""Hard negatives: subset-sum scores against inner products, and the operator against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import negatives
from tessera.llm.negatives import Top, planes, scores, subset_sums

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("dims,bits,kind", [(64, 10, np.int32), (13, 7, np.int64), (8, 1, np.int64), (1, 28, np.int64), (200, 16, np.int64)])
def test_scores_are_inner_products(dims, bits, kind):
    rng = np.random.default_rng(dims)
    low, high = -(1 << bits - 1), (1 << bits - 1)
    x, a = rng.integers(low, high, (57, dims)), rng.integers(low, high, (9, dims))
    x[0], x[1] = low, high - 1
    assert planes(x, bits).shape == (57, bits, -(-dims // 8))
    assert (scores(subset_sums(a.astype(kind)), planes(x, bits)) == x @ a.T).all()


def test_top():
    rng = np.random.default_rng(2)
    s = rng.integers(-5, 5, (6, 400))
    fits = rng.random(s.shape) < 0.7
    fits[2] = False
    ids, rows = rng.permutation(np.arange(400) // 2), np.arange(400)
    top = Top(6, 3)
    for a in range(0, 400, 37):
        top.add(s[:, a : a + 37], fits[:, a : a + 37], ids[a : a + 37], rows[a : a + 37])
    for q in range(6):
        want = sorted((-s[q, j], ids[j], rows[j]) for j in np.flatnonzero(fits[q]))[:3]
        assert [(-x, i, r) for x, i, r in zip(top.score[q], top.id[q], top.row[q]) if x > negatives.LOWEST] == want


def whole(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def brute(rows):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i % 7 == 0 else label, n) for n, (i, v, label) in enumerate(rows) if i is not None and label is not None and whole(v)]
    out = []
    for a, va, la, na in kept:
        if a % 50:
            continue
        scored = [(sum(x * y for x, y in zip(va, v)), i, l) for i, v, l, n in kept if n != na and len(v) == len(va)]
        for p_score, p in sorted((-s, i) for s, i, l in scored if l == la)[:5]:
            p_score = -p_score
            fit = sorted((-s, i) for s, i, l in scored if l != la and 50 * p_score <= 100 * s <= 95 * p_score)[:3]
            out += [(a, p, k + 1, i, p_score, -s) for k, (s, i) in enumerate(fit)]
    return sorted(out)


def made(n, seed, labels, dims=12):
    """Vectors about a few centres, with odd rows, ties and copies."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (4, dims))
    rows = [(i, (centres[i % 4] + rng.normal(0, 0.6, dims)).astype(np.float32).tolist(), int(rng.choice(labels))) for i in range(n)]
    rows += [(n + i, rows[3][1], i % 3) for i in range(40)]  # copies
    rows += [(2000, None, 1), (2050, [None] * dims, 1), (2100, [float("nan")] * dims, 1), (2150, [float("inf")] * dims, 2), (2200, rows[0][1], None), (None, rows[0][1], 1), (2250, [], 1)]
    return rows + [(2300, [1.0, 2.0], 1), (2301, [1.0, 2.0], 1), (2302, [1.0, 1.5], 2), (2350, [0.0] * dims, 3), (2400, (-np.array(rows[2][1])).tolist(), 1)]


@pytest.mark.parametrize("labels", [range(10), [5] * 6 + [1, 2]])
def test_mine(spark, monkeypatch, labels):
    rows = made(400, 3, list(labels))
    monkeypatch.setattr(negatives, "LEAST_ROWS", 64)
    monkeypatch.setattr(negatives, "MOST_ROWS", 64)
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", 3)
    monkeypatch.setattr(negatives, "CHUNK_ROWS", 16)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("row", "x", "dims", "planes", "i", "j")})
    got = negatives.mine(df.repartition(5))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows)
    assert len(want) > 20 and sorted(tuple(r) for r in got.collect()) == want


def test_repeated_rows_and_empty_table(spark):
    rows = made(150, 4, list(range(10)))
    twice = rows + [rows[50], rows[50], rows[7]]
    got = negatives.mine(spark.createDataFrame(twice, SCHEMA))
    assert sorted(tuple(r) for r in got.collect()) == brute(twice)
    assert negatives.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert negatives.mine(spark.createDataFrame([(1, [1.0], 2)], SCHEMA)).count() == 0


def test_components_of_any_size(spark):
    """Beyond 2^27 after scaling, with scores that fit a long; a few whose scores do not, met by vectors that have zeros there."""
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(0, 1, 12) * (3e6 if i % 3 else 1.0)).astype(np.float32).tolist() + [0.0], i % 2) for i in range(200)]
    rows += [(200 + i, [0.0] * 12 + [3e38], 1) for i in range(1, 4)]
    rows += [(250, [1.0] * 12 + [1e30], 0), (300, [2.0] * 12 + [-1e30], 1), (301, [2.0**40] + [0.0] * 12, 1), (350, [2.0**46] + [0.0] * 12, 0), (351, [-(2.0**8)] + [0.0] * 12, 1)]
    end = (1 << 63) - 1
    held = lambda s: max(min(s, end), -end)
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    want = []
    for a, va, la in (r for r in kept if r[0] % 50 == 0):
        scored = [(held(sum(x * y for x, y in zip(va, v))), i, label) for i, v, label in kept if i != a]
        for p_score, p in sorted((-s, i) for s, i, label in scored if label == la)[:5]:
            fit = sorted((-s, i) for s, i, label in scored if label != la and -50 * p_score <= 100 * s <= -95 * p_score)[:3]
            want += [(a, p, k + 1, i, -p_score, -s) for k, (s, i) in enumerate(fit)]
    assert max(r[4] for r in want) > 1 << 55
    assert sorted(tuple(r) for r in negatives.mine(spark.createDataFrame(rows, SCHEMA)).collect()) == sorted(want)
