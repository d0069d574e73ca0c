"""Ball k-means: pruned assignment against full comparison, and the operator against brute force."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import vectorcodes
from tessera.llm.vectorcodes import nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def full(x, book):
    far = ((x[:, None] - book[None]) ** 2).sum(2)
    return far.argmin(1), far.min(1)


@pytest.mark.parametrize("seed", range(20))
def test_nearest_is_exact(seed):
    """From any codes, and from the last codes where only some entries have moved; small numbers make many ties."""
    rng = np.random.default_rng(seed)
    span = [3, 10, 5000][seed % 3]
    x, book = rng.integers(-span, span, (500, 4)), rng.integers(-span, span, (16, 4))
    if seed % 4 == 0:
        book[5] = book[9]
    code, far = nearest(x, rng.integers(0, 16, 500), book, np.ones(16, bool))
    want = full(x, book)
    assert (code == want[0]).all() and (far == want[1]).all()
    moved = rng.random(16) < 0.3
    new = book + moved[:, None] * rng.integers(-span // 2, span // 2 + 1, book.shape)
    code, far = nearest(x, code, new, moved)
    want = full(x, new)
    assert (code == want[0]).all() and (far == want[1]).all()


def test_stable_core_is_compared_with_none():
    """Members nearer to their entry than half way to the next one meet no other entry."""

    class Book(np.ndarray):
        reads = 0

        def __getitem__(self, at):
            if self is book and isinstance(at, int):  # an entry that is compared with a ring
                Book.reads += 1
            return super().__getitem__(at)

    book = np.array([[0, 0], [1000, 0], [0, 1000]]).view(Book)
    x = np.array([[3, 4], [999, 2], [1, 995], [400, 0]])
    assert nearest(x, np.array([0, 1, 2, 0]), book, np.ones(3, bool))[0].tolist() == [0, 1, 2, 0] and Book.reads == 0
    assert nearest(np.array([[600, 0]]), np.array([0]), book, np.ones(3, bool))[0].tolist() == [1] and Book.reads > 0


def brute(rows):
    kept = [(i, label, [math.floor(4096 * float(np.float32(x))) for x in v]) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    dims = len(order[0][2])
    kept, order = [r for r in kept if len(r[2]) == dims], [r for r in order if len(r[2]) == dims][:16]
    width = -(-dims // 8)
    cut = lambda v: np.pad(np.array(v), (0, 8 * width - dims)).reshape(8, width)
    x, books = np.stack([cut(r[2]) for r in kept]), np.stack([cut(r[2]) for r in order], axis=1)
    for n in range(7):
        codes = [full(x[:, p], books[p]) for p in range(8)]
        if n < 6:
            for p in range(8):
                for e in range(books.shape[1]):
                    own = x[codes[p][0] == e, p]
                    if len(own):
                        books[p, e] = [math.floor(int(s) / len(own)) for s in own.sum(0)]
    error = sum(c[1] for c in codes)
    by = {}
    for r, e in zip(kept, error):
        by[r[1]] = by.get(r[1], 0) + int(e)
    digest = hashlib.sha256(",".join(str(v) for p in books for e in p for v in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{c[0][k]:02x}" for c in codes), int(error[k]), by[r[1]], digest) for k, r in enumerate(kept)), key=str)


@pytest.mark.parametrize("dims,numbers", [(16, 1 << 20), (64, 640), (5, 1)])
def test_codes(spark, monkeypatch, dims, numbers):
    monkeypatch.setattr(vectorcodes, "BLOCK_NUMBERS", numbers)
    rng = np.random.default_rng(dims)
    rows = [(100 - i, (rng.normal(0, 1, dims) + 3 * (i % 3)).astype(np.float32).tolist(), [1, 2, None][i % 3]) for i in range(120)]
    rows += [(500, None, 1), (501, [None] * dims, 1), (502, [float("nan")] * dims, 1), (503, [float("inf")] + [0.0] * (dims - 1), 2), (None, rows[4][1], 1), (504, [1.0] * (dims + 1), 1), (505, [], 1), (506, rows[9][1], 7), rows[7], rows[7]]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("x", "code", "error", "l", "label_error")})
    got = vectorcodes.codes(df.repartition(3))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_few_rows_and_empty_table(spark):
    few = [(i, [float(i)] * 8, None) for i in range(3)]
    assert sorted((tuple(r) for r in vectorcodes.codes(spark.createDataFrame(few, SCHEMA)).collect()), key=str) == brute(few)
    none = vectorcodes.codes(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vectorcodes.codes(spark.createDataFrame([(1, None, 1)], SCHEMA)).count() == 0
