"""Vector codes by ball k-means: each part of a vector is named by the nearest entry of the part's codebook.

The members of an entry fill a ball about it; its radius is that of the farthest. Only entries no farther than twice
the radius are neighbours. A member nearer to its entry than half way to the nearest neighbour is in the stable core
and is compared with none; those beyond lie in rings, and in the ring behind half the way to the k-th neighbour only the
first k are candidates. All distances are squares of integers, so the results are those of a full comparison, ties
included. Between two rounds an entry that has not moved meets only neighbours that have.

Vectors are kept in blocks, a row each, as packed integers with their last codes; a round writes them anew with what
their changed members add to the sums of entries, which a grouping adds up: the driver sees sums and entries, of
which there are parts x entries. The table of the round before is deleted. What an executor loses is read again from the
last table.

Nulls and odd rows: a null vector, an empty one, a component that is null or not finite, or another length than that of
the first vector leaves a row out. A null vec_id comes last where the first ones are chosen, ties by the vector; null
labels are one label. Repeated rows are rows of their own. Components beyond 2^24 count as that; a length that eight
does not divide is filled up with zeros. An empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.base import checkpoint_dir, cut, small, table

PARTS, ENTRIES, ROUNDS = 8, 16, 6
LIMIT = 1 << 24
#: Components of a block at most, so that a task's memory does not grow with their number in a vector.
BLOCK_NUMBERS = 1 << 20
BLOCK = "ids array<long>, labels array<long>, x binary, codes binary, deltas array<long>"


def nearest(x: np.ndarray, own: np.ndarray, book: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances of the parts x (rows, width) for the entries of `book`; own: the codes by the last book, from which the entries `moved` have moved."""
    gaps = ((book[:, None] - book[None]) ** 2).sum(2)
    first = ((x - book[own]) ** 2).sum(1)
    code, best = own.copy(), first.copy()
    for e in range(len(book)):
        members = np.flatnonzero(own == e)
        if not len(members):
            continue
        out = 4 * first[members]
        near = [j for j in np.argsort(gaps[e], kind="stable").tolist() if j != e and gaps[e, j] <= out.max() and (moved[e] or moved[j])]
        for j in near:
            ring = members[out >= gaps[e, j]]
            far = ((x[ring] - book[j]) ** 2).sum(1)
            better = (far < best[ring]) | ((far == best[ring]) & (j < code[ring]))
            code[ring[better]], best[ring[better]] = j, far[better]
    return code, best


def _read(row: dict, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The components (rows, parts, width) and the codes (rows, parts) of a block."""
    n = len(row["ids"])
    size = len(row["x"]) // max(1, n * PARTS * width)
    return np.frombuffer(row["x"], f"<i{size}").reshape(n, PARTS, width).astype(np.int64), np.frombuffer(row["codes"], np.uint8).reshape(n, PARTS)


def blocks(rows: DataFrame, width: int) -> DataFrame:
    """A row for each Arrow batch of (vec_id, label, x), or for BLOCK_NUMBERS components of it; these in as few bytes as they need, codes all zero."""
    step = max(1, BLOCK_NUMBERS // (PARTS * width))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            if n := batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(n, -1)
                x = np.pad(x, ((0, 0), (0, PARTS * width - x.shape[1])))
                kind = np.int16 if np.abs(x).max() < 1 << 15 else np.int32
                yield pa.RecordBatch.from_pylist([{"ids": batch.column("vec_id").to_pylist(), "labels": batch.column("label").to_pylist(), "x": x.astype(kind).tobytes(), "codes": bytes(n * PARTS), "deltas": []}], ARROW)

    return rows.mapInArrow(each, BLOCK)


ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("x", pa.binary()), ("codes", pa.binary()), ("deltas", pa.list_(pa.int64()))])


def step(state: DataFrame, books: np.ndarray, moved: np.ndarray, first: bool) -> DataFrame:
    """The blocks with codes by `books`, and what each adds to the count and sums of each entry: (parts, entries, 1 + width) in one array."""
    width = books.shape[2]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                x, own = _read(row, width)
                codes, deltas = own.copy(), np.zeros((PARTS, books.shape[1], 1 + width), np.int64)
                for p in range(PARTS):
                    codes[:, p] = nearest(x[:, p], own[:, p], books[p], moved[p])[0]
                    new = np.flatnonzero(first | (codes[:, p] != own[:, p]))
                    for sign, where in ((1, codes[new, p]), (-1, own[new, p])) if not first else ((1, codes[new, p]),):
                        for e in np.unique(where).tolist():
                            of = x[new[where == e], p]
                            deltas[p, e, 0] += sign * len(of)
                            deltas[p, e, 1:] += sign * of.sum(0)
                yield pa.RecordBatch.from_pylist([row | {"codes": codes.tobytes(), "deltas": deltas.ravel().tolist()}], ARROW)

    return state.mapInArrow(each, BLOCK)


def coded(state: DataFrame, books: np.ndarray, moved: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of every vector by the last books."""
    width = books.shape[2]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                x, own = _read(row, width)
                codes, error = own.copy(), np.zeros(len(x), np.int64)
                for p in range(PARTS):
                    codes[:, p], far = nearest(x[:, p], own[:, p], books[p], moved[p])
                    error += far
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.int64()), pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], ["vec_id", "label", "code", "error"])

    return state.mapInArrow(each, "vec_id long, label long, code string, error long")


def whole_numbers(rows: DataFrame) -> DataFrame:
    """vec_id, label and x, the components as integers, of rows that take part."""
    v = F.col("embedding")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    number = lambda x: F.greatest(F.least(F.floor(4096 * x.cast("double")), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int")
    whole = rows.where(v.isNotNull() & (F.size(v) > 0)).where(~odd)
    return whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(v, number).alias("x"))


def compress(embeddings: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code and error of every vector, and the codebooks (parts, entries, width)."""
    spark = embeddings.sparkSession
    rows = whole_numbers(embeddings)
    start = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(ENTRIES).collect()
    if not start:
        return spark.createDataFrame([], "vec_id long, label long, code string, error long"), np.zeros((PARTS, 0, 0), np.int64)
    dims = len(start[0]["x"])
    if any(len(r["x"]) != dims for r in start):
        start = rows.where(F.size("x") == dims).orderBy(F.asc_nulls_last("vec_id"), "x").limit(ENTRIES).collect()
    width = -(-dims // PARTS)
    books = np.zeros((PARTS, len(start), PARTS * width), np.int64)[:, :, :width]
    for e, r in enumerate(start):
        books[:, e] = np.pad(np.array(r["x"], np.int64), (0, PARTS * width - dims)).reshape(PARTS, width)
    folder, fs = f"{checkpoint_dir(spark)}/codes-{uuid.uuid4()}", spark._jvm.org.apache.hadoop.fs.Path
    state, last = blocks(rows.where(F.size("x") == dims), width), None
    totals, moved = np.zeros((PARTS, len(start), 1 + width), np.int64), np.ones((PARTS, len(start)), bool)
    for n in range(rounds):
        step(state, books, moved, n == 0).write.parquet(f"{folder}/{n}")
        state = spark.read.schema(BLOCK).parquet(f"{folder}/{n}")
        if last:
            fs(last).getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs(last), True)
        last = f"{folder}/{n}"
        for r in state.select(F.posexplode("deltas").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect():  # parts x entries x (1 + width)
            totals.ravel()[r["at"]] += r["x"]
        some = totals[:, :, 0] > 0
        new = np.where(some[:, :, None], totals[:, :, 1:] // np.maximum(totals[:, :, :1], 1), books)
        moved, books = (new != books).any(2), new
    return coded(state, books, moved), books


def codes(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (the errors of its label's vectors, added) and codebooks_sha256."""
    found, books = compress(embeddings)
    found = cut(found)
    sums = small(cut(found.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return found.join(sums, F.col("label").eqNullSafe(F.col("l"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def _oracle() -> str:
    """DuckDB SQL for op11_codes: assignment and means by turns, for vectors of 64 components."""
    far = " + ".join(f"(q[{i}] - c[{i}]) * (q[{i}] - c[{i}])" for i in range(1, 9))
    means = ", ".join(f"floor(sum(q[{i}])::DOUBLE / count(*))::BIGINT" for i in range(1, 9))
    out = """WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, part, v[part * 8 + 1:part * 8 + 8] AS q FROM k, range(8) r(part)),
b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, q AS c FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 16))"""
    for n in range(ROUNDS + 1):
        out += f",\na{n} AS MATERIALIZED (SELECT vec_id, label, p.part, q, e, {far} AS far FROM p JOIN b{n} b ON b.part = p.part QUALIFY row_number() OVER (PARTITION BY vec_id, p.part ORDER BY far, e) = 1)"
        if n < ROUNDS:
            out += f",\nb{n + 1} AS MATERIALIZED (SELECT part, e, coalesce(m.c, b.c) AS c FROM b{n} b LEFT JOIN (SELECT part, e, [{means}] AS c FROM a{n} GROUP BY part, e) m USING (part, e))"
    return out + f""",
r AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id, label),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM r, h"""


ORACLE = _oracle()
