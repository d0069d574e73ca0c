"""Hard negatives by Four-Russians scoring: inner products read from tables of subset sums, bit plane by bit plane.

A row's components are integers. Of a block of anchors, each group of eight dimensions gets a table with the sum of the
anchor's components over every subset of the eight. Of a row, each bit of its components is packed, eight dimensions to
a byte; a bit's byte is the subset that it names. So a row's score is, from the highest bit down, twice what was there
plus the entries that its bytes point at (the highest bit, the sign, counts negative): an exact inner product with no
multiplication.

An anchor's positives come from rows of its label alone, in blocks of label and hash; then all rows are met in blocks
by hash, with the limits that an anchor's positives set. A block sends on the first few of each anchor (and positive),
and a window takes the first of these. All anchors meet all rows, as is asked; no task holds more than a block of each.

Nulls and odd rows: a null label, vector or vec_id, an empty vector, or a component that is null or not finite leaves a
row out. Vectors of different lengths are never compared. Rows that share a vec_id are rows of their own, in any order
where all else ties. Components may be of any size: they are held modulo 2^64, as the sums are, which gives each score
that fits a long exactly; where a score may not fit, a pair is taken by whole numbers of any length, and counts as the
end of the range of longs that it passes. An empty table gives an empty one; other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.base import cut, partitions, small, table

#: Anchors of a block, at least and at most so many rows of a block, and rows that are scored at a time.
ANCHOR_ROWS, LEAST_ROWS, MOST_ROWS, CHUNK_ROWS = 2048, 2048, 65_536, 256
#: Below SAFE no score wraps; scores beyond MOST count as that. LOWEST stands for none.
SAFE, MOST = 1 << 62, (1 << 63) - 1
LOWEST = -MOST


def planes(x: np.ndarray, bits: int) -> np.ndarray:
    """Bytes (rows, bits, groups): for each bit of the components in two's complement, lowest first, eight dimensions to a byte, the first in the lowest bit."""
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % 8)))
    return np.stack([np.packbits((x >> k) & 1, axis=1, bitorder="little") for k in range(bits)], axis=1)


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): the sum of each anchor's components over every subset of each eight dimensions."""
    x = np.pad(anchors, ((0, 0), (0, -anchors.shape[1] % 8)))
    x = np.ascontiguousarray(x.T).reshape(-1, 8, len(x))
    out = np.zeros((len(x), 256, x.shape[2]), x.dtype)
    for i in range(8):
        out[:, 1 << i : 2 << i] = out[:, : 1 << i] + x[:, i, None]
    return out


def scores(sums: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """(rows, anchors): exact inner products of rows, as packed planes, with the anchors whose tables these are."""
    bits = packed.shape[1]
    out = np.zeros((len(packed), sums.shape[2]), sums.dtype)
    for k in range(bits - 1, -1, -1):
        out += out
        for g in range(len(sums)):
            part = sums[g].take(packed[:, k, g], axis=0)
            out = out - part if k == bits - 1 else np.add(out, part, out=out)
    return out


def wrapped(x: np.ndarray) -> np.ndarray:
    """Whole numbers, given as doubles of any size, modulo 2^64 as signed ones."""
    x = np.fmod(x, 2.0**64)
    return np.where(x >= 2.0**63, x - 2.0**64, np.where(x < -(2.0**63), x + 2.0**64, x)).astype(np.int64)


def mended(s: np.ndarray, a: np.ndarray, norms: np.ndarray, rows: list[list[float] | None]) -> np.ndarray:
    """Scores (rows, anchors) that are right modulo 2^64, with those that do not fit a long set to its end. rows: the components of a row that may have such."""
    some = [i for i, x in enumerate(rows) if x is not None]
    if not some:
        return s
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.array([rows[i] for i in some], float)
        about = x @ a.T
        off = np.sqrt((x * x).sum(1))[:, None] * norms * (x.shape[1] + 2) * 2.0**-52
        fits, passes = np.abs(about) + off < SAFE, np.abs(about) - off > 2.0**64
    own = np.where(passes, np.where(about > 0, MOST, LOWEST + 1), s[some])
    for i, j in np.argwhere(~fits & ~passes):
        exact = sum(int(u) * int(v) for u, v in zip(x[i], a[j]))
        own[i, j] = max(min(exact, MOST), LOWEST + 1)
    s[some] = own
    return s


class Top:
    """The first k rows for each of some queries: higher scores first, ties by smaller id, then row."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score, self.id, self.row = np.full((queries, k), LOWEST), np.zeros((queries, k), np.int64), np.zeros((queries, k), np.int64)

    def add(self, score: np.ndarray, fits: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """score and fits are (queries, rows)."""
        fits = fits & (score >= self.score[:, -1:])
        if fits.sum() > 4 * self.k * len(score) and score.shape[1] > self.k:
            fits &= score >= np.partition(np.where(fits, score, np.iinfo(score.dtype).min), -self.k, axis=1)[:, -self.k, None]
        q, r = np.nonzero(fits)
        if not len(q):
            return
        some, back = np.unique(q, return_inverse=True)
        query = np.concatenate([np.repeat(np.arange(len(some)), self.k), back])
        both = [np.concatenate([old[some].ravel(), new]) for old, new in ((self.score, score[q, r].astype(np.int64)), (self.id, ids[r]), (self.row, rows[r]))]
        order = np.lexsort((both[2], both[1], -both[0], query))
        order = order[np.arange(len(order)) - np.searchsorted(query[order], query[order]) < self.k]
        for own, new in zip((self.score, self.id, self.row), both):
            own[some] = new[order].reshape(-1, self.k)


def vectors(rows: DataFrame) -> DataFrame:
    """row (a number of its own), vec_id, label, dims and x, whole numbers as doubles; checkpointed."""
    v = F.col("embedding")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(~odd)
    end = float(np.finfo(float).max)
    scaled = lambda x: F.greatest(F.least(256 * x.cast("double"), F.lit(end)), F.lit(-end))
    whole_number = lambda x: F.when(F.abs(x) < 2.0**45, F.floor(scaled(x)).cast("double")).otherwise(scaled(x))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    out = whole.select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), F.size(v).alias("dims"), F.transform(v, whole_number).alias("x"))
    return cut(out.withColumn("row", F.monotonically_increasing_id()))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def packed(rows: DataFrame, bits: int, far: float = float("inf")) -> DataFrame:
    """rows with their components as packed planes; as they are, too, where their norm is `far` or more."""

    def each(batches):
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            out, wide = np.empty(batch.num_rows, object), np.full(batch.num_rows, None, object)
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                some = batch.column("x").take(pa.array(own))
                x = some.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                out[own] = [b.tobytes() for b in planes(wrapped(x), bits)]
                with np.errstate(over="ignore"):
                    for i in np.flatnonzero(np.sqrt((x * x).sum(1)) >= far):
                        wide[own[i]] = x[i].tolist()
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "vec_id", "label", "dims")], pa.array(out, pa.binary()), pa.array(wide, pa.list_(pa.float64()))], ["row", "vec_id", "label", "dims", "planes", "at_length"])

    return rows.mapInArrow(each, "row long, vec_id long, label long, dims int, planes binary, at_length array<double>")


def _met(anchors: DataFrame, rows: DataFrame, sizes: DataFrame, keys: list[str], bits: int, each, schema: str) -> DataFrame:
    """What `each` makes of every block of anchors and every block of rows of the same keys; sizes: n, the rows, and a, the anchors of each of the keys."""
    spread = max(LEAST_ROWS, min(MOST_ROWS, -(-rows.count() // (4 * partitions(rows)))))
    grid = small(cut(sizes.select(*[F.col(k).alias(f"g_{k}") for k in keys], F.ceil(F.col("a") / ANCHOR_ROWS).cast("int").alias("high"), F.ceil(F.col("n") / spread).cast("int").alias("wide")).where("a > 0")))

    def dealt(df: DataFrame, own: str, other: str, at: str, to: str) -> DataFrame:
        on = [F.col(k) == F.col(f"g_{k}") for k in keys]
        placed = df.join(grid, on, "inner").withColumn(at, F.pmod(F.xxhash64("row"), F.col(own)))
        return placed.withColumn(to, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("high", "wide", *[f"g_{k}" for k in keys])

    left, right = dealt(anchors, "high", "wide", "i", "j"), dealt(rows, "wide", "high", "j", "i")
    by = [*keys, "i", "j"]

    def block(a: pa.Table, c: pa.Table) -> pa.Table:
        if not a.num_rows or not c.num_rows:
            return each(a, None, None)
        x = _matrix(a.column("x"))
        most = int(np.abs(x).max()) * (1 << bits - 1) * x.shape[1]
        sums = subset_sums(wrapped(x).astype(np.int32 if most < 1 << 31 else np.int64))
        with np.errstate(over="ignore"):
            norms, wide = np.sqrt((x * x).sum(1)), c.column("at_length")
        told = lambda at: wide.slice(at, step).to_pylist() if wide.null_count < len(wide) else []
        raw = np.frombuffer(b"".join(c.column("planes").to_pylist()), np.uint8).reshape(c.num_rows, bits, -1)
        step = max(1, CHUNK_ROWS * ANCHOR_ROWS // len(x))
        return each(a, c, ((at, mended(scores(sums, raw[at : at + step]), x, norms, told(at))) for at in range(0, len(raw), step)))

    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(block, schema)


def mine(embeddings: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: the first rows of other labels that score between low and high percent of an anchor's positive."""
    rows = vectors(embeddings)
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, x: a + x * x))
    most, far = rows.agg(F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x")))), F.max(F.when(F.col("vec_id") % every == 0, norm))).first()
    bits = min(64, int(most or 0).bit_length() + 1)
    every_row = cut(packed(rows, bits, SAFE / max(far or 0.0, 1.0)))
    anchors = rows.where(F.col("vec_id") % every == 0)
    sizes = rows.groupBy("dims", "label").agg(F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("a"))
    kind = pa.schema([("anchor", pa.int64()), ("place", pa.int32()), ("id", pa.int64()), ("row", pa.int64()), ("score", pa.int64())])
    schema = "anchor long, place int, id long, row long, score long"

    def sent(own: np.ndarray, tops: list[Top]) -> pa.Table:
        parts = [[], [], [], [], []]
        for place, top in enumerate(tops):
            q, r = np.nonzero(top.score > LOWEST)
            for part, x in zip(parts, (own[q], np.full(len(q), place, np.int32), top.id[q, r], top.row[q, r], top.score[q, r])):
                part.append(x)
        return pa.table([pa.array(np.concatenate(p)) for p in parts], kind)

    def near(a: pa.Table, c: pa.Table | None, found) -> pa.Table:
        if c is None:
            return kind.empty_table()
        own, ids, row = a.column("row").to_numpy(), c.column("vec_id").to_numpy(), c.column("row").to_numpy()
        top = Top(len(own), positives)
        for at, s in found:
            part = slice(at, at + len(s))
            top.add(s.T, own[:, None] != row[part], ids[part], row[part])
        return sent(own, [top])

    first = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id", "row")
    best = _met(anchors, every_row, sizes, ["dims", "label"], bits, near, schema).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= positives)
    own = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))  # at most `positives`
    asked = cut(anchors.join(own, F.col("row") == F.col("anchor")).select("row", "vec_id", "label", "dims", "x", F.transform("p", lambda p: p.score).alias("p_scores"), F.transform("p", lambda p: p.id).alias("p_ids")))

    def hard(a: pa.Table, c: pa.Table | None, found) -> pa.Table:
        if c is None:
            return kind.empty_table()
        own, ids, row = a.column("row").to_numpy(), c.column("vec_id").to_numpy(), c.column("row").to_numpy()
        other = a.column("label").to_numpy()[:, None] != c.column("label").to_numpy()
        lists = a.column("p_scores").to_pylist()
        tops, limits = [], []
        for place in range(positives):
            p = [x[place] if place < len(x) else -1 for x in lists]  # below zero nothing fits
            limits.append((np.array([-(-low * x // 100) for x in p])[:, None], np.array([high * x // 100 for x in p])[:, None]))
            tops.append(Top(len(own), negatives))
        for at, s in found:
            part, s = slice(at, at + len(s)), s.T
            for top, (least, most) in zip(tops, limits):
                top.add(s, (s >= least) & (s <= most) & other[:, part], ids[part], row[part])
        return sent(own, tops)

    sizes = every_row.groupBy("dims").agg(F.count("*").alias("n")).join(asked.groupBy(F.col("dims").alias("d")).agg(F.count("*").alias("a")), F.col("dims") == F.col("d"))
    met = _met(asked, every_row, sizes, ["dims"], bits, hard, schema).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    told = asked.select("row", F.col("vec_id").alias("anchor_id"), F.posexplode(F.arrays_zip("p_ids", "p_scores")).alias("p_place", "p"))
    out = met.drop("row").join(told, (F.col("anchor") == F.col("row")) & (F.col("place") == F.col("p_place")))
    return out.select("anchor_id", F.col("p.p_ids").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("p.p_scores").alias("positive_score"), F.col("score").alias("negative_score"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


#: DuckDB SQL for op13_negatives.
ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)::INT AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3
"""
