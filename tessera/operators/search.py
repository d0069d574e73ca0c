"""Exact nearest-neighbour and range search of a stated set of queries among all rows, by a partitioned join, and an index for it.

Rows are (id, v). They are dealt to cells by a tree of halves, as many cells as keep them of one size, and a large cell
to blocks. A query is sent to those cells only that may hold a row within its limit: a bound from the triangle
inequality and the cell's box of values (for warping distances, from the query's envelope and the box) says so. The
limit is the k-th distance within the query's own cell or a sample of rows, or the radius asked for. A task holds one
block of rows and streams its queries past it, so nothing passes through the driver but the sample and a row a cell. Windows of series have the id series * 2**32 + start; windows of several
lengths can be searched together, as the length of v tells them apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.dtw import across, banded, reach
from tessera.operators.windows import sliding
from tessera.plans.rounds import checkpointed

SHIFT = 1 << 32
#: Pairs whose distances a task holds at a time, and of those that are warped.
BLOCK_PAIRS, WARP_PAIRS = 1 << 21, 1 << 16
#: Of all windows, those are queries whose id this divides.
EVERY = 50
#: Rows by which limits are set, rows of a cell, about, and rows a cell by which it is cut, of CUT_ROWS at most; rows of a block, and queries that meet a block in one task, at most.
SAMPLE_ROWS, CELL_ROWS, CELL_SAMPLE, CUT_ROWS, BLOCK_ROWS, SLICE_ROWS = 1024, 2048, 8, 65_536, 16_384, 65_536
#: Cells of a small table.
PIVOTS = 64
#: Where cells lie together in a task: its rows at most, rows of a pack, queries that meet them at a time, and pairs that it keeps before it drops all but the first k of a query.
GROUP_ROWS, PACK_ROWS, GROUP_ASKS, KEPT_PAIRS = 65_536, 512, 1024, 1 << 21
#: A query's nearest packs, which bring its limit down before others are met.
FIRST_PACKS = 8
#: Rows of a block where all pairs are met.
FAR_ROWS = 16_384
#: Pairs that are tested at a time, by a product of matrices and by an envelope.
GEMM_PAIRS, BOUND_PAIRS = 1 << 18, 1 << 16


def packed(series: str, start: str) -> Column:
    return F.col(series).cast("long") * SHIFT + F.col(start)


def unpacked(id_: str, series: str, start: str) -> list[Column]:
    """Two columns: the series and the start of a window's id."""
    return [F.floor(F.col(id_) / SHIFT).cast("long").alias(series), F.pmod(F.col(id_), F.lit(SHIFT)).cast("int").alias(start)]


def windows(rows: DataFrame, size: int = 8, value: str = "x") -> DataFrame:
    """id and v of every window of `size` frames of every series."""
    return sliding(rows, size, 1, value).select(packed("series_id", "start").alias("id"), F.col("xs").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _tiled(n: int, m: int, pairs: int, fits: Callable[[int, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the n x m pairs that fit, tested a few rows at a time, so that they stay in a core's cache."""
    step, a, b = max(1, pairs // m), [np.zeros(0, int)], [np.zeros(0, int)]
    for i in range(0, n, step):
        row, column = np.divmod(np.flatnonzero(fits(i, min(i + step, n))), m)
        a.append(row + i)
        b.append(column)
    return np.concatenate(a), np.concatenate(b)


class Euclid:
    """Distances of queries to rows: the root of the sum of squares, added from the first dimension on. Vectors of two lengths are infinitely far."""

    def __init__(self, root: bool = True):
        self.root = root

    def __call__(self, q: np.ndarray, x: np.ndarray, barred: np.ndarray | None = None, limit: np.ndarray | None = None, k: int = 0) -> np.ndarray:
        if q.shape[1] != x.shape[1]:
            return np.full((len(q), len(x)), np.inf)
        out = np.zeros((len(q), len(x)))
        for i in range(q.shape[1]):
            step = q[:, i, None] - x[:, i]
            out += step * step
        out = np.sqrt(out) if self.root else out
        if barred is not None:
            out[barred] = np.inf
        return out

    upper = __call__

    def close(self, q: np.ndarray, x: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """a, b and the distances of the pairs of queries and rows that lie within each query's limit. Products of matrices leave out the pairs that are surely farther."""
        if q.shape[1] != x.shape[1] or not len(x):
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        with np.errstate(all="ignore"):  # values beyond single precision leave out no pair
            middle = x.mean(0)
            cq, cx = q - middle, x - middle
            unit = max(float(np.abs(cq).max(initial=0.0)), float(np.abs(cx).max()), 1e-100)
            cq, cx = cq / unit, cx / unit
            qq, xx = (cq * cq).sum(1), (cx * cx).sum(1)
            most = (self.squared(limit, x.shape[1]) * (1 + 1e-9) + 1e-9) / unit / unit
            most = (most - qq + 2e-7 * (x.shape[1] + 8) * (qq + xx.max()) + 1e-30).astype(np.float32)
            left, right = np.column_stack([-2 * cq, np.ones(len(q))]).astype(np.float32), np.column_stack([cx, xx]).astype(np.float32).T
            a, b = _tiled(len(q), len(x), GEMM_PAIRS, lambda i, j: ~(left[i:j] @ right > most[i:j, None]))
        dist = np.concatenate([self.paired(q[a[i : i + BLOCK_PAIRS]], x[b[i : i + BLOCK_PAIRS]]) for i in range(0, len(a), BLOCK_PAIRS)] or [np.zeros(0)])
        own = dist <= limit[a]
        return a[own], b[own], dist[own]

    def squared(self, limit: np.ndarray, size: int) -> np.ndarray:
        """Limits as sums of squares."""
        return limit * limit if self.root else limit

    def envelope(self, q: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        return q, q

    def paired(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(q))
        for i in range(q.shape[1]):
            step = q[:, i] - x[:, i]
            out += step * step
        return np.sqrt(out) if self.root else out

    def least(self, q: np.ndarray, cell: Cell) -> np.ndarray:
        """For each query a bound below its distances to all rows of a cell."""
        if q.shape[1] != len(cell.pivot):
            return np.full(len(q), np.inf)
        out = np.maximum(np.maximum(cell.low - q, q - cell.high), 0)
        out = np.maximum(np.sqrt((out * out).sum(1)), np.sqrt(((q - cell.pivot) ** 2).sum(1)) - cell.radius)
        return out if self.root else np.maximum(out, 0) ** 2


class Warped:
    """Banded warping distances by the longer length. Only pairs are warped whose lower bound does not pass `limit`, a row for each query: the rest are infinite."""

    def __init__(self, share: float = 0.1):
        self.share = share

    def envelope(self, q: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest value of each query that each place of a row of `size` may meet."""
        ends = reach(q.shape[1], size, self.share)
        return np.stack([q[:, a : b + 1].min(1) for a, b in ends], axis=1), np.stack([q[:, a : b + 1].max(1) for a, b in ends], axis=1)

    def squared(self, limit: np.ndarray, size: int) -> np.ndarray:
        """Limits as sums of squares, size being the longer length."""
        return limit * size

    def bound(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Squared distances of each row from the envelope of each query within the band."""
        low, high = self.envelope(q, x.shape[1])
        out = np.zeros((len(q), len(x)))
        for i in range(x.shape[1]):
            step = np.maximum(np.maximum(x[:, i] - high[:, i, None], low[:, i, None] - x[:, i]), 0)
            out += step * step
        return out

    def least(self, q: np.ndarray, cell: Cell) -> np.ndarray:
        low, high = self.envelope(q, len(cell.low))
        out = np.maximum(np.maximum(cell.low - high, low - cell.high), 0)
        return (out * out).sum(1) / max(q.shape[1], len(cell.low))

    def upper(self, q: np.ndarray, x: np.ndarray, barred: np.ndarray | None = None) -> np.ndarray:
        """The cost of the path along the diagonal, which no warping passes."""
        n = max(q.shape[1], x.shape[1])
        at = lambda size: np.rint(np.arange(n) * (size - 1) / max(n - 1, 1)).astype(int)
        out = Euclid(root=False)(q[:, at(q.shape[1])], x[:, at(x.shape[1])]) / n
        if barred is not None:
            out[barred] = np.inf
        return out

    def warp(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        size = max(q.shape[1], x.shape[1])
        return np.concatenate([banded(q[i : i + WARP_PAIRS], x[i : i + WARP_PAIRS], self.share) / size for i in range(0, len(q), WARP_PAIRS)] or [np.zeros(0)])

    def __call__(self, q: np.ndarray, x: np.ndarray, barred: np.ndarray | None = None, limit: np.ndarray | None = None, k: int = 0) -> np.ndarray:
        if limit is None and not k:  # all pairs
            out = across(q, x, self.share) / max(q.shape[1], x.shape[1])
            if barred is not None:
                out[barred] = np.inf
            return out
        bound, out = self.bound(q, x) / max(q.shape[1], x.shape[1]), np.full((len(q), len(x)), np.inf)
        limit = np.full(len(q), np.inf) if limit is None else limit
        if barred is not None:
            bound[barred] = np.inf
        if k and len(x) > k:  # the k rows of least bound give a first limit
            first = np.argpartition(bound, k - 1, axis=1)[:, :k]
            a, b = np.repeat(np.arange(len(q)), k), first.ravel()
            far = np.where(np.isfinite(bound[a, b]), self.warp(q[a], x[b]), np.inf)
            limit = np.minimum(limit, far.reshape(len(q), k).max(1))
        a, b = np.nonzero((bound <= limit[:, None] * (1 + 1e-12)) & np.isfinite(bound))
        out[a, b] = self.warp(q[a], x[b])
        return out

    def close(self, q: np.ndarray, x: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """a, b and the distances of the pairs of queries and rows that lie within each query's limit."""
        if not len(x):
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        with np.errstate(all="ignore"):
            low, high = (e.astype(np.float32) for e in self.envelope(q, x.shape[1]))
            slack = 1e-6 * x.shape[1] ** 0.5 * np.maximum(np.abs(q).max(1), np.abs(x).max())
            most = ((np.sqrt(self.squared(limit, max(q.shape[1], x.shape[1]))) * (1 + 1e-5) + slack) ** 2).astype(np.float32)
            columns = np.ascontiguousarray(x.T.astype(np.float32))

            def fits(i: int, j: int) -> np.ndarray:
                out = np.zeros((j - i, len(x)), np.float32)
                for at, column in enumerate(columns):
                    step, under = column - high[i:j, at, None], low[i:j, at, None] - column
                    np.maximum(step, under, out=step)
                    np.maximum(step, 0, out=step)
                    step *= step
                    out += step
                return ~(out > most[i:j, None])

            a, b = _tiled(len(q), len(x), BOUND_PAIRS, fits)
            if len(a) > 4 * len(x):  # the rows' envelopes leave out more
                low, high = (e.astype(np.float32) for e in self.envelope(x, q.shape[1]))
                kept = []
                for at in range(0, len(a), BOUND_PAIRS):
                    i, j = a[at : at + BOUND_PAIRS], b[at : at + BOUND_PAIRS]
                    out = np.zeros(len(i), np.float32)
                    for place, column in enumerate(np.ascontiguousarray(q.T.astype(np.float32))):
                        own = column[i]
                        step = np.maximum(np.maximum(own - high[j, place], low[j, place] - own), 0)
                        out += step * step
                    kept.append(~(out > most[i]))
                kept = np.concatenate(kept)
                a, b = a[kept], b[kept]
        dist = self.warp(q[a], x[b])
        own = dist <= limit[a]
        return a[own], b[own], dist[own]


#: The distances that a search can be asked for by name.
METRICS = {"l2": Euclid(), "ssd": Euclid(root=False), "dtw": Warped()}


def _overlap(ids: np.ndarray, n: int, own: np.ndarray, m: int, apart: bool | None) -> np.ndarray:
    """As `_barred`, for ids and own row by row."""
    if apart is None:
        return np.zeros(len(ids), bool)
    if not apart:
        return (ids == own) & (n == m)
    gap = ids % SHIFT - own % SHIFT
    return (ids // SHIFT == own // SHIFT) & (gap < m) & (gap > -n)


def _barred(ids: np.ndarray, n: int, own: np.ndarray, m: int, apart: bool | None) -> np.ndarray:
    """Pairs that are no neighbours: a row and itself, or windows of one series, n and m frames long, that overlap. None bars none."""
    if apart is None:
        return np.zeros((len(ids), len(own)), bool)
    if not apart:
        return (ids[:, None] == own) & (n == m)
    gap = ids[:, None] % SHIFT - own % SHIFT
    return ((ids[:, None] // SHIFT) == own // SHIFT) & (gap < m) & (gap > -n)


@dataclass
class Cell:
    """Rows about a pivot: how far the farthest is, and the least and greatest value at each place."""

    pivot: np.ndarray
    rows: int
    radius: float
    low: np.ndarray
    high: np.ndarray


def pivots(table: DataFrame, n: int) -> DataFrame:
    """A bounded sample of rows: the n rows whose ids have the least hashes."""
    return table.orderBy(F.xxhash64("id"), "id").limit(n)


class Tree:
    """Halves of halves: at each node rows go by whether their value at a place is over the sample's median there, the place being that of the greatest variance, times its weight."""

    def __init__(self, sample: np.ndarray, depth: int, weights: np.ndarray | float = 1.0):
        self.depth = depth
        inner = (1 << depth) - 1
        self.place, self.cut = np.zeros(inner, int), np.full(inner, np.inf)
        self.middle = np.zeros((1 << depth, sample.shape[1]))
        held = {0: np.arange(len(sample))}
        for node in range(inner):
            own = held.pop(node)
            x = sample[own]
            if len(own):
                self.place[node] = i = int((x.var(0) * weights).argmax())
                self.cut[node] = np.median(x[:, i])
            over = x[:, self.place[node]] > self.cut[node]
            held[2 * node + 1], held[2 * node + 2] = own[~over], own[over]
        for leaf, own in held.items():
            self.middle[leaf - inner] = sample[own].mean(0) if len(own) else 0.0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node, at = np.zeros(len(x), int), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[at, self.place[node]] > self.cut[node])
        return node - len(self.cut)


@dataclass
class Cells:
    """A table dealt to cells: rows (id, v, cell), checkpointed, the cells, the sample of rows, as ids and values by length, and by length the tree and the number of its first cell."""

    rows: DataFrame
    cells: list[Cell]
    sample: list[tuple[np.ndarray, np.ndarray]]
    trees: dict[int, tuple[Tree, int]] = field(default_factory=dict)


def celled(table: DataFrame, sizes: tuple[int, ...] = (), weights: np.ndarray | float = 1.0) -> Cells:
    """The rows (id, v) of a table dealt to the leaves of a tree for their length, about `CELL_ROWS` to each. sizes: the lengths of v, where there are several; rows of others, and without v, are left out."""
    table = checkpointed(table.select("id", "v").where("v is not null"))
    parts = [table.where(F.size("v") == s) for s in sizes] or [table]
    taken, trees, first = [], {}, [0]
    for part in parts:
        total = part.count()
        depth = (max(PIVOTS, -(-total // CELL_ROWS)) - 1).bit_length()
        if len(got := pivots(part, min(CUT_ROWS, max(SAMPLE_ROWS, CELL_SAMPLE << depth))).toArrow()):
            own = pc.list_value_length(got.column("v"))
            got = got.filter(pc.equal(own, own[0]))
            ids, x = got.column("id").to_numpy(), _matrix(got.column("v"))
            taken.append((ids[:SAMPLE_ROWS], x[:SAMPLE_ROWS]))
            trees[x.shape[1]] = Tree(x, depth, weights), first[-1]
            first.append(first[-1] + (1 << depth))
    chosen = [t.middle for t, _ in trees.values()]
    near = Euclid()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _by_length(batch):
                x = _matrix(some.column("v"))
                if x.shape[1] not in trees:
                    continue
                tree, base = trees[x.shape[1]]
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("v"), pa.array((tree(x) + base).astype(np.int32))], ["id", "v", "cell"])

    rows = checkpointed(table.mapInArrow(deal, "id long, v array<double>, cell int"))

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each cell of which a task has rows."""
        ends: dict[int, tuple[np.ndarray, ...]] = {}
        for batch in batches:
            for some in _by_length(batch):
                x, cells = _matrix(some.column("v")), some.column("cell").to_numpy()
                if not len(x):
                    continue
                i = int(np.searchsorted(first, cells[0], "right")) - 1
                p = chosen[i]
                if i not in ends:
                    ends[i] = (np.zeros(len(p), np.int64), np.zeros(len(p)), np.full(p.shape, np.inf), np.full(p.shape, -np.inf))
                n, far, low, high = ends[i]
                order = np.argsort(cells, kind="stable")
                x, cells = x[order], cells[order] - first[i]
                new = np.flatnonzero(np.diff(cells, prepend=-1))
                c = cells[new]
                n[c] += np.diff(np.append(new, len(x)))
                far[c] = np.maximum(far[c], np.maximum.reduceat(near.paired(x, p[cells]), new))
                low[c], high[c] = np.minimum(low[c], np.minimum.reduceat(x, new, axis=0)), np.maximum(high[c], np.maximum.reduceat(x, new, axis=0))
        for i, (n, far, low, high) in ends.items():
            c = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"cell": pa.array((c + first[i]).astype(np.int32)), "n": n[c], "far": far[c], "low": list(low[c]), "high": list(high[c])})

    ends = rows.mapInArrow(boxes, "cell int, n long, far double, low array<double>, high array<double>")
    each = ends.select("cell", "n", "far", F.posexplode(F.arrays_zip("low", "high")).alias("i", "b")).groupBy("cell", "i").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.min("b.low").alias("low"), F.max("b.high").alias("high"))
    found = each.groupBy("cell").agg(F.first("n").alias("n"), F.max("far").alias("far"), F.sort_array(F.collect_list(F.struct("i", "low", "high"))).alias("b")).collect()  # a row a cell
    held = {r["cell"]: r for r in found}
    cells = []
    for i, points in enumerate(chosen):
        for k, p in enumerate(points):
            r = held.get(int(first[i]) + k)
            cells.append(Cell(p, r["n"], r["far"], np.array([b["low"] for b in r["b"]]), np.array([b["high"] for b in r["b"]])) if r else Cell(p, 0, 0.0, p, p))
    return Cells(rows, cells, taken, trees)


def _by_length(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch whose arrays v are of one length, for each length."""
    sizes = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
    for s in np.unique(sizes):
        yield batch if (sizes == s).all() else batch.filter(pa.array(sizes == s))


def asked(table: DataFrame | Cells, every: int = EVERY) -> DataFrame:
    """The queries of a table: rows whose id `every` divides."""
    rows = table.rows.drop("cell") if isinstance(table, Cells) else table
    return rows.where(F.col("id") % every == 0)


Block = tuple[np.ndarray, np.ndarray, pa.Table]


def _streamed(rows: DataFrame, queries: DataFrame, blocks: int, each: Callable[[Block, Block], Iterator[pa.RecordBatch]], schema: str, packed: bool = False) -> DataFrame:
    """What `each` makes of every block of rows (at, id, v) and the queries (at, id, v) sent to it, a batch of queries of one length at a time.

    Rows and queries are sorted by block, rows first; queries in slices of about SLICE_ROWS a block, to each of which the
    rows are sent. Other columns of the two are passed on; those that the other lacks are null. packed: `each` is given
    rows as `Packs`.
    """
    n = -(-queries.count() // (SLICE_ROWS * max(blocks, 1))) or 1
    left = rows.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("asks", F.lit(False))
    right = queries.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("asks", F.lit(True))
    parts = [min(max(blocks * n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 2000)] if packed else []
    both = left.unionByName(right, allowMissingColumns=True).repartition(*parts, "at", "slice").sortWithinPartitions("at", "slice", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept, block = None, [], None
        for batch in batches:
            at, part, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "slice", "asks"))
            new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1])])) if len(at) else []
            for a, b in zip(new, [*new[1:], len(at)]):
                own = batch.slice(a, b - a)
                if not asks[a]:
                    if key != (at[a], part[a]):
                        key, kept = (at[a], part[a]), []
                    kept.append(own)
                    block = None
                elif key == (at[a], part[a]):
                    block = block or (Packs if packed else tuple)(_block(pa.Table.from_batches(kept)))
                    for some in _by_length(own):
                        q = _block(pa.Table.from_batches([some]))
                        step = GROUP_ASKS if packed else max(1, BLOCK_PAIRS // len(block[0]))
                        for i in range(0, len(q[0]), step):
                            yield from each(block, (q[0][i : i + step], q[1][i : i + step], q[2].slice(i, step)))

    return both.mapInArrow(run, schema)


def _block(rows: pa.Table) -> Block:
    return rows.column("id").to_numpy(), _matrix(rows.column("v")), rows


class Packs:
    """A block's rows in packs that lie together, cut at medians until PACK_ROWS are left, and the box of each."""

    def __init__(self, block: Block):
        ids, x, _ = block
        self.parts, left = [], [np.arange(len(x))]
        while left:
            own = left.pop()
            if len(own) <= PACK_ROWS:
                self.parts.append((ids[own], x[own]))
                continue
            part = x[own]
            order = np.argpartition(part[:, part.var(0).argmax()], len(own) // 2)
            left += [own[order[len(own) // 2 :]], own[order[: len(own) // 2]]]
        self.low, self.high = np.stack([x.min(0) for _, x in self.parts]), np.stack([x.max(0) for _, x in self.parts])

    def near(self, measure, ids: np.ndarray, q: np.ndarray, limit: np.ndarray, k: int, apart: bool | None, home: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """a, ids and distances of the first k rows of each query, of those within its limit. home: the limit comes down to the k-th distance to the rows of the pack that is nearest first."""
        n, m = q.shape[1], self.low.shape[1]
        none = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)
        if n != m and isinstance(measure, Euclid):
            return none
        low, high = measure.envelope(q, m)
        bound = np.zeros((len(q), len(self.parts)))
        for i in range(m):
            step = np.maximum(np.maximum(self.low[:, i] - high[:, i, None], low[:, i, None] - self.high[:, i]), 0)
            bound += step * step
        if home:
            limit, nearest = limit.copy(), bound.argmin(1)
            for p in np.unique(nearest):
                own, x = self.parts[p]
                a = np.flatnonzero(nearest == p)
                limit[a] = np.minimum(limit[a], _kth(measure.upper(q[a], x, _barred(ids[a], n, own, m, apart)), own, k, False))
        limit = limit * (1 + 1e-9) + 1e-9
        held, seen = [none], np.zeros(bound.shape, bool)

        def meet(p: int, fits: np.ndarray) -> int:
            own, x = self.parts[p]
            a, b, dist = measure.close(q[fits], x, limit[fits])
            a, b = fits[a], own[b]
            ok = np.isfinite(dist) & ~_overlap(ids[a], n, b, m, apart)
            held.append((a[ok], b[ok], dist[ok]))
            seen[fits, p] = True
            return len(held[-1][0])

        def lowered() -> np.ndarray:
            """Keeps the first k, brings limits down to the k-th, and gives them as sums of squares."""
            held[:] = [_least(held, k)]
            a, _, dist = held[0]
            last = np.flatnonzero(np.arange(len(a)) - np.searchsorted(a, a) == k - 1)
            limit[a[last]] = np.minimum(limit[a[last]], dist[last] * (1 + 1e-9) + 1e-9)
            return measure.squared(limit, max(n, m)) * (1 + 1e-9) + 1e-9

        most = lowered()
        first = np.argsort(bound, axis=1)[:, :FIRST_PACKS] if len(self.parts) > FIRST_PACKS else np.zeros((len(q), 0), int)
        for at in first.T:  # each query's nearest packs, before others
            fits = bound[np.arange(len(q)), at] <= most
            for p in np.unique(at[fits]):
                meet(p, np.flatnonzero(fits & (at == p)))
            most = lowered()
        rows = 0
        for p in range(len(self.parts)):
            fits = np.flatnonzero((bound[:, p] <= most) & ~seen[:, p])
            if len(fits):
                rows += meet(p, fits)
                if rows > len(q) * k + KEPT_PAIRS // 16:
                    most, rows = lowered(), 0
        return _least(held, k)

    def summed(self, measure, ids: np.ndarray, q: np.ndarray, limit: np.ndarray, apart: bool | None, share: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each query the sum of the shares of distances within its limit, and how many there are."""
        total, count = np.zeros(len(q)), np.zeros(len(q), np.int64)
        for p, (own, x) in enumerate(self.parts):
            out = np.maximum(np.maximum(self.low[p] - q, q - self.high[p]), 0)
            fits = np.flatnonzero((out * out).sum(1) <= measure.squared(limit, q.shape[1]) * (1 + 1e-9) + 1e-9)
            if len(fits):
                a, b, dist = measure.close(q[fits], x, limit[fits])
                a = fits[a]
                ok = np.isfinite(dist) & ~_overlap(ids[a], q.shape[1], own[b], x.shape[1], apart)
                total += np.bincount(a[ok], share(dist[ok]), len(q))
                count += np.bincount(a[ok], minlength=len(q))
        return total, count


def _least(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each query, by distance and id."""
    a, b, dist = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((b, dist, a))
    a, b, dist = a[order], b[order], dist[order]
    first = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[first], b[first], dist[first]


def _size(n: int, df: DataFrame, most: int = 0) -> int:
    """Rows of a block: as many as keep all partitions busy, but `most` (BLOCK_ROWS) at most."""
    return min(most or BLOCK_ROWS, max(1024, -(-n // (2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))))


def _grouped(cells: Cells, size: int) -> tuple[list[int], list[int], int]:
    """Blocks of each cell, the number of its first, and all blocks: neighbouring cells of one tree share a block while it has room."""
    starts, blocks, first, at, room = {base for _, base in cells.trees.values()}, [], [], -1, 0
    for i, c in enumerate(cells.cells):
        room = 0 if i in starts else room
        n = -(-c.rows // size)
        if n and (n > 1 or c.rows > room):
            first.append(at + 1)
            at, room = at + n, size - c.rows if n == 1 else 0
        else:
            first.append(max(at, 0))
            room -= c.rows
        blocks.append(n)
    return blocks, first, at + 1


def _to_cells(queries: DataFrame, cells: Cells, visits: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], each, schema: str, packed: bool = False) -> DataFrame:
    """What `each` makes of the blocks of those cells that a query visits: `visits` gives, of ids, vectors and limits so far, (queries, cells) and the limit of each query. packed: cells that lie together share a block, given as `Packs`."""
    total = sum(c.rows for c in cells.cells)
    if packed:
        blocks, first, n = _grouped(cells, _size(total, queries, GROUP_ROWS))
    else:
        size = _size(total, queries)
        blocks = [-(-c.rows // size) for c in cells.cells]
        first, n = np.cumsum([0, *blocks]).tolist()[:-1], sum(blocks)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _by_length(batch):
                q, ids = _matrix(some.column("v")), some.column("id").to_numpy()
                fits, limit = visits(ids, q, some.column("limit").to_numpy(zero_copy_only=False))
                where = [np.unique(np.concatenate([np.arange(first[c], first[c] + blocks[c]) for c in np.flatnonzero(f)] or [np.zeros(0, int)])) for f in fits]
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("v"), pa.array(limit), pa.array(where, pa.list_(pa.int64()))], ["id", "v", "limit", "ats"])

    given = F.coalesce("limit", F.lit(float("inf"))) if "limit" in queries.columns else F.lit(float("inf"))
    sent = checkpointed(queries.select("id", "v", given.alias("limit")).where("v is not null").mapInArrow(choose, "id long, v array<double>, limit double, ats array<long>"))
    sent = sent.select(F.explode("ats").alias("at"), "id", "v", "limit")
    own = F.pmod(F.xxhash64("id"), F.get(F.lit(blocks), F.col("cell"))) + F.get(F.lit(first), F.col("cell"))
    return _streamed(cells.rows.select(own.cast("long").alias("at"), "id", "v"), sent, n, each, schema, **({"packed": True} if packed else {}))


def _kth(far: np.ndarray, own: np.ndarray, k: int, per_series: bool) -> np.ndarray:
    """The k-th least distance of each query to the rows `own`, or to the k-th nearest of their series; infinite where there are fewer."""
    if per_series and len(own):
        order = np.argsort(own // SHIFT, kind="stable")
        far = np.minimum.reduceat(far[:, order], np.flatnonzero(np.diff(own[order] // SHIFT, prepend=-1 - (1 << 62))), axis=1)
    return np.partition(far, k - 1, axis=1)[:, k - 1] if far.shape[1] >= k else np.full(len(far), np.inf)


def _limited(measure, cells: Cells, k: int, apart: bool, per_series: bool = False):
    """Visits to the cells that may hold one of the k nearest rows, or a row of the k nearest series."""
    held, sample = cells.cells, cells.sample

    def visits(ids: np.ndarray, q: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = np.concatenate([measure.upper(q, x, _barred(ids, q.shape[1], own, x.shape[1], apart)) for own, x in sample] or [np.zeros((len(q), 0))], axis=1)
        limit = np.minimum(limit, _kth(far, np.concatenate([own for own, _ in sample] or [np.zeros(0, np.int64)]), k, per_series))
        return _within(measure, held, q, limit), limit

    return visits


def _at_home(queries: DataFrame, measure, cells: Cells, k: int, apart: bool, per_series: bool = False) -> DataFrame:
    """Queries (id, v) with `limit`, the k-th distance, or what it surely does not pass, to the rows (or series) of the query's own cell, where there are as many."""
    trees, n = cells.trees, len(cells.cells)
    held = np.array([c.rows > 0 for c in cells.cells])

    def visits(ids: np.ndarray, q: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fits = np.zeros((len(q), n), bool)
        if q.shape[1] in trees:
            tree, base = trees[q.shape[1]]
            fits[np.arange(len(q)), tree(q) + base] = True
        return fits & held, limit

    def each(rows: Block, asks: Block) -> Iterator[pa.RecordBatch]:
        (own, x, _), (ids, q, _) = rows, asks
        if len(x) >= k:
            far = _kth(measure.upper(q, x, _barred(ids, q.shape[1], own, x.shape[1], apart)), own, k, per_series)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), q.shape[1], np.int32)), pa.array(far)], ["id", "len", "limit"])

    def packed(rows: Packs, asks: Block) -> Iterator[pa.RecordBatch]:
        ids, q, given = asks
        a, _, dist = rows.near(measure, ids, q, given.column("limit").to_numpy(), k, apart, True)
        last = np.flatnonzero(np.arange(len(a)) - np.searchsorted(a, a) == k - 1)
        yield pa.RecordBatch.from_arrays([pa.array(ids[a[last]]), pa.array(np.full(len(last), q.shape[1], np.int32)), pa.array(dist[last])], ["id", "len", "limit"])

    near = _to_cells(queries, cells, visits, each if per_series else packed, "id long, len int, limit double", not per_series).groupBy("id", "len").agg(F.min("limit").alias("limit"))
    return queries.select("id", "v", F.size("v").alias("len")).join(near, ["id", "len"], "left").drop("len")


def _within(measure, cells: list[Cell], q: np.ndarray, limit: np.ndarray) -> np.ndarray:
    out = np.zeros((len(q), len(cells)), bool)
    for i, c in enumerate(cells):
        if c.rows:
            out[:, i] = measure.least(q, c) <= limit * (1 + 1e-9) + 1e-9
    return out


FOUND = "id long, len int, nbr long, nbr_len int, dist double"


def _found(ids: np.ndarray, n: int, own: np.ndarray, m: int, dist: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), n, np.int32)), pa.array(own), pa.array(np.full(len(ids), m, np.int32)), pa.array(dist)], ["id", "len", "nbr", "nbr_len", "dist"])


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id", "len").orderBy("dist", "nbr", "nbr_len")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_any(queries: DataFrame, table: DataFrame | Cells, k: int, metric: str = "dtw", apart: bool = True, sizes: tuple[int, ...] = ()) -> DataFrame:
    """id, len, nbr, nbr_len, dist and rank: as `nearest`, for windows of several lengths (`sizes`) in one search."""
    measure, cells = METRICS[metric], table if isinstance(table, Cells) else celled(table, sizes)

    def each(rows: Packs, asks: Block) -> Iterator[pa.RecordBatch]:
        ids, q, given = asks
        a, nbr, dist = rows.near(measure, ids, q, given.column("limit").to_numpy(), k, apart)
        yield _found(ids[a], q.shape[1], nbr, rows.low.shape[1], dist)

    queries = checkpointed(_at_home(queries, measure, cells, k, apart))
    return _first(_to_cells(queries, cells, _limited(measure, cells, k, apart), each, FOUND, True), k)


def nearest(queries: DataFrame, table: DataFrame | Cells, k: int, metric: str = "l2", apart: int = 0) -> DataFrame:
    """id, nbr, dist and rank: the k nearest rows of the table to each query, ties by the smaller id. apart: windows that overlap the query are none of them."""
    return nearest_any(queries, table, k, metric, bool(apart)).select("id", "nbr", "dist", "rank")


def within(queries: DataFrame, table: DataFrame | Cells, radius: float, metric: str = "l2", apart: int = 0) -> DataFrame:
    """id, nbr and dist: all rows of the table that lie within `radius` of a query."""
    measure, cells = METRICS[metric], table if isinstance(table, Cells) else celled(table)
    held = cells.cells

    def visits(ids: np.ndarray, q: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        limit = np.full(len(q), radius)
        return _within(measure, held, q, limit), limit

    def each(rows: Block, asks: Block) -> Iterator[pa.RecordBatch]:
        (own, x, _), (ids, q, _) = rows, asks
        a, b, dist = measure.close(q, x, np.full(len(q), radius))
        ok = ~_overlap(ids[a], q.shape[1], own[b], x.shape[1], bool(apart))
        a, b, dist = a[ok], b[ok], dist[ok]
        yield _found(ids[a], q.shape[1], own[b], x.shape[1], dist)

    return _to_cells(queries, cells, visits, each, FOUND).select("id", "nbr", "dist")


def with_near(queries: DataFrame, table: DataFrame | Cells, radius: float, metric: str = "l2", apart: int = 0) -> DataFrame:
    """id: those of the queries that have a row of the table within `radius`."""
    measure, cells = METRICS[metric], table if isinstance(table, Cells) else celled(table)
    held = cells.cells

    def visits(ids: np.ndarray, q: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        limit = np.full(len(q), radius)
        return _within(measure, held, q, limit), limit

    def each(rows: Packs, asks: Block) -> Iterator[pa.RecordBatch]:
        ids, q, given = asks
        a, _, dist = rows.near(measure, ids, q, given.column("limit").to_numpy(), 1, bool(apart))
        yield pa.RecordBatch.from_arrays([pa.array(ids[a[dist <= radius]])], ["id"])

    return _to_cells(queries, cells, visits, each, "id long", True).distinct()


def densities(queries: DataFrame, table: DataFrame | Cells, radius: float, apart: int = 0) -> DataFrame:
    """id and density of the queries that have rows within `radius`: the sum of a Gaussian of variance radius / 3 over these.

    Tasks send a sum a query and block. Rows so far that all of a table's together would not change a double are left
    out: those whose share is below 1e-17 / rows of that of the nearest row in the query's own block.
    """
    measure, cells = METRICS["l2"], table if isinstance(table, Cells) else celled(table)
    held, spread = cells.cells, 2 * radius / 3
    beyond = spread * float(np.log(1e17 * (sum(c.rows for c in held) + 1)))

    def visits(ids: np.ndarray, q: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        limit = np.minimum(radius, np.sqrt(limit * limit + beyond))
        return _within(measure, held, q, limit), limit

    def each(rows: Packs, asks: Block) -> Iterator[pa.RecordBatch]:
        ids, q, given = asks
        total, n = rows.summed(measure, ids, q, given.column("limit").to_numpy(), bool(apart), lambda dist: np.exp(-dist * dist / spread))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(total[some])], ["id", "density"])

    queries = checkpointed(_at_home(queries, measure, cells, 1, bool(apart)))
    return _to_cells(queries, cells, visits, each, "id long, density double", True).groupBy("id").agg(F.sum("density").alias("density"))


def near_ids(queries: DataFrame, table: DataFrame, radius: float, apart: int = 0, denser: bool = False) -> DataFrame:
    """ids of the queries (id, v, density) that have a row of the table (the same) within `radius`. denser: one of greater density, or of equal and a smaller id.

    A block's densest rows come first, and a query that has met one is done.
    """
    measure = METRICS["l2"]

    def each(rows: Block, asks: Block) -> Iterator[pa.RecordBatch]:
        (own, x, theirs), (ids, q, mine) = rows, asks
        theirs, mine = theirs.column("density").to_numpy(), mine.column("density").to_numpy()
        order = np.lexsort((own, -theirs))
        own, x, theirs, left, met = own[order], x[order], theirs[order], np.arange(len(q)), []
        for at in range(0, len(x), PACK_ROWS):
            some = slice(at, at + PACK_ROWS)
            left = left[mine[left] <= theirs[at]] if denser else left
            if not len(left):
                break
            a, b, dist = measure.close(q[left], x[some], np.full(len(left), radius))
            a, b = left[a], b + at
            ok = np.isfinite(dist) & ~_overlap(ids[a], q.shape[1], own[b], x.shape[1], bool(apart))
            if denser:
                ok &= (theirs[b] > mine[a]) | ((theirs[b] == mine[a]) & (own[b] < ids[a]))
            met.append(np.unique(a[ok]))
            left = np.setdiff1d(left, met[-1], assume_unique=True)
        yield pa.RecordBatch.from_arrays([pa.array(ids[np.concatenate(met or [np.zeros(0, int)])])], ["id"])

    return _to_all(queries, table, [F.col("id")], each, "id long").distinct()


def _to_all(queries: DataFrame, table: DataFrame, place: list[Column], each, schema: str) -> DataFrame:
    """What `each` makes of all blocks of a table, dealt by the columns `place`, and all queries."""
    table, queries = checkpointed(table), checkpointed(queries)
    n = table.count()
    blocks = -(-n // _size(n, table)) or 1
    sent = queries.select("*", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("at"))
    return _streamed(table.select("*", F.pmod(F.xxhash64(*place), F.lit(blocks)).cast("long").alias("at")), sent, blocks, each, schema)


def best_per_series(queries: DataFrame, table: DataFrame | Cells, most: int, metric="l2", apart: int | None = 0) -> DataFrame:
    """id, series_id, nbr and dist: the best match of each query in each of the `most` series that match it best.

    A block sends a query's best rows in the `most` series that are best in it: what is best in a series and left out is
    passed by as many others. metric: a name, or a distance itself. apart: None bars no row, not even the query.
    """
    measure, cells = METRICS.get(metric, metric), table if isinstance(table, Cells) else celled(table)
    apart = None if apart is None else bool(apart)

    def each(rows: Block, asks: Block) -> Iterator[pa.RecordBatch]:
        (own, x, _), (ids, q, given) = rows, asks
        limit = given.column("limit").to_numpy() * (1 + 1e-9) + 1e-9
        a, b, dist = measure.close(q, x, limit)
        ok = np.isfinite(dist) & ~_overlap(ids[a], q.shape[1], own[b], x.shape[1], apart)
        a, b, dist = a[ok], b[ok], dist[ok]
        order = np.lexsort((own[b], dist, own[b] // SHIFT, a))
        a, b, dist = a[order], b[order], dist[order]
        best = np.ones(len(a), bool)
        best[1:] = (a[1:] != a[:-1]) | (own[b[1:]] // SHIFT != own[b[:-1]] // SHIFT)
        a, b, dist = a[best], b[best], dist[best]
        order = np.lexsort((own[b], dist, a))
        a, b, dist = a[order], b[order], dist[order]
        first = np.arange(len(a)) - np.searchsorted(a, a) < most
        a, b, dist = a[first], b[first], dist[first]
        yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(own[b] // SHIFT), pa.array(own[b]), pa.array(dist)], ["id", "series_id", "nbr", "dist"])

    queries = checkpointed(_at_home(queries.select("id", "v"), measure, cells, most, apart, True))
    found = _to_cells(queries, cells, _limited(measure, cells, most, apart, True), each, "id long, series_id long, nbr long, dist double")
    found = found.groupBy("id", "series_id").agg(F.min(F.struct("dist", "nbr")).alias("b")).select("id", "series_id", "b.nbr", "b.dist")
    order = Window.partitionBy("id").orderBy("dist", "series_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")


def pair_stats(queries: DataFrame, table: DataFrame, metric: str = "l2", apart: int = 0) -> DataFrame:
    """g1, g2, n, low, mean and high of the distances of all queries of group g1 to all rows of group g2. Both have (id, v, g); tasks send a row a pair of groups."""
    measure = METRICS[metric]

    def each(rows: Block, asks: Block) -> Iterator[pa.RecordBatch]:
        (own, x, theirs), (ids, q, mine) = rows, asks
        mine, theirs = (pc.dictionary_encode(t.column("g").combine_chunks()) for t in (mine, theirs))
        code, other = mine.indices.to_numpy(), theirs.indices.to_numpy()
        up, down = np.argsort(code, kind="stable"), np.argsort(other, kind="stable")
        rows_at, cols_at = (np.flatnonzero(np.diff(c, prepend=-1)) for c in (code[up], other[down]))
        ids, q, own, x = ids[up], q[up], own[down], x[down]
        dist = measure(q, x, _barred(ids, q.shape[1], own, x.shape[1], bool(apart)))
        ok = np.isfinite(dist)
        by_group = lambda f, d: f.reduceat(f.reduceat(d, cols_at, axis=1), rows_at, axis=0).ravel()
        n, low = by_group(np.add, ok.astype(np.int64)), by_group(np.minimum, np.where(ok, dist, np.inf))
        dist[~ok] = 0.0
        total, high = by_group(np.add, dist), by_group(np.maximum, dist)
        some = np.flatnonzero(n)
        names, others = (np.array(e.dictionary.to_pylist(), str) for e in (mine, theirs))
        pairs = np.repeat(names[code[up][rows_at]], len(cols_at)), np.tile(others[other[down][cols_at]], len(rows_at))
        yield pa.RecordBatch.from_arrays([pa.array(p[some]) for p in (*pairs, n, total, low, high)], ["g1", "g2", "n", "total", "low", "high"])

    rows, asks = (df.where("g is not null").select("id", "v", F.col("g").cast("string").alias("g")) for df in (table, queries))
    found = _to_all(asks, rows, [F.col("id")], each, "g1 string, g2 string, n long, total double, low double, high double")
    return found.groupBy("g1", "g2").agg(F.sum("n").alias("n"), F.min("low").alias("low"), (F.sum("total") / F.sum("n")).alias("mean"), F.max("high").alias("high"))


def pair_farthest(rows: DataFrame) -> DataFrame:
    """g1, g2 and high, g1 < g2: the greatest Euclidean distance of all rows (id, v, g) of one group to all of another.

    All pairs are met by products of matrices in single precision; those that may pass the greatest one found so far of
    their groups are measured as they are. Rows whose v holds no numbers only are left out.
    """
    measure = METRICS["l2"]
    held = rows.where("g is not null and v is not null").select("id", F.col("v").cast("array<double>").alias("v"), F.col("g").cast("string").alias("g"))
    held = checkpointed(held.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))))
    total = held.count()
    blocks = -(-total // _size(total, held, FAR_ROWS)) or 1
    at = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("long")
    # of two blocks the pair is met once: the rows of the lower number are asked
    sent = held.select("id", "v", "g", F.explode(F.sequence(at, F.lit(blocks - 1).cast("long"))).alias("at"))

    best: dict[tuple[str, str], float] = {}  # of what a task has met

    def each(block: Block, asks: Block) -> Iterator[pa.RecordBatch]:
        (_, x, theirs), (_, q, mine) = block, asks
        if x.shape[1] != q.shape[1]:
            return
        theirs, mine = (pc.dictionary_encode(t.column("g").combine_chunks()) for t in (theirs, mine))
        names, others = mine.dictionary.to_pylist(), theirs.dictionary.to_pylist()
        pairs = [[(min(g, h), max(g, h)) for h in others] for g in names]
        top = np.array([[best.get(p, -1.0) if p[0] != p[1] else np.inf for p in row] for row in pairs])
        for i, j in _farther(measure, q, mine.indices.to_numpy(), x, theirs.indices.to_numpy(), top):
            best[pairs[i][j]] = max(best.get(pairs[i][j], -1.0), top[i, j])
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*pairs[i][j], best[pairs[i][j]])], ["g1", "g2", "high"])

    found = _streamed(held.select("id", "v", "g", at.alias("at")), sent, blocks, each, "g1 string, g2 string, high double")
    return found.groupBy("g1", "g2").agg(F.max("high").alias("high"))


def _farther(measure: Euclid, q: np.ndarray, mine: np.ndarray, x: np.ndarray, theirs: np.ndarray, top: np.ndarray) -> list[tuple[int, int]]:
    """Raises `top`, the greatest distance of each group of q (a row) to each of x, where rows of the two are farther; the places of what was raised."""
    raised: set[tuple[int, int]] = set()
    order = np.argsort(theirs, kind="stable")
    x, theirs = x[order], theirs[order]
    starts = np.flatnonzero(np.diff(theirs, prepend=-1))
    ends = np.append(starts[1:], len(x))
    with np.errstate(all="ignore"):
        middle = x.mean(0)
        cq, cx = q - middle, x - middle
        unit = max(float(np.abs(cq).max()), float(np.abs(cx).max()), 1e-100)
        cq, cx = cq / unit, cx / unit
        qq, xx = (cq * cq).sum(1), (cx * cx).sum(1)
        slack = 2e-7 * (x.shape[1] + 8) * (qq.max() + xx.max()) + 1e-30
        left, right = np.column_stack([-2 * cq, np.ones(len(q)), qq]).astype(np.float32), np.column_stack([cx, xx, np.ones(len(x))]).astype(np.float32).T
        step = max(1, GEMM_PAIRS // len(x))
        for at in range(0, len(q), step):
            far = left[at : at + step] @ right
            most = np.maximum.reduceat(far, starts, axis=1)
            own, groups = mine[at : at + step], theirs[starts]
            for row, c in np.argwhere(~(most < np.sign(t := top[np.ix_(own, groups)]) * (t / unit) ** 2 - slack)):
                i, j = int(own[row]), int(groups[c])
                if not most[row, c] < np.sign(top[i, j]) * (top[i, j] / unit) ** 2 - slack:
                    near = starts[c] + np.flatnonzero(~(far[row, starts[c] : ends[c]] < most[row, c] - 2 * slack))
                    high = float(measure.paired(np.broadcast_to(q[at + row], (len(near), x.shape[1])), x[near]).max())
                    if high > top[i, j]:
                        top[i, j] = high
                        raised.add((i, j))
    return sorted(raised)


def indexed(queries: DataFrame, table: DataFrame, k: int, n_pivots: int = 64, probes: int = 16, metric: str = "dtw", by: str = "l2", parts: int = 0, more: int = 4, apart: int = 0) -> DataFrame:
    """id, nbr, dist and rank: approximate nearest rows by an index of pivots.

    Every row belongs to its nearest pivot by the metric `by` (of means of `parts` segments, if given). A query visits
    the `probes` pivots nearest to it; of their rows the more * k nearest by `by` are measured by `metric`, or all of them if
    `more` is 0, but for those whose lower bound passes the k-th best. The index is
    fit on `n_pivots` rows; all rows are indexed.
    """
    low, fine = METRICS[by], METRICS[metric]
    table = checkpointed(table.select("id", "v"))
    got = pivots(table, n_pivots).select("v").toArrow()
    if not len(got):
        return table.select("id", F.col("id").alias("nbr"), F.lit(0.0).alias("dist"), F.lit(1).alias("rank"))
    chosen = _matrix(got.column("v"))

    def short(x: np.ndarray) -> np.ndarray:
        return x.reshape(len(x), parts, -1).mean(2) if parts else x

    def to(x: np.ndarray) -> np.ndarray:
        return np.concatenate([low(short(x[i : i + 4096]), short(chosen)) for i in range(0, len(x), 4096)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(to(_matrix(batch.column("v"))).argmin(1).astype(np.int32))], ["id", "v", "cell"])

    rows = checkpointed(table.mapInArrow(deal, "id long, v array<double>, cell int"))
    counts = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}  # a row a pivot
    cells = Cells(rows, [Cell(p, counts.get(i, 0), 0.0, p, p) for i, p in enumerate(chosen)], [])
    some = np.array([c.rows > 0 for c in cells.cells])

    def visits(ids: np.ndarray, q: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((len(q), len(chosen)), bool)
        np.put_along_axis(out, np.argsort(to(q), axis=1, kind="stable")[:, :probes], True, axis=1)
        return out & some, np.full(len(q), np.inf)

    def each(block: Block, asks: Block) -> Iterator[pa.RecordBatch]:
        (own, x, _), (ids, q, _) = block, asks
        barred = _barred(ids, q.shape[1], own, x.shape[1], bool(apart))
        if more:
            dist = low(short(q), short(x), barred)
            kth = np.partition(dist, more * k - 1, axis=1)[:, more * k - 1] if len(x) > more * k else np.full(len(q), np.inf)
            a, b = np.nonzero((dist <= kth[:, None]) & np.isfinite(dist))
            rough = dist[a, b]
            exact = fine.warp(q[a], x[b]) if isinstance(fine, Warped) else rough
        else:
            dist = fine(q, x, barred, None, k)
            kth = np.partition(dist, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(q), np.inf)
            a, b = np.nonzero((dist <= kth[:, None]) & np.isfinite(dist))
            rough = exact = dist[a, b]
        yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(own[b]), pa.array(rough), pa.array(exact)], ["id", "nbr", "rough", "dist"])

    found = _to_cells(queries, cells, visits, each, "id long, nbr long, rough double, dist double")
    first = Window.partitionBy("id").orderBy("rough", "nbr")
    found = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= (more or 1) * k)
    order = Window.partitionBy("id").orderBy("dist", "nbr")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("id", "nbr", "dist", "rank")
