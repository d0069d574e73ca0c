"""A hierarchical index over bit prints in Gray order, and rows that come sorted, cut to whole groups.

Nulls and odd rows: prints and groups have no nulls; equal prints are a pair at no distance; no rows give no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows, or nodes, below a node of the tree.
FAN = 8


def gray_rank(x: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def gray_order(prints: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of prints (rows of 64-bit words) by group, then by Gray rank of the whole row."""
    ranks, odd = [], np.zeros(len(prints), np.uint64)
    for word in prints.T:
        ranks.append(gray_rank(word) ^ (np.uint64(0) - odd))
        odd ^= np.bitwise_count(word).astype(np.uint64) & np.uint64(1)
    return np.lexsort([*reversed(ranks), group])


def near_pairs(prints: np.ndarray, group: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions a < b of rows of the same group that differ in at most `limit` bits, in blocks.

    prints has a row of 64-bit words for each print, in `gray_order`. Runs of FAN rows share a node, runs of FAN nodes
    the next; a node has the bits that all below it share. Pairs of nodes are followed down from the top; one whose
    groups do not meet, or whose shared bits differ by more than `limit` already, is dropped with all that is below.
    """
    levels = [(np.full(prints.shape, ~np.uint64(0)), prints, group, group)]
    while len(levels[-1][1]) > FAN:
        mask, bits, low, high = levels[-1]
        at = np.arange(0, len(bits), FAN)
        odd = np.bitwise_or.reduceat(bits ^ np.repeat(bits[at], FAN, axis=0)[: len(bits)], at, axis=0)
        mask = np.bitwise_and.reduceat(mask, at, axis=0) & ~odd
        levels.append((mask, bits[at] & mask, low[at], high[np.minimum(at + FAN, len(bits)) - 1]))
    top = np.arange(len(levels[-1][1]))
    a, b = (x.ravel() for x in np.meshgrid(top, top, indexing="ij"))
    todo, down = [(len(levels) - 1, a[a <= b], b[a <= b])], np.arange(FAN)
    while todo:
        level, a, b = todo.pop()
        if len(a) > 32_000:
            todo += [(level, a[i : i + 16_000], b[i : i + 16_000]) for i in range(0, len(a), 16_000)]
            continue
        mask, bits, low, high = levels[level]
        meet = high[a] >= low[b]
        a, b = a[meet], b[meet]
        near = np.bitwise_count((bits[a] ^ bits[b]) & mask[a] & mask[b]).sum(1, dtype=np.int64) <= limit
        a, b = a[near], b[near]
        if not level:
            if len(a := a[apart := a != b]):
                yield a, b[apart]
            continue
        below = len(levels[level - 1][1])
        a = np.repeat(a[:, None] * FAN + down, FAN, axis=1).ravel()
        b = np.tile(b[:, None] * FAN + down, (1, FAN)).ravel()
        inside = (a < below) & (b < below) & (a <= b)
        todo.append((level - 1, a[inside], b[inside]))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int = 0) -> Iterator[pa.Table]:
    """Rows that come sorted by `keys`, as tables of whole groups with their number in `group`, of `rows` or more if there are so many."""
    kept: list[pa.RecordBatch] = []

    def numbered(table: pa.Table) -> pa.Table:
        columns = [table.column(k).to_numpy() for k in keys]
        new = np.zeros(table.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        return table.append_column("group", pa.array(np.cumsum(new)))

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        last = 0
        if sum(x.num_rows for x in kept) > rows:
            same = np.ones(batch.num_rows, bool)
            for k in keys:
                c = batch.column(k).to_numpy()
                same &= c == c[-1]
            last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if last:
            whole = [*kept[:-1], batch.slice(0, last)]
            kept = [batch.slice(last)]
            yield numbered(pa.Table.from_batches(whole))
    if kept:
        yield numbered(pa.Table.from_batches(kept))
