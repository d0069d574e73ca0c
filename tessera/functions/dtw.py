"""Banded dynamic time warping of many pairs at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(256)
def reach(n: int, m: int, share: float = 0.1) -> tuple[tuple[int, int], ...]:
    """For each place of a sequence of length m, the first and last place of one of length n that it may meet.

    The places of the longer one are laid along the shorter one's length; each may meet those within max(1, floor(share *
    longer length)) of it there.
    """
    long, short = max(n, m), min(n, m)
    at = np.arange(long) * (short - 1) / max(long - 1, 1)
    meets = np.abs(at[:, None] - np.arange(short)) <= max(1, int(share * long)) + 1e-9
    meets = meets.T if n == long else meets  # a row for each place of the one of length m
    return tuple((int(np.flatnonzero(row)[0]), int(np.flatnonzero(row)[-1])) for row in meets)


def banded(a: np.ndarray, b: np.ndarray, share: float = 0.1) -> np.ndarray:
    """Summed squared costs of the best warping of each pair of rows, within `reach` of the diagonal.

    a and b are (pairs, length) or (pairs, length, dims) arrays; all rows of a have one length, and all of b.
    """
    if a.ndim == 2:
        a, b = a[:, :, None], b[:, :, None]
    if a.shape[1] < b.shape[1]:
        a, b = b, a
    pairs, n, m = len(a), a.shape[1], b.shape[1]
    before = np.full((pairs, m + 1), np.inf)
    before[:, 0] = 0
    for i, (first, last) in enumerate(reach(m, n, share)):
        now = np.full((pairs, m + 1), np.inf)
        for j in range(first, last + 1):
            cost = ((a[:, i] - b[:, j]) ** 2).sum(1)
            now[:, j + 1] = cost + np.minimum(np.minimum(before[:, j], before[:, j + 1]), now[:, j])
        before = now
    return before[:, m]


#: Pairs that are warped at a time, so that a line of the table stays in a core's cache.
TILE = 1 << 14


def across(a: np.ndarray, b: np.ndarray, share: float = 0.1) -> np.ndarray:
    """As `banded`, of every row of a (rows, length) and every row of b."""
    if a.shape[1] < b.shape[1]:
        return across(b, a, share).T
    out, ends = np.empty((len(a), len(b))), reach(b.shape[1], a.shape[1], share)
    columns, step = np.ascontiguousarray(b.T), max(1, TILE // max(len(b), 1))
    for at in range(0, len(a), step):
        some, before = a[at : at + step], {}
        for i, (first, last) in enumerate(ends):
            now: dict[int, np.ndarray] = {}
            for j in range(first, last + 1):
                cost = some[:, i, None] - columns[j]
                cost *= cost
                ways = [w for w in (before.get(j - 1), before.get(j), now.get(j - 1)) if w is not None]
                if ways:
                    least = ways[0]
                    for way in ways[1:]:
                        least = np.minimum(least, way)
                    cost += least
                elif i or j:
                    cost[:] = np.inf
                now[j] = cost
            before = now
        out[at : at + step] = before.get(b.shape[1] - 1, np.inf)
    return out


def extended(xs: list[np.ndarray]) -> np.ndarray:
    """Rows of one length: the shorter are padded by their last value."""
    n = max(map(len, xs))
    return np.stack([np.concatenate([x, np.repeat(x[-1:], n - len(x), axis=0)]) for x in xs])


def dtw(a: str | Column, b: str | Column, share: float = 0.1) -> Column:
    """The DTW of two array columns; arrays of several lengths in a batch are extended pair by pair's length."""

    @F.pandas_udf("double")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            out = np.empty(len(x))
            sizes = np.array([max(len(p), len(q)) for p, q in zip(x, y)], int)
            for n in np.unique(sizes):
                own = np.flatnonzero(sizes == n)
                pad = np.zeros(n)  # makes every row of this group n long
                left = extended([*[np.asarray(x.iloc[i], float) for i in own], pad])[:-1]
                right = extended([*[np.asarray(y.iloc[i], float) for i in own], pad])[:-1]
                out[own] = banded(left, right, share)
            yield pd.Series(out)

    return of(a, b)
