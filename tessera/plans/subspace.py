"""Motifs in some of the dimensions: collisions of random projection summed over dimensions choose two seeds, a test says in which dimensions these are alike, and occurrences are found in those alone."""

from __future__ import annotations

from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import catalog
from tessera.catalog import query
from tessera.functions.vectors import squared_distance
from tessera.operators.neighbours import spaced
from tessera.operators.search import unpacked, windows
from tessera.operators.symbols import PARTS, guarded_columns, projected, sax, word_counts
from tessera.plans.discovery import tail_radius, without
from tessera.plans.rounds import written
from tessera.sources.frames import frames

SIZE = 8
#: A dimension is relevant if so few windows, as a share of all, are nearer to the first seed in it than the second seed is.
RELEVANT = 0.02
#: Windows that are tried as a first seed, one after another, before a round ends without a motif.
TRIES = 3


def worded(rows: DataFrame, size: int, values: tuple[str, ...]) -> DataFrame:
    """series_id, start, and for each dimension i its word wi and its values vi, of every window."""
    out = None
    for i, value in enumerate(values):
        w = sax(rows, size, value=value).withColumnRenamed("word", f"w{i}")
        w = w.join(windows(rows, size, value).select(*unpacked("id", "series_id", "start"), F.col("v").alias(f"v{i}")), ["series_id", "start"])
        out = w if out is None else out.join(w, ["series_id", "start"])
    return out


def summed(free: DataFrame, dims: int, columns: int | None = None) -> DataFrame:
    """free with hits: each window's collisions with all others, summed over dimensions, from the counts of words. columns: kept in a round; without it as many as the guard asks for."""
    total: Column = F.lit(0)
    for i in range(dims):
        words = word_counts(free.select(F.col(f"w{i}").alias("word")))
        p = projected(words, columns=columns or guarded_columns(words))
        n = p.groupBy("round", "key").agg(F.sum("n").alias("in_key"))
        hits = p.join(n, ["round", "key"]).groupBy(F.col("word").alias(f"w{i}")).agg(F.sum(F.col("in_key") - 1).alias(f"hits{i}"))
        free = free.join(hits, f"w{i}")
        total = total + F.col(f"hits{i}")
    return free.withColumn("hits", total).drop(*[f"hits{i}" for i in range(dims)])


def shared(word: Column, other: str, parts: int = PARTS) -> Column:
    """Rounds of two columns in which two words collide: pairs of places where they agree."""
    same = sum((F.substring(word, p + 1, 1).eqNullSafe(F.lit(other[p])).cast("int") for p in range(parts)), F.lit(0))
    return (same * (same - 1) / 2).cast("int")


def to_window(free: DataFrame, at: dict, dims: int) -> DataFrame:
    """free with the squared distances d0, d1, ... to a window, dimension by dimension, and the rounds `met` in which they collide."""
    out = free
    for i in range(dims):
        out = out.withColumn(f"d{i}", squared_distance(F.col(f"v{i}"), F.array(*map(F.lit, at[f"v{i}"]))))
    return out.withColumn("met", sum((shared(F.col(f"w{i}"), at[f"w{i}"]) for i in range(dims)), F.lit(0)))


def seeds(free: DataFrame, size: int, dims: int, relevant: float = RELEVANT, tries: int = TRIES) -> tuple[dict, dict, list[int]] | None:
    """Two windows that do not overlap and the dimensions in which they are alike, or None.

    The first has most collisions over all dimensions; the second collides with it in most rounds, the nearest of these.
    Dimensions in which many windows are nearer to the first are not relevant; without a relevant one the next window is tried.
    """
    order = [F.desc("hits"), "series_id", "start"]
    for first in summed(free, dims).orderBy(*order).limit(tries).collect():
        first = first.asDict()
        met = to_window(free, first, dims)
        apart = (F.col("series_id") != first["series_id"]) | (F.abs(F.col("start") - first["start"]) >= size)
        met = written(met.where(apart))
        # scales: the mean squared distance of each dimension, so that dimensions can be added
        scale = met.agg(*[F.avg(f"d{i}").alias(f"s{i}") for i in range(dims)]).first()
        if scale[0] is None:
            return None
        near = F.least(*[F.coalesce(F.try_divide(f"d{i}", F.lit(scale[i])), F.lit(0.0)) for i in range(dims)]) if dims > 1 else F.col("d0")
        second = met.orderBy(F.desc("met"), near, "series_id", "start").first().asDict()
        shares = met.agg(*[F.avg((F.col(f"d{i}") < second[f"d{i}"]).cast("double")).alias(f"r{i}") for i in range(dims)], *[F.stddev_pop(f"d{i}").alias(f"z{i}") for i in range(dims)]).first()
        chosen = [i for i in range(dims) if shares[f"r{i}"] <= relevant and shares[f"z{i}"]]
        if chosen:
            return *slid(free, first, second, chosen, size), chosen
    return None


def slid(free: DataFrame, first: dict, second: dict, chosen: list[int], size: int) -> tuple[dict, dict]:
    """Two seeds moved together, by less than their size, to where they are most alike in some dimensions: words are the same about a motif, not at it alone."""
    near = lambda w: (F.col("series_id") == w["series_id"]) & (F.abs(F.col("start") - w["start"]) < size)
    rows = {(r["series_id"], r["start"]): r.asDict() for r in free.where(near(first) | near(second)).collect()}  # 4 * size - 2 at most
    best = (float("inf"), first, second)
    for o in range(1 - size, size):
        a, b = (rows.get((w["series_id"], w["start"] + o)) for w in (first, second))
        if a and b:
            far = sum((x - y) ** 2 for i in chosen for x, y in zip(a[f"v{i}"], b[f"v{i}"]))
            best = min(best, (far, a, b), key=lambda x: x[0])
    return best[1], best[2]


def apart(hits: DataFrame, size: int) -> DataFrame:
    """series_id and start of hits (dist), the nearest first, each `size` or more from all taken before."""

    def each(g: pd.DataFrame) -> pd.DataFrame:
        kept = spaced(g.sort_values(["dist", "start"])["start"].tolist(), size)
        return pd.DataFrame({"series_id": g["series_id"].iloc[0], "start": kept})

    return hits.groupBy("series_id").applyInPandas(each, "series_id long, start int")


def subspace_rounds(rows: DataFrame, size: int = SIZE, values: tuple[str, ...] = ("x", "h"), rounds: int | None = None, least: int = 3, relevant: float = RELEVANT) -> DataFrame:
    """motif, dims (the numbers of its dimensions), series_id, start, len: until no two seeds are alike in any dimension, or fewer than `least` windows are near them.

    Distances to the nearer seed are added over the motif's dimensions, each by its own scale.
    """
    free, found, dims = written(worded(rows, size, values)), None, len(values)
    for n in count() if rounds is None else range(rounds):
        got = seeds(free, size, dims, relevant)
        if got is None:
            break
        first, second, chosen = got
        scale = to_window(free, first, dims).agg(*[F.avg(f"d{i}").alias(f"s{i}") for i in range(dims)]).first()
        far = lambda at: F.sqrt(sum((squared_distance(F.col(f"v{i}"), F.array(*map(F.lit, at[f"v{i}"]))) / (scale[i] or 1.0) for i in chosen), F.lit(0.0)))
        dists = written(free.select("series_id", "start", F.least(far(first), far(second)).alias("dist")))
        occs = written(apart(dists.where(F.col("dist") <= tail_radius(dists, below=True)), size))
        kept = occs.select(F.lit(n).alias("motif"), F.array(*map(F.lit, chosen)).alias("dims"), "series_id", "start", F.lit(size).alias("len"))
        if kept.limit(least).count() < least:
            break
        found = kept if found is None else found.unionByName(kept)
        free = written(without(free, occs.withColumn("len", F.lit(size)), size))
    return found if found is not None else rows.limit(0).select(F.lit(0).alias("motif"), F.array(F.lit(0)).alias("dims"), "series_id", F.col("t").alias("start"), F.lit(size).alias("len"))


@query("summed_collisions", f"SELECT series_id, start, sum(hits)::BIGINT AS hits FROM ({catalog.ORACLES['dim_collision_rowsums']}) GROUP BY ALL")
def summed_collisions(spark, d):
    """Collisions of each window with all others, over both dimensions."""
    return summed(worded(frames(spark, d), SIZE, ("x", "h")).select("series_id", "start", "w0", "w1"), 2, 2).select("series_id", "start", F.col("hits").cast("long").alias("hits"))


@query("subspace_motifs")
def subspace_motifs(spark, d, rounds: int = 1):
    """The first motif whose dimensions are chosen with it; none where no two windows that collide are alike."""
    return subspace_rounds(frames(spark, d), rounds=rounds)
