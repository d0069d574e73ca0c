"""Motif discovery: random projection, symbolic hashing, neighbour density and exemplar search, and what is done with motifs.

Motifs are rows (motif, series_id, start, len). Loops run on the driver, a step for each motif or for each growth; in a
step all series are worked on by joins and groupings, and its table is checkpointed. What the driver sees is a pair of
windows, a histogram or a table with a row for each motif.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.catalog import FRAMES, query
from tessera.functions import hmm
from tessera.functions.vectors import squared_distance
from tessera.operators.neighbours import APART, AT, DISJOINT, KNN, L2, OPTIMA, W, disjoint, every_window, greedy_sql, optima, spaced, sweep, window_knn
from tessera.operators.search import EVERY, SHIFT, asked, best_per_series, celled, densities, near_ids, packed, unpacked, windows, with_near, within
from tessera.operators.spans import coalesce, complement, whole
from tessera.operators.stats import silence, worst_frames
from tessera.operators.symbols import HASHED, SAX, entries, guarded_columns, hashed, letters, mdl, sax, swept, top_collision, warped, word_counts
from tessera.operators.windows import WINDOW8, sliding
from tessera.plans.rounds import checkpointed, written
from tessera.sources.frames import frames

SIZE = 8


def knee(values: Sequence) -> int:
    """Where a sorted curve is farthest from the chord between its ends."""
    y = np.sort(np.asarray(values, float))
    if len(y) < 3:
        return len(y) - 1
    chord = y[0] + (y[-1] - y[0]) * np.arange(len(y)) / (len(y) - 1)
    return int(np.abs(y - chord).argmax())


def tail_radius(dists: DataFrame, share: float = 0.1, bins: int = 1000, below: bool = False) -> float:
    """The knee of the lowest `share` of distances (a column dist), from a histogram of equal bins: its mean distance at each bin, against how many lie below. below: the last of those that lie under the chord, where the curve begins to rise."""
    most = dists.agg(F.max("dist").alias("m")).first()["m"]
    if not most:
        return 0.0
    at = F.least(F.floor(F.col("dist") / most * bins), F.lit(bins - 1))
    rows = dists.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("dist").alias("mean")).orderBy("bin").collect()  # a row a bin
    n, mean = np.array([r["n"] for r in rows]), np.array([r["mean"] for r in rows])
    upto = np.cumsum(n)
    held = max(1, int(np.searchsorted(upto, share * upto[-1], "right")))
    x, y = upto[:held], mean[:held]
    if held < 3:
        return float(y[-1])
    chord = y[0] + (y[-1] - y[0]) * (x - x[0]) / (x[-1] - x[0])
    return float(y[int((chord - y if below else np.abs(y - chord)).argmax())])


def _near(vectors: list[list[float]]) -> Column:
    """The distance of v to the nearest of some vectors."""
    return F.array_min(F.array(*[F.sqrt(squared_distance(F.col("v"), F.array(*map(F.lit, x)))) for x in vectors]))


def without(rows: DataFrame, occs: DataFrame, size: int) -> DataFrame:
    """Windows (series_id, start) of `size` frames that share none with occurrences (series_id, start, len)."""
    gone = occs.select("series_id", F.explode(F.sequence(F.col("start") - size + 1, F.col("start") + F.col("len") - 1)).alias("start"))
    return rows.join(gone.distinct(), ["series_id", "start"], "left_anti")


def projection_rounds(rows: DataFrame, size: int = SIZE, rounds: int = 3, least: int = 2, value: str = "x") -> DataFrame:
    """motif, series_id, start, len by random projection over all series: the pair with most collisions, a radius about it, all windows within it, swept, which are then taken out; again, while `least` are found."""
    free = checkpointed(sax(rows, size, value=value).join(windows(rows, size, value).select(*unpacked("id", "series_id", "start"), "v"), ["series_id", "start"]))
    found = None
    for n in range(rounds):
        words = free.select("series_id", "start", "word")
        best = top_collision(words, size, guarded_columns(word_counts(words))).first()
        if best is None:
            break
        pair = free.where(((F.col("series_id") == best["series1"]) & (F.col("start") == best["start1"])) | ((F.col("series_id") == best["series2"]) & (F.col("start") == best["start2"])))
        dists = checkpointed(free.select("series_id", "start", _near([r["v"] for r in pair.select("v").collect()]).alias("dist")))
        occs = checkpointed(sweep(dists.where(F.col("dist") <= tail_radius(dists)), size))
        kept = occs.select(F.lit(n).alias("motif"), "series_id", "start", F.lit(size).alias("len"))
        if kept.limit(least).count() < least:
            break
        found = kept if found is None else found.unionByName(kept)
        free = checkpointed(without(free, occs.withColumn("len", F.lit(size)), size))
    return found if found is not None else rows.limit(0).select(F.lit(0).alias("motif"), "series_id", F.col("t").alias("start"), F.lit(size).alias("len"))


@query("projection_motifs")
def projection_motifs(spark, d, size: int = SIZE, rounds: int = 3, least: int = 2):
    """Motifs by random projection."""
    return projection_rounds(frames(spark, d), size, rounds, least)


@query("dim_motifs")
def dim_motifs(spark, d, rounds: int = 1):
    """Motifs by random projection, of each dimension by itself."""
    rows, out = checkpointed(frames(spark, d)), None
    for i, value in enumerate(("x", "h")):
        part = projection_rounds(rows, rounds=rounds, value=value).withColumn("dim", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


#: A hashed motif must save so much of the description's length.
LIMIT = -200.0


def hash_rounds(rows: DataFrame, size: int = 6, limit: float = LIMIT) -> DataFrame:
    """motif, hash, mdl, series_id, start, len: the entry of least description length, its occurrences, which are taken out; again, while it is not above `limit`."""
    h, n_symbols = checkpointed(hashed(rows, size)), len(letters(rows)[1])
    found = None
    for n in count():
        e = entries(h, size).select("*", mdl(size, n_symbols)[0])
        best = e.orderBy("mdl", F.desc("trans"), F.desc("uniq"), F.desc("n_dtw"), F.desc("n_fixed"), "hash").first()
        if best is None or best["mdl"] > limit:
            break
        occs = swept(h.where(F.col("hash") == best["hash"]), size)
        kept = checkpointed(occs.select(F.lit(n).alias("motif"), "hash", F.lit(best["mdl"]).alias("mdl"), "series_id", "start", F.lit(size).alias("len")))
        found = kept if found is None else found.unionByName(kept)
        h = checkpointed(without(h, kept, size))
    if found is None:
        found = h.limit(0).select(F.lit(0).alias("motif"), "hash", F.lit(0.0).alias("mdl"), "series_id", F.col("start").cast("int").alias("start"), F.lit(size).alias("len"))
    return found


def limit_by_frames(rows: DataFrame) -> float:
    """The limit that queries set: description lengths grow with the frames, so -25 and -0.004 a frame more."""
    return -(25 + 0.004 * rows.count())


@query("hash_motifs")
def hash_motifs(spark, d):
    """Motifs by symbolic hashing."""
    rows = frames(spark, d)
    return hash_rounds(rows, limit=limit_by_frames(rows))


AFFIX_SQL = f"{HASHED}, tp AS (SELECT hash FROM en ORDER BY n_dtw DESC, hash LIMIT 20), mo AS (SELECT oc.hash, series_id, start FROM oc JOIN tp USING (hash)), nn AS (SELECT hash, count(*) AS n FROM mo GROUP BY 1), pr AS (SELECT a.hash AS h1, b.hash AS h2, count(*) AS k FROM mo a JOIN mo b ON a.series_id = b.series_id AND a.hash <> b.hash AND b.start - (a.start + 5) IN (1, 2) GROUP BY ALL)"


def affixed(motifs: DataFrame, key: str = "motif") -> DataFrame:
    """m1, m2, k and share: occurrences of m2 that begin one or two frames after the last of one of m1, by the larger motif's count."""
    n = motifs.groupBy(key).agg(F.count("*").alias("n"))
    a = motifs.select(F.col(key).alias("m1"), "series_id", F.explode(F.array(F.col("start") + F.col("len"), F.col("start") + F.col("len") + 1)).alias("start"))
    both = a.join(motifs.select(F.col(key).alias("m2"), "series_id", "start"), ["series_id", "start"]).where("m1 <> m2").groupBy("m1", "m2").agg(F.count("*").alias("k"))
    both = both.join(n.select(F.col(key).alias("m1"), F.col("n").alias("n1")), "m1").join(n.select(F.col(key).alias("m2"), F.col("n").alias("n2")), "m2")
    return both.select("m1", "m2", "k", F.round(F.col("k") / F.greatest("n1", "n2"), 6).alias("share"))


@query("affix_shares", f"{AFFIX_SQL} SELECT h1 AS m1, h2 AS m2, k, round(k / greatest(a.n, b.n), 6) AS share FROM pr JOIN nn a ON a.hash = h1 JOIN nn b ON b.hash = h2")
def affix_shares(spark, d, most: int = 20):
    """How often one of the entries with most occurrences follows another within two frames, a report on the top ones."""
    h = hashed(frames(spark, d))
    top = entries(h).orderBy(F.desc("n_dtw"), "hash").limit(most).select("hash")
    o = swept(h.join(F.broadcast(top), "hash", "left_semi")).withColumn("len", F.lit(6))
    return affixed(o, "hash")


#: Two motifs are joined if one follows the other in more than this share of the larger one's occurrences.
AFFIX_SHARE = 0.6


def affix_step(rows: DataFrame, motifs: DataFrame, share: float = AFFIX_SHARE) -> DataFrame | None:
    """motifs with the best pair replaced by occurrences of both patterns joined, searched for anew in free frames; None if no pair is good enough."""
    best = affixed(motifs).orderBy(F.desc("share"), "m1", "m2").first()
    if best is None or best["share"] <= share:
        return None
    names = letters(rows)[1]
    name = lambda m: motifs.where(F.col("motif") == m).select("hash").first()[0]
    joined = name(best["m1"]) + name(best["m2"])
    rest = motifs.where(~F.col("motif").isin(best["m1"], best["m2"]))
    runs_ = [c for i, c in enumerate(joined) if not i or c != joined[i - 1]]  # equal letters where they meet are one run
    found = warped(rows, tuple(names[ord(c) - 97] for c in runs_))
    taken = rest.select("series_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("t")).distinct()
    frames_ = found.select("series_id", "start", "len", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("t"))
    barred = frames_.join(taken, ["series_id", "t"], "left_semi").select("series_id", "start", "len").distinct()
    open_ = found.join(barred, ["series_id", "start", "len"], "left_anti")
    none = F.array().cast("array<struct<start:int,len:int>>")
    s = open_.groupBy("series_id").agg(F.sort_array(F.collect_set(F.struct("start", "len"))).alias("s"))
    step = lambda a, x: F.when((F.size(a) == 0) | (x.start >= F.element_at(a, -1).start + F.element_at(a, -1).len), F.concat(a, F.array(x))).otherwise(a)
    new = s.select("series_id", F.explode(F.aggregate("s", none, step)).alias("x")).select(F.lit(best["m1"]).alias("motif"), F.lit(joined).alias("hash"), F.lit(0.0).alias("mdl"), "series_id", "x.start", "x.len")
    return written(rest.unionByName(new))


def member_vectors(rows: DataFrame, motifs: DataFrame, size: int) -> DataFrame:
    """motif, id and v: the first `size` values of each occurrence."""
    w = windows(rows, size)
    return motifs.select("motif", packed("series_id", "start").alias("id")).join(w, "id")


#: A motif is split if its two parts lie this much closer in themselves than together; the parts are found on at most SAMPLE occurrences.
SPLIT_GAP, SAMPLE = 0.45, 256


def split_step(rows: DataFrame, motifs: DataFrame, size: int = 6, gap: float = SPLIT_GAP, sample: int = SAMPLE) -> DataFrame:
    """motifs, with those split in two whose complete-link clusters leave a gap over `gap` at the root.

    The clusters are those of at most `sample` occurrences of each motif, the ones with the least hashes; every other
    occurrence goes to the part whose mean is nearer.
    """
    members = written(member_vectors(rows, motifs, size))
    order = Window.partitionBy("motif").orderBy(F.xxhash64("id"), "id")
    some = members.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample)

    def each(g: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(g.sort_values("id")["v"].to_numpy())
        none = pd.DataFrame({"motif": pd.Series(dtype=int), "part": pd.Series(dtype=int), "mean": pd.Series(dtype=object)})
        if len(x) < 4:
            return none
        dist = ((x[:, None] - x[None]) ** 2).sum(2) / x.shape[1]
        np.fill_diagonal(dist, np.inf)
        sets, height = {i: [i] for i in range(len(x))}, {i: 0.0 for i in range(len(x))}
        for i, j, far in hmm.linkage(dist, "complete"):
            if len(sets) == 2:
                break
            sets[i] += sets.pop(j)
            height[i] = far
        (i, a), (j, b) = sorted(sets.items())
        if 1 - max(height[i], height[j]) / far <= gap:
            return none
        return pd.DataFrame({"motif": g["motif"].iloc[0], "part": [0, 1], "mean": [x[a].mean(0), x[b].mean(0)]})

    parts = written(some.select("motif", "id", "v").groupBy("motif").applyInPandas(each, "motif int, part int, mean array<double>"))
    means = F.broadcast(parts.groupBy("motif").agg(F.sort_array(F.collect_list(F.struct("part", "mean"))).alias("means")))  # a row a motif
    near = members.join(means, "motif").select("motif", "id", F.array_position(F.transform("means", lambda m: squared_distance(F.col("v"), m.mean)), F.array_min(F.transform("means", lambda m: squared_distance(F.col("v"), m.mean)))).alias("part"))
    most = F.broadcast(motifs.agg((F.max("motif") + 1).alias("most")))
    moved = near.where("part = 2").join(most).select("id", (F.col("motif") + F.col("most")).cast("int").alias("new"))
    out = motifs.withColumn("id", packed("series_id", "start")).join(moved, "id", "left")
    return written(out.withColumn("motif", F.coalesce("new", "motif")).drop("id", "new"))


def motif_distances(members: DataFrame) -> DataFrame:
    """m1 <= m2 and dist: the mean over all pairs of members of the squared distance by length, from means and variances; no pair is made."""
    g = members.select("motif", F.posexplode("v").alias("i", "x")).groupBy("motif", "i").agg(F.avg("x").alias("m"), F.var_pop("x").alias("s"))
    b = g.select(F.col("motif").alias("m2"), "i", F.col("m").alias("mb"), F.col("s").alias("sb"))
    gap = F.col("m") - F.col("mb")
    return g.withColumnRenamed("motif", "m1").join(b, "i").where("m1 <= m2").groupBy("m1", "m2").agg(F.avg(gap * gap + F.col("s") + F.col("sb")).alias("dist"))


#: Motifs at most: their distances are held by the driver.
MOTIFS_AT_MOST = 1000


def merge_step(rows: DataFrame, motifs: DataFrame, size: int = 6, a: float = 50.0, b: float = 1000.0) -> DataFrame:
    """motifs, with those joined, nearest first by average linkage, whose distance is below the root of a * child + b, for both children; the first that is not ends it."""
    pairs = motif_distances(member_vectors(rows, motifs, size)).limit(MOTIFS_AT_MOST**2 + 1).collect()
    if len(pairs) > MOTIFS_AT_MOST**2:
        raise ValueError(f"over {MOTIFS_AT_MOST} motifs")
    names = sorted({r["m1"] for r in pairs} | {r["m2"] for r in pairs})
    at = {m: i for i, m in enumerate(names)}
    dist = np.full((len(names), len(names)), np.inf)
    for r in pairs:
        if r["m1"] != r["m2"]:
            dist[at[r["m1"]], at[r["m2"]]] = dist[at[r["m2"]], at[r["m1"]]] = r["dist"]
    height, into = [0.0] * len(names), {m: m for m in names}
    for i, j, far in hmm.linkage(dist, "average") if len(names) > 1 else ():
        if not far < min(np.sqrt(a * height[i] + b), np.sqrt(a * height[j] + b)):
            break
        height[i] = far
        into = {m: names[i] if to == names[j] else to for m, to in into.items()}
    moved = {m: to for m, to in into.items() if m != to}
    if not moved:
        return motifs
    return written(motifs.withColumn("motif", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in moved.items() for x in kv]), F.col("motif")), "motif")))


def growths(rows: DataFrame, motifs: DataFrame) -> DataFrame:
    """motif, side (front or back) and z of every growth by one frame that is open to all occurrences of a motif.

    z says how much values vary there: the variance over occurrences against the mean and deviation of those at the motif's
    own places, in deviations, added over dimensions.
    """
    taken = motifs.select("series_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("t")).distinct().withColumn("taken", F.lit(True))
    reach = motifs.select("motif", "series_id", "start", "len", F.explode(F.sequence(F.lit(-1), F.col("len"))).alias("o")).withColumn("t", F.col("start") + F.col("o"))
    met = reach.join(rows.select("series_id", "t", F.array("x", "h").alias("x")), ["series_id", "t"]).join(taken, ["series_id", "t"], "left")
    side = F.when(F.col("o") < 0, "front").when(F.col("o") == F.col("len"), "back").otherwise("own")
    long = met.select("motif", "o", side.alias("side"), "taken", F.posexplode("x").alias("dim", "x"))
    var = long.groupBy("motif", "side", "o", "dim").agg(F.var_pop("x").alias("v"), F.count(F.when((F.col("side") != "own") & F.col("taken"), 1)).alias("barred"), F.count("*").alias("n"))
    own = var.where("side = 'own'").groupBy("motif", "dim").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    ends = var.where("side <> 'own' and barred = 0").join(own, ["motif", "dim"]).join(motifs.groupBy("motif").agg(F.count("*").alias("all")), "motif").where("n = all and n > 1 and s > 0")
    return ends.groupBy("motif", "side").agg(F.round(F.sum(F.try_divide(F.col("v") - F.col("m"), "s")) / F.sqrt(F.count("*").cast("double")), 9).alias("z"))


def claims(motifs: DataFrame, grown: DataFrame) -> DataFrame:
    """motif, side, z, series_id and t: the frame that each growth would take from each occurrence of its motif."""
    at = F.when(F.col("side") == "front", F.col("start") - 1).otherwise(F.col("start") + F.col("len"))
    return motifs.join(grown, "motif").select("motif", "side", "z", "series_id", at.alias("t"))


def settled(claimed: DataFrame) -> DataFrame:
    """motif and side of growths of which no better one, by z, motif and side, wants a frame or the same motif: no two of them claim one frame, and the best of all is among them."""
    place = F.struct("z", "motif", "side")
    first = claimed.groupBy("series_id", "t").agg(F.min(place).alias("f"))  # of a frame, its first claim
    own = claimed.select("motif", "side", "z").distinct().groupBy("motif").agg(F.min(place).alias("m"))
    beaten = claimed.join(first, ["series_id", "t"]).where(place > F.col("f")).select("motif", "side").distinct()
    best = own.select("m.motif", "m.side")
    return best.join(beaten, ["motif", "side"], "left_anti")


def grow_step(rows: DataFrame, motifs: DataFrame, limit: float = 0.0, one: bool = False) -> DataFrame | None:
    """motifs, some of them longer by one frame; None if none may grow: no side has z below `limit`.

    The best growth of all is taken, and with it (but for one=True) every other that no better one stands against, so
    that no frame is taken twice.
    """
    open_ = written(claims(motifs, growths(rows, motifs).where(F.col("z") < limit)))
    if one:
        best = open_.orderBy("z", "motif", "side").select("motif", "side").limit(1)
    else:
        best = settled(open_)
    best = written(best)
    if best.isEmpty():
        return None
    out = motifs.join(F.broadcast(best), "motif", "left")  # a row a motif at most
    front = F.when(F.col("side") == "front", 1).otherwise(0)
    grown = out.withColumn("start", (F.col("start") - front).cast("int")).withColumn("len", (F.col("len") + F.col("side").isNotNull().cast("int")).cast("int"))
    return written(grown.select(*motifs.columns))


def grown(rows: DataFrame, motifs: DataFrame, limit: float = 0.0, steps: int | None = None) -> DataFrame:
    """Motifs grown until none may grow, or for a number of steps."""
    for _ in range(steps) if steps is not None else count():
        if (new := grow_step(rows, motifs, limit)) is None:
            break
        motifs = new
    return motifs


def _steps(spark, d, *, split: bool = False, merge: bool = False, affix: bool = False, grow: bool = False) -> DataFrame:
    rows = written(frames(spark, d))
    m = written(hash_rounds(rows, limit=limit_by_frames(rows)))
    m = split_step(rows, m) if split else m
    m = merge_step(rows, m) if merge else m
    while affix and (new := affix_step(rows, m)) is not None:
        m = new
    m = grown(rows, m) if grow else m
    return m.select("motif", "hash", "series_id", "start", "len")


@query("split_motifs")
def split_motifs(spark, d):
    """Hashed motifs, split where they fall into two."""
    return _steps(spark, d, split=True)


@query("merge_motifs")
def merge_motifs(spark, d):
    """Hashed motifs, merged where they are near."""
    return _steps(spark, d, merge=True)


@query("affix_motifs")
def affix_motifs(spark, d):
    """Hashed motifs, joined where one follows another."""
    return _steps(spark, d, affix=True)


@query("grow_motifs")
def grow_motifs(spark, d):
    """Hashed motifs, grown frame by frame where their occurrences agree, the best growth first, until none is left."""
    return _steps(spark, d, grow=True)


@query("auto_pipeline")
def auto_pipeline(spark, d):
    """Discovery, split, merge, affix and growth, one after another."""
    return _steps(spark, d, split=True, merge=True, affix=True, grow=True)


@query("density_seeds", f"{every_window(OPTIMA).replace('WITH ', 'WITH RECURSIVE ', 1)}, ls AS (SELECT {AT}, dist FROM lo), {greedy_sql('ls', size=2)} SELECT series_id, start::INT AS start, round(dist, 5) AS dist FROM taken JOIN ls USING (series_id, start)")
def density_seeds(spark, d, size: int = SIZE, share: float = 0.8):
    """Seeds by neighbour density: local optima, without those that overlap a better one by `share` or more of their length."""

    def each(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["dist", "start"])
        gap = next(d for d in range(size + 1) if size - d < share * size)  # the least distance at which two overlap by less
        return g[g["start"].isin(spaced(g["start"].tolist(), gap))]

    rows = optima(frames(spark, d), every=1).select(*unpacked("id", "series_id", "start"), "dist")
    kept = rows.groupBy("series_id").applyInPandas(each, "series_id long, start int, dist double")
    return kept.select("series_id", "start", F.round("dist", 5).alias("dist"))


GROWN = f"""{OPTIMA}, me AS (SELECT id, id AS m FROM lo UNION ALL SELECT lo.id, kn.nbr FROM lo JOIN kn USING (id)), of AS (SELECT me.id, k - 8 AS o, f.x FROM me, range(24) r(k) LEFT JOIN fr f ON f.series_id = m // 4294967296 AND f.t = m % 4294967296 + k - 8),
va AS (SELECT id, o, CASE WHEN count(x) = count(*) THEN var_pop(x) END AS v FROM of GROUP BY ALL), ba AS (SELECT id, avg(v) AS base FROM va WHERE o BETWEEN 0 AND 7 GROUP BY 1),
st AS (SELECT id, CASE WHEN o < 0 THEN -1 ELSE 1 END AS side, CASE WHEN o < 0 THEN -o ELSE o - 7 END AS k, v FROM va WHERE o < 0 OR o > 7),
ru AS (SELECT st.id, side, k, v IS NULL OR (base * 8 + sum(v) OVER (PARTITION BY st.id, side ORDER BY k)) / (8 + k) > 1.21 * base AS ends FROM st JOIN ba ON ba.id = st.id),
re AS (SELECT id, side, coalesce(min(k) FILTER (ends), 9) - 1 AS n FROM ru GROUP BY ALL)"""


@query("seed_growth", f"{GROWN} SELECT {AT.replace('(id % 4294967296)::INT AS start', '(id % 4294967296 - l.n)::INT AS start').replace('id //', 'l.id //').replace('(id %', '(l.id %')}, (8 + l.n + r.n)::INT AS len FROM re l JOIN re r ON l.id = r.id AND l.side = -1 AND r.side = 1")
def seed_growth(spark, d, size: int = SIZE, limit: float = 1.21):
    """Seeds grown to both sides while the mean variance over their members (neighbours in any series) stays within `limit` of the window's own."""
    rows = frames(spark, d)
    seeds = optima(rows, size).select("id")
    members = window_knn(rows, size).join(seeds, "id", "left_semi").select("id", F.col("nbr").alias("m")).union(seeds.select("id", F.col("id").alias("m")))
    at = members.select("id", *unpacked("m", "series_id", "start"), F.explode(F.sequence(F.lit(-size), F.lit(2 * size - 1))).alias("o")).withColumn("t", F.col("start") + F.col("o"))
    met = at.join(rows.select("series_id", "t", "x"), ["series_id", "t"], "left")
    var = met.groupBy("id", "o").agg(F.when(F.count("x") == F.count("*"), F.var_pop("x")).alias("v"))
    s = var.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "v"))), lambda p: p.v).alias("v"))  # 3 * size values
    base = F.aggregate(F.slice("v", size + 1, size), F.lit(0.0), lambda a, x: a + x) / size

    def reach(values: Column) -> Column:
        start = F.struct((F.col("base") * size).alias("total"), F.lit(size).alias("n"), F.lit(True).alias("on"))

        def step(a, x):
            total = a.total + F.coalesce(x, F.lit(0.0))
            fits = a.on & x.isNotNull() & (total / (a.n + 1) <= limit * F.col("base"))
            return F.struct(F.when(fits, total).otherwise(a.total).alias("total"), F.when(fits, a.n + 1).otherwise(a.n).alias("n"), F.coalesce(fits, F.lit(False)).alias("on"))

        return F.aggregate(values, start, step, lambda a: a.n - size)

    s = s.withColumn("base", base)
    s = s.select("id", reach(F.reverse(F.slice("v", 1, size))).alias("l"), reach(F.slice("v", 2 * size + 1, size)).alias("r"))
    series, start = unpacked("id", "series_id", "start")
    return s.select(series, (F.pmod(F.col("id"), F.lit(SHIFT)) - F.col("l")).cast("int").alias("start"), (size + F.col("l") + F.col("r")).cast("int").alias("len"))


PER_SERIES = f"{W}, p AS (SELECT a.id, b.series_id AS other, min({L2}) AS dist FROM w a JOIN w b ON a.id % 50 = 0 AND {APART} GROUP BY ALL), sc AS (SELECT id, sum(dist) AS score FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, other) <= 5) GROUP BY 1)"


def exemplar_scores(rows: DataFrame, size: int = SIZE, most: int = 5, free: DataFrame | None = None) -> DataFrame:
    """id and score of each query window: the sum of its distances to its best match in each of the `most` series that match it best."""
    w = windows(rows, size) if free is None else free
    return best_per_series(asked(w), w, most, apart=size).groupBy("id").agg(F.sum("dist").alias("score"))


@query("exemplar_scores", f"{PER_SERIES} SELECT {AT}, round(score, 5) AS score FROM sc")
def exemplar_scores_query(spark, d):
    return exemplar_scores(frames(spark, d)).select(*unpacked("id", "series_id", "start"), F.round("score", 5).alias("score"))


@query("exemplar_window", f"{PER_SERIES} SELECT {AT}, round(score, 5) AS score FROM sc ORDER BY round(score, 5), id LIMIT 1")
def exemplar_window(spark, d):
    """The query window that matches other series best."""
    best = exemplar_scores(frames(spark, d)).withColumn("score", F.round("score", 5)).orderBy("score", "id").limit(1)
    return best.select(*unpacked("id", "series_id", "start"), "score")


def gaussian_fit(v: Column, mean: list[float], var: list[float]) -> Column:
    """The log-likelihood of v by a Gaussian at each place."""
    m, s = F.array(*map(F.lit, mean)), F.array(*map(F.lit, var))
    terms = F.transform(F.arrays_zip(v.alias("v"), m.alias("m"), s.alias("s")), lambda x: -0.5 * (F.ln(2 * F.pi() * x.s) + (x.v - x.m) * (x.v - x.m) / x.s))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def best_exemplar(free: DataFrame, size: int, most: int = 5) -> DataFrame:
    """id, series_id, nbr and dist: of all windows (id, v) the one whose distances to its best match in each of the `most` series that match it best have the least sum, ties by id, and these matches.

    A fiftieth of the windows gives a first sum. One that passes it has a window within the `most`-th part of it, where
    all have matches in as many series; only those that have are searched for in full.
    """
    w = celled(free)
    scored = lambda q: checkpointed(best_per_series(q, w, most, apart=size))
    best = lambda m: m.groupBy("id").agg(F.sum("dist").alias("score"), F.count("*").alias("n")).orderBy("score", "id").first()
    found = scored(asked(w))
    first, rest = best(found), w.rows.select("id", "v").where(F.col("id") % EVERY != 0)
    if first is not None and w.rows.select(F.floor(F.col("id") / SHIFT)).distinct().limit(most + 1).count() > most:
        if first["score"] == 0:
            rest = rest.where(F.col("id") < first["id"])
        rest = rest.join(with_near(rest, w, first["score"] / most * (1 + 1e-9), apart=size), "id", "left_semi")
        found = found.where(F.col("id") == first["id"])
    found = checkpointed(found.unionByName(scored(rest)))
    top = best(found)
    return found.where(F.col("id") == top["id"]) if top is not None else found


@query("exemplar_discover")
def exemplar_discover(spark, d, size: int = SIZE, patterns: int = 3, refits: int = 2, floor: float = 1.0, least: int = 3):
    """Exemplar search over all series: the best exemplar of all windows, a model of its best matches, all free windows that the model explains better than a garbage model does, swept; the model is fit again on them; they are chopped out, and the rest is searched again.

    The garbage model is one Gaussian over all frames, the pattern's a Gaussian at each place, with the exemplar's
    matches' variances, at least `floor`. It ends after `patterns`, or when fewer than `least` occurrences are found.
    Rows are 1-based: start, and stop after the last frame.
    """
    rows = frames(spark, d)
    g = rows.agg(F.avg("x").alias("m"), F.var_pop("x").alias("v")).first()
    free = checkpointed(windows(rows, size))
    found = None
    for n in range(patterns):
        matches = best_exemplar(free, size)
        if matches.isEmpty():
            break
        held = matches.select(F.col("nbr").alias("id")).union(matches.select("id"))
        occs = None
        for _ in range(refits + 1):
            fit = free.join(held.distinct(), "id", "left_semi").select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.greatest(F.var_pop("x"), F.lit(floor)).alias("v")).orderBy("i").collect()
            gain = gaussian_fit(F.col("v"), [r["m"] for r in fit], [r["v"] for r in fit]) - gaussian_fit(F.col("v"), [g["m"]] * size, [g["v"]] * size)
            hits = free.withColumn("gain", gain).where("gain > 0").select(*unpacked("id", "series_id", "start"))
            occs = checkpointed(sweep(hits, size))
            if occs.limit(least).count() < least:
                break
            held = occs.select(packed("series_id", "start").alias("id"))
        if occs.limit(least).count() < least:
            break
        kept = occs.select("series_id", F.lit(n).alias("pattern"), (F.col("start") + 1).alias("start"), (F.col("start") + size + 1).alias("stop"))
        found = kept if found is None else found.unionByName(kept)
        left = without(free.select(*unpacked("id", "series_id", "start"), "id", "v"), occs.withColumn("len", F.lit(size)), size)
        free = checkpointed(left.select("id", "v"))
    return found if found is not None else rows.limit(0).select("series_id", F.lit(0).alias("pattern"), F.col("t").alias("start"), F.col("t").alias("stop"))


@query("presplit_silence", f"""WITH {FRAMES}, w AS (SELECT series_id, t, var_samp(x) OVER o AS v0, var_samp(h) OVER o AS v1, count(*) OVER o AS n FROM fr WINDOW o AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)), f AS (SELECT * FROM w WHERE n = 8), m AS (SELECT min(v0) AS l0, max(v0) AS h0, min(v1) AS l1, max(v1) AS h1 FROM f),
s AS (SELECT series_id, t AS a, t AS b FROM f, m WHERE v0 <= l0 + (h0 - l0) / 4 AND v1 <= l1 + (h1 - l1) / 4),
s1 AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY series_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3, true)::INT AS n FROM s), s2 AS (SELECT *, sum(n) OVER (PARTITION BY series_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS g FROM s1), u AS (SELECT series_id, min(a) AS a, max(b) AS b FROM s2 GROUP BY series_id, g HAVING max(b) - min(a) + 1 >= 5),
wh AS (SELECT series_id, max(t) AS b FROM fr GROUP BY 1), e AS (SELECT * FROM u UNION ALL SELECT series_id, b + 1, b + 1 FROM wh), c AS (SELECT series_id, coalesce(max(b) OVER (PARTITION BY series_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 0) AS a, a - 1 AS b FROM e) SELECT series_id, a, b FROM c WHERE b - a + 1 >= 6""")
def presplit_silence(spark, d):
    """Pieces between long silences: silent starts are closed over gaps of two, kept if five or more, and taken out."""
    quiet = silence(spark, d).select("series_id", F.col("t").alias("a"), F.col("t").alias("b"))
    long = coalesce(quiet, 3).where("b - a + 1 >= 5")
    return complement(long, whole(frames(spark, d))).where("b - a + 1 >= 6")


POOL = f"""{every_window(OPTIMA)}, {SAX.replace(f'{WINDOW8}, ', '')}, nw AS (SELECT series_id, word, count(*) AS n, min(start) AS start FROM sx GROUP BY ALL), gs AS (SELECT avg(x) AS m, var_pop(x) AS v FROM fr),
wf AS (SELECT series_id, t FROM fr, gs ORDER BY round(-0.5 * (ln(2 * pi() * v) + (x - m) * (x - m) / v), 6), series_id, t LIMIT 50)
SELECT 'random' AS strategy, series_id, start::INT AS start FROM (SELECT series_id, start FROM w QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY md5('seed:' || series_id || ':' || start)) <= 2)
UNION ALL SELECT 'unlikely', w.series_id, w.start::INT FROM wf JOIN w ON w.series_id = wf.series_id AND w.start = greatest(wf.t - 4, 0)
UNION ALL SELECT 'cluster', id // 4294967296, (id % 4294967296)::INT FROM lo
UNION ALL SELECT 'projection', series_id, start::INT FROM (SELECT * FROM nw QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY n DESC, start) = 1)
UNION ALL SELECT 'exhaustive', series_id, start::INT FROM w"""


@query("seed_pool", POOL)
def seed_pool(spark, d, size: int = SIZE):
    """Seeds of several strategies, as they are: random, unlikely, clustered, projected and exhaustive."""
    rows = frames(spark, d)
    every = sliding(rows, size).select("series_id", "start")
    order = Window.partitionBy("series_id").orderBy(F.md5(F.concat_ws(":", F.lit("seed"), "series_id", "start")))
    some = every.withColumn("k", F.row_number().over(order)).where("k <= 2")
    unlikely = worst_frames(spark, d).select("series_id", F.greatest(F.col("t") - size // 2, F.lit(0)).alias("start")).join(every, ["series_id", "start"])
    cluster = optima(rows, size, every=1).select(*unpacked("id", "series_id", "start"))
    words = sax(rows, size)
    n = words.groupBy("series_id", "word").agg(F.count("*").alias("n"), F.min("start").alias("start"))
    often = Window.partitionBy("series_id").orderBy(F.desc("n"), "start")
    projection = n.withColumn("k", F.row_number().over(often)).where("k = 1")
    out = None
    for name, part in [("random", some), ("unlikely", unlikely), ("cluster", cluster), ("projection", projection), ("exhaustive", every)]:
        part = part.select(F.lit(name).alias("strategy"), "series_id", F.col("start").cast("int").alias("start"))
        out = part if out is None else out.unionByName(part)
    return out


def _scan_sql(size: int) -> str:
    return f"SELECT {size} AS size, count(*) FILTER (dist <= 40) AS within_40, count(*) FILTER (dist <= 80) AS within_80, count(*) FILTER (dist <= 120) AS within_120 FROM (SELECT sqrt(list_sum([(a.xs[i] - b.xs[i]) * (a.xs[i] - b.xs[i]) FOR i IN range(1, {size + 1})])) AS dist FROM w{size} a JOIN w{size} b ON (a.series_id * 4294967296 + a.start) % 50 = 0 AND (a.series_id <> b.series_id OR abs(a.start - b.start) >= {size}))"


SCAN = ", ".join(f"w{s} AS (SELECT * FROM (SELECT series_id, t AS start, list(x) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND {s - 1} FOLLOWING) AS xs FROM fr) WHERE len(xs) = {s})" for s in (6, 8, 10))


@query("parameter_scan", f"WITH {FRAMES}, {SCAN} {' UNION ALL '.join(map(_scan_sql, (6, 8, 10)))}")
def parameter_scan(spark, d, sizes: tuple[int, ...] = (6, 8, 10), radii: tuple[float, ...] = (40.0, 80.0, 120.0)):
    """How many windows lie within each radius of the query windows, for several lengths, by one search a length."""
    rows, out = frames(spark, d), None
    for size in sizes:
        w = windows(rows, size)
        near = within(asked(w), w, max(radii), apart=size)
        part = near.agg(*[F.count(F.when(F.col("dist") <= r, 1)).alias(f"within_{int(r)}") for r in radii]).withColumn("size", F.lit(size))
        out = part if out is None else out.unionByName(part)
    return out


@query("noise_dimension")
def noise_dimension(spark, d):
    """Frames with two more dimensions: white noise, and a random walk of it along the series. Hashes are the chances, so reruns agree."""
    rows = frames(spark, d).select("series_id", "t", "x")
    chance = lambda s: (F.pmod(F.xxhash64(F.lit(s), "series_id", "t"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    white = F.sqrt(-2 * F.ln(chance("a"))) * F.cos(2 * F.pi() * chance("b")) * (10**0.5)
    order = Window.partitionBy("series_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    step = (0.1 + 2 * chance("c")) * F.when(chance("d") < 0.5, -1).otherwise(1)
    return rows.withColumn("white", white).withColumn("step", step).select("series_id", "t", "x", "white", F.sum("step").over(order).alias("walk"))


@query("neighbour_invariant", f"{DISJOINT} SELECT (SELECT count(*) FROM dj WHERE id // 4294967296 = nbr // 4294967296 AND abs(id - nbr) < 8) + (SELECT count(*) FROM dj a JOIN dj b ON a.id = b.id AND a.rank < b.rank AND a.nbr // 4294967296 = b.nbr // 4294967296 AND abs(a.nbr - b.nbr) < 8) AS broken")
def neighbour_invariant(spark, d):
    """No neighbour overlaps its window or another neighbour of it: a count of those that do, in a search that bars neither of the two pairs beforehand for the second."""
    dj = disjoint(frames(spark, d))
    same = lambda a, b: (F.floor(F.col(a) / SHIFT) == F.floor(F.col(b) / SHIFT)) & (F.abs(F.col(a) - F.col(b)) < SIZE)
    own = dj.where(same("id", "nbr")).agg(F.count("*").alias("a"))
    other = dj.select("id", F.col("rank").alias("r2"), F.col("nbr").alias("nbr2"))
    mutual = dj.join(other, "id").where((F.col("rank") < F.col("r2")) & same("nbr", "nbr2")).agg(F.count("*").alias("b"))
    return own.join(mutual).select((F.col("a") + F.col("b")).alias("broken"))


TAU = 120.0
PEELED = f"{W}, q AS (SELECT * FROM w WHERE id % 50 = 0), p AS (SELECT a.id, b.id AS nbr, {L2} AS dist FROM q a JOIN w b ON {APART}), de AS (SELECT id, sum(exp(-0.5 * dist * dist / ({TAU} / 3))) AS density FROM p WHERE dist <= {TAU} GROUP BY 1), nb AS (SELECT p.id, list(p.nbr) AS nbs FROM p JOIN de ON de.id = p.nbr WHERE dist <= {TAU} GROUP BY 1)"


@query("mode_peeling", f"{PEELED.replace('WITH ', 'WITH RECURSIVE ', 1)}, h2 AS (SELECT de.id, density, nbs, row_number() OVER (ORDER BY density DESC, id) AS r FROM de LEFT JOIN nb USING (id)), g AS (SELECT r, [id] AS t FROM h2 WHERE r = 1 UNION ALL SELECT h2.r, CASE WHEN list_has_any(g.t, coalesce(nbs, [])) THEN g.t ELSE list_append(g.t, id) END FROM g JOIN h2 ON h2.r = g.r + 1), tk AS (SELECT unnest(arg_max(t, r)) AS id FROM g) SELECT {AT}, round(density, 5) AS density FROM tk JOIN de USING (id)")
def mode_peeling(spark, d, tau: float = TAU):
    """Modes among the query windows: the densest, without those within tau of it; again, till none is left.

    A window whose density no other left within tau passes is a mode in any order, so each round takes all of these.
    """
    w = celled(windows(frames(spark, d)))
    q = asked(w)
    dens = checkpointed(q.join(densities(q, w, tau, SIZE), "id"))
    left, modes = dens, None
    while True:
        new = checkpointed(left.join(near_ids(left, left, tau, SIZE, denser=True), "id", "left_anti"))
        if new.isEmpty():
            break
        modes = new if modes is None else modes.unionByName(new)
        gone = near_ids(left, new, tau, SIZE).union(new.select("id"))
        left = checkpointed(left.join(gone, "id", "left_anti"))
    modes = dens if modes is None else modes
    return modes.select(*unpacked("id", "series_id", "start"), F.round("density", 5).alias("density"))


RADII = f"{HASHED}, w6 AS (SELECT series_id, start, xs FROM (SELECT series_id, t AS start, list(x) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS xs FROM fr) WHERE len(xs) = 6), ov AS (SELECT oc.hash, series_id, start, xs FROM oc JOIN en USING (hash) JOIN w6 USING (series_id, start))"
_FAR = "sqrt(list_sum([(a.xs[i] - b.xs[i]) * (a.xs[i] - b.xs[i]) FOR i IN range(1, 7)]))"


@query("motif_radius", f"{RADII}, f1 AS (SELECT hash, arg_min(xs, (series_id, start)) AS xs FROM ov GROUP BY 1), d1 AS (SELECT b.hash, b.series_id, b.start, b.xs, round({_FAR}, 6) AS dist FROM f1 a JOIN ov b USING (hash)), f2 AS (SELECT hash, xs FROM d1 QUALIFY row_number() OVER (PARTITION BY hash ORDER BY dist DESC, series_id, start) = 1), d2 AS (SELECT hash, count(*) AS n, max({_FAR}) / 2 AS radius FROM f2 a JOIN ov b USING (hash) GROUP BY 1) SELECT hash, n, round(radius, 5) AS radius, CASE WHEN n < 2 THEN 0 ELSE round(n / radius, 6) END AS density FROM d2")
def motif_radius(spark, d):
    """Radius and density of hashed entries: half the distance from the occurrence farthest from the first to the one farthest from it, and occurrences by radius."""
    rows = frames(spark, d)
    h = hashed(rows)
    own = swept(h.join(entries(h).select("hash"), "hash", "left_semi")).select("hash", packed("series_id", "start").alias("id"))
    own = checkpointed(own.join(windows(rows, 6), "id"))
    first = own.groupBy("hash").agg(F.min_by("v", "id").alias("f"))
    dist = F.sqrt(squared_distance(F.col("v"), F.col("f")))
    far = own.join(first, "hash").select("hash", "id", "v", F.round(dist, 6).alias("dist"))
    second = far.groupBy("hash").agg(F.max_by("v", F.struct("dist", (-F.col("id")).alias("i"))).alias("f"))
    r = own.join(second, "hash").groupBy("hash").agg(F.count("*").alias("n"), (F.max(dist) / 2).alias("radius"))
    return r.select("hash", "n", F.round("radius", 5).alias("radius"), F.when(F.col("n") < 2, 0.0).otherwise(F.round(F.try_divide("n", "radius"), 6)).alias("density"))
