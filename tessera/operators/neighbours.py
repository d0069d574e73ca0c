"""Queries on distances between windows and vectors: neighbours, ranges, densities, occurrences, greedy selection and components.

Windows that are queries are those whose id (series * 2**32 + start) is divisible by 50, or all where `every` is 1; every
window of every series at every start is searched.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.catalog import FRAMES, MARKUP, query
from tessera.functions.dtw import dtw
from tessera.functions.vectors import lower_bound, projection, squared_distance
from tessera.operators.search import EVERY, asked, celled, indexed, nearest, nearest_any, packed, pair_stats, unpacked, windows, within
from tessera.operators.spans import complement, of_tag, whole
from tessera.operators.symbols import AVERAGE, LETTERS, WARPED, scored
from tessera.operators.windows import WINDOW8
from tessera.plans.rounds import checkpointed, written
from tessera.sources.frames import frames, load, runs

TAU = 1.2
SIZE = 8


def vectors(spark, d) -> DataFrame:
    return load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def _table(spark, d) -> DataFrame:
    return vectors(spark, d).select(F.col("vec_id").alias("id"), "v")


EMB = "em AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"
DIST = "sqrt(list_sum([(a.v[i] - b.v[i]) * (a.v[i] - b.v[i]) FOR i IN range(1, 65)]))"


@query("knn_l2", f"WITH {EMB}, p AS (SELECT a.vec_id, b.vec_id AS nbr_id, {DIST} AS dist FROM em a, em b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) SELECT vec_id, nbr_id, round(dist, 5) AS dist, row_number() OVER (PARTITION BY vec_id ORDER BY dist, nbr_id) AS rank FROM p QUALIFY rank <= 5")
def knn_l2(spark, d):
    v = _table(spark, d)
    return nearest(asked(v), v, 5).select(F.col("id").alias("vec_id"), F.col("nbr").alias("nbr_id"), F.round("dist", 5).alias("dist"), "rank")


@query("range_search", f"WITH {EMB} SELECT a.vec_id, b.vec_id AS nbr_id, round({DIST}, 5) AS dist FROM em a, em b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND {DIST} <= {TAU}")
def range_search(spark, d):
    v = _table(spark, d)
    return within(asked(v), v, TAU).select(F.col("id").alias("vec_id"), F.col("nbr").alias("nbr_id"), F.round("dist", 5).alias("dist"))


KDE = f"WITH {EMB}, p AS (SELECT a.vec_id, b.vec_id AS nbr_id, {DIST} AS dist FROM em a, em b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND {DIST} <= {TAU}), k AS (SELECT vec_id, count(*) AS n, sum(exp(-0.5 * dist * dist / ({TAU} / 3))) AS density FROM p GROUP BY 1)"


def density(near: DataFrame, radius: float) -> DataFrame:
    """id, n and density: a Gaussian of variance radius / 3 over all rows within the radius of each query."""
    return near.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.exp(-0.5 * F.col("dist") * F.col("dist") / (radius / 3))).alias("density"))


@query("kde_density", f"{KDE} SELECT vec_id, n, round(density, 5) AS density FROM k")
def kde_density(spark, d):
    v = _table(spark, d)
    return density(within(asked(v), v, TAU), TAU).select(F.col("id").alias("vec_id"), "n", F.round("density", 5).alias("density"))


W = f"WITH {FRAMES}, {WINDOW8}, w AS (SELECT series_id, start, series_id * 4294967296 + start AS id, xs FROM w8 WHERE len(xs) = 8)"
APART = "(a.series_id <> b.series_id OR abs(a.start - b.start) >= 8)"
L2 = "sqrt(list_sum([(a.xs[i] - b.xs[i]) * (a.xs[i] - b.xs[i]) FOR i IN range(1, 9)]))"
KNN = f"{W}, p AS (SELECT a.id, b.id AS nbr, {L2} AS dist FROM w a JOIN w b ON a.id % 50 = 0 AND {APART}), kn AS (SELECT id, nbr, dist, row_number() OVER (PARTITION BY id ORDER BY dist, nbr) AS rank FROM p QUALIFY rank <= 3)"
AT = "id // 4294967296 AS series_id, (id % 4294967296)::INT AS start"
NBR = "nbr // 4294967296 AS nbr_series, (nbr % 4294967296)::INT AS nbr_start"


def _at() -> list[Column]:
    return unpacked("id", "series_id", "start")


def _nbr() -> list[Column]:
    return unpacked("nbr", "nbr_series", "nbr_start")


def warped_sql(rows: str, size: int = 8) -> str:
    """SQL that gives `dtw`, the warping distance within one frame of the diagonal, to rows with the lists xs and ys: three cells of each line of the table at a time."""
    cost = lambda i, j: f"(xs[{i + 1}] - ys[{j + 1}]) * (xs[{i + 1}] - ys[{j + 1}])"
    out = f"(SELECT *, NULL::DOUBLE AS c0, {cost(0, 0)} AS c1, {cost(0, 0)} + {cost(0, 1)} AS c2 FROM {rows})"
    for i in range(1, size):
        up = f"(SELECT * EXCLUDE (c0, c1, c2), {cost(i, i - 1)} + least(c0, c1) AS n0, c1, c2 FROM {out})"
        up = f"(SELECT *, {cost(i, i)} + least(n0, c1, c2) AS n1 FROM {up})"
        last = f"{cost(i, i + 1)} + least(c2, n1)" if i + 1 < size else "NULL::DOUBLE"
        out = f"(SELECT * EXCLUDE (n0, n1, c1, c2), n0 AS c0, n1 AS c1, {last} AS c2 FROM {up})"
    return f"SELECT * EXCLUDE (c0, c1, c2), c1 AS dtw FROM {out}"


def every_window(sql: str) -> str:
    """SQL with all windows as queries."""
    return sql.replace("a.id % 50 = 0 AND ", "")


def window_knn(rows: DataFrame, size: int = SIZE, k: int = 3, metric: str = "l2", every: int = EVERY) -> DataFrame:
    """id, nbr, dist and rank: nearest windows of all series that do not overlap the query."""
    w = celled(windows(rows, size))
    return nearest(asked(w, every), w, k, metric, size)


@query("window_knn", f"{KNN} SELECT {AT}, {NBR}, round(dist, 5) AS dist, rank FROM kn")
def window_knn_query(spark, d):
    return window_knn(frames(spark, d)).select(*_at(), *_nbr(), F.round("dist", 5).alias("dist"), "rank")


OPTIMA = f"{KNN}, p2 AS (SELECT a.id, {L2} AS dist, b.id AS nbr FROM w a JOIN w b ON a.id IN (SELECT nbr FROM kn) AND {APART}), d2 AS (SELECT id, dist FROM p2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, nbr) = 3), lo AS (SELECT q.id, q.dist FROM kn q WHERE q.rank = 3 AND NOT EXISTS (SELECT 1 FROM kn k JOIN d2 ON d2.id = k.nbr WHERE k.id = q.id AND d2.dist < q.dist))"


def optima_and_near(rows: DataFrame, size: int = SIZE, k: int = 3, every: int = EVERY) -> tuple[DataFrame, DataFrame]:
    """`optima`, and what the search for them has found: id, nbr, dist and rank of all queries."""
    w = celled(windows(rows, size))
    kn = checkpointed(nearest(asked(w, every), w, k, "l2", size))
    theirs = kn if every == 1 else nearest(w.rows.join(kn.select(F.col("nbr").alias("id")).distinct(), "id", "left_semi"), w, k, "l2", size)
    theirs = theirs.where(F.col("rank") == k).select(F.col("id").alias("nbr"), F.col("dist").alias("theirs"))
    dk = kn.where(F.col("rank") == k).select("id", "dist")
    better = kn.select("id", "nbr").join(theirs, "nbr").groupBy("id").agg(F.min("theirs").alias("theirs"))
    return dk.join(better, "id", "left").where("theirs is null or theirs >= dist").select("id", "dist"), kn


def optima(rows: DataFrame, size: int = SIZE, k: int = 3, every: int = EVERY) -> DataFrame:
    """id and dist: queries none of whose neighbours has a smaller distance to its own k-th; neighbours are searched for in turn."""
    return optima_and_near(rows, size, k, every)[0]


@query("local_optima", f"{every_window(OPTIMA)} SELECT {AT}, round(dist, 5) AS dist FROM lo")
def local_optima(spark, d):
    return optima(frames(spark, d), every=1).select(*_at(), F.round("dist", 5).alias("dist"))


@query("seed_density", f"{KNN} SELECT {AT}, round(dist, 5) AS dist FROM kn WHERE rank = 3")
def seed_density(spark, d):
    """Windows in order of the distance to their third neighbour: the densest first."""
    return window_knn(frames(spark, d)).where("rank = 3").orderBy("dist", "id").select(*_at(), F.round("dist", 5).alias("dist"))


CLOSE = 60.0


@query("cluster_distance", f"{KNN}, o AS (SELECT id, id AS m FROM kn WHERE rank = 1 UNION SELECT id, nbr FROM kn WHERE rank = 1), ds AS (SELECT DISTINCT m FROM o), r AS (SELECT a.id AS m1, b.id AS m2, {L2} AS dist FROM w a JOIN ds x ON x.m = a.id, w b JOIN ds y ON y.m = b.id WHERE a.id = b.id OR {L2} <= {CLOSE}) SELECT x.id AS id1, y.id AS id2, round(min(dist), 5) AS dist FROM r JOIN o x ON x.m = r.m1 JOIN o y ON y.m = r.m2 WHERE x.id < y.id GROUP BY ALL")
def cluster_distance(spark, d, radius: float = CLOSE):
    """The least distance between the members (a query and its nearest window) of two queries' clusters, where it is `radius` at most."""
    w = celled(windows(frames(spark, d)))
    kn = checkpointed(nearest(asked(w), w, 1, "l2", SIZE))
    members = kn.select("id", F.explode(F.array("id", "nbr")).alias("m"))
    held = w.rows.join(members.select(F.col("m").alias("id")).distinct(), "id", "left_semi")
    near = within(held, held, radius).select(F.col("id").alias("m1"), F.col("nbr").alias("m2"), "dist")
    near = near.union(members.select("m", "m", F.lit(0.0)).distinct())
    a, b = (members.select(F.col("id").alias(f"id{i}"), F.col("m").alias(f"m{i}")) for i in (1, 2))
    return near.join(a, "m1").join(b, "m2").where("id1 < id2").groupBy("id1", "id2").agg(F.round(F.min("dist"), 5).alias("dist"))


@query("group_distance", f"WITH {EMB}, g AS (SELECT label, unnest(range(1, 65)) AS i, unnest(v) AS x FROM em), m AS (SELECT label, i, avg(x) AS m, var_pop(x) AS s, count(*) AS n FROM g GROUP BY ALL) SELECT a.label AS l1, b.label AS l2, round(sum((a.m - b.m) * (a.m - b.m) + a.s + b.s), 5) AS mean_ssd FROM m a JOIN m b ON a.i = b.i AND a.label < b.label GROUP BY ALL")
def group_distance(spark, d):
    """The mean squared distance of all pairs of two groups, from the groups' means and variances: no pair is made."""
    g = vectors(spark, d).select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"), F.var_pop("x").alias("s"))
    b = g.select(F.col("label").alias("l2"), "i", F.col("m").alias("m2"), F.col("s").alias("s2"))
    met = g.withColumnRenamed("label", "l1").join(b, "i").where("l1 < l2")
    diff = F.col("m") - F.col("m2")
    return met.groupBy("l1", "l2").agg(F.round(F.sum(diff * diff + F.col("s") + F.col("s2")), 5).alias("mean_ssd"))


@query("intra_class", f"WITH {EMB}, g AS (SELECT label, unnest(range(1, 65)) AS i, unnest(v) AS x FROM em), m AS (SELECT label, i, var_samp(x) AS s, count(*) AS n FROM g GROUP BY ALL) SELECT label, max(n) AS n, round(sum(2 * s), 5) AS mean_ssd FROM m GROUP BY label")
def intra_class(spark, d):
    """The mean squared distance of a class's pairs is twice its variance: no pair is made."""
    g = vectors(spark, d).select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.var_samp("x").alias("s"), F.count("*").alias("n"))
    return g.groupBy("label").agg(F.max("n").alias("n"), F.round(F.sum(2 * F.col("s")), 5).alias("mean_ssd"))


@query("group_extremes", f"WITH {EMB} SELECT a.label::VARCHAR AS g1, b.label::VARCHAR AS g2, count(*) AS n, round(min({DIST}), 5) AS low, round(avg({DIST}), 5) AS mean, round(max({DIST}), 5) AS high FROM em a JOIN em b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL")
def group_extremes(spark, d):
    """The least, mean and greatest distance of the queries of each group to all rows of each group."""
    v = vectors(spark, d).select(F.col("vec_id").alias("id"), "v", F.col("label").alias("g"))
    got = pair_stats(asked(v), v)
    return got.select("g1", "g2", "n", *[F.round(c, 5).alias(c) for c in ("low", "mean", "high")])


@query("class_warping", f"{W}, wt AS (SELECT w.*, fr.tag FROM w JOIN fr ON fr.series_id = w.series_id AND fr.t = w.start), pr AS (SELECT a.tag, b.tag AS tag2, a.xs, b.xs AS ys FROM wt a JOIN wt b ON a.id % 50 = 0 AND {APART}), dw AS ({warped_sql('pr')}) SELECT tag AS g1, tag2 AS g2, count(*) AS n, round(min(dtw), 4) / 8 AS low, round(avg(dtw) / 8, 3) AS mean, round(max(dtw), 4) / 8 AS high FROM dw GROUP BY ALL")
def class_warping(spark, d):
    """The least, mean and greatest warping distance, by length, of query windows to all windows, by the classes of their first frames."""
    rows = frames(spark, d)
    w = windows(rows).join(rows.select(packed("series_id", "t").alias("id"), F.col("tag").alias("g")), "id")
    got = pair_stats(asked(w), w, "dtw", SIZE)
    return got.select("g1", "g2", "n", (F.round(F.col("low") * SIZE, 4) / SIZE).alias("low"), F.round("mean", 3).alias("mean"), (F.round(F.col("high") * SIZE, 4) / SIZE).alias("high"))


@query("projection_length", f"WITH {EMB} SELECT vec_id, round(list_sum(v) / 8, 6) AS len FROM em")
def projection_length(spark, d):
    return vectors(spark, d).select("vec_id", F.round(projection(F.col("v")), 6).alias("len"))


#: The closest pair of a query and a window, as seeds; windows of all series that lie nearer than RADIUS to either are occurrences.
RADIUS = 100.0
SEEDS = f"{KNN}, sd AS (SELECT id AS s1, nbr AS s2 FROM kn WHERE rank = 1 ORDER BY dist, id LIMIT 1), sx AS (SELECT b.id AS s, b.xs FROM w b, sd WHERE b.id IN (sd.s1, sd.s2)), di AS (SELECT a.series_id, a.start, a.id, {L2} AS dist FROM w a, sx b)"
HITS = f"{SEEDS}, hit AS (SELECT series_id, start, min(dist) AS dist FROM di GROUP BY ALL HAVING min(dist) < {RADIUS})"


def closest(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """The two windows of the closest pair, as rows (id, v)."""
    w = windows(rows, size)
    pair = window_knn(rows, size, 1).orderBy("dist", "id").limit(1)
    return w.join(F.broadcast(pair.select(F.explode(F.array("id", "nbr")).alias("id"))), "id")


def to_seeds(rows: DataFrame, seeds: DataFrame, size: int = SIZE) -> DataFrame:
    """series_id, start, near and far: each window's distances to the nearer and the farther of two seeds."""
    w, s = windows(rows, size), F.broadcast(seeds.agg(F.collect_list("v").alias("s")))  # one row
    dist = F.transform("s", lambda v: F.sqrt(squared_distance(F.col("v"), v)))
    met = w.join(s).select("id", dist.alias("dist"))
    return met.select(*_at(), F.array_min("dist").alias("near"), F.array_max("dist").alias("far"))


def occurrences(rows: DataFrame, size: int = SIZE, radius: float = RADIUS) -> DataFrame:
    """series_id, start and dist of all windows within `radius` of either seed of the closest pair."""
    met = to_seeds(rows, closest(rows, size), size)
    return met.where(F.col("near") < radius).select("series_id", "start", F.col("near").alias("dist"))


def sweep(hits: DataFrame, size: int, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """From left to right, each hit that begins after the last one taken has ended: a fold over a series' own hits, for each value of other columns in `by`."""
    starts = F.sort_array(F.collect_list("start"))
    none = F.array().cast("array<int>")
    taken = F.aggregate("starts", none, lambda a, s: F.when((F.size(a) == 0) | (s >= F.element_at(a, -1) + size), F.concat(a, F.array(s))).otherwise(a))
    return hits.groupBy(*by).agg(starts.cast("array<int>").alias("starts")).select(*by, F.explode(taken).alias("start"))


@query("range_occurrences", f"{HITS} SELECT series_id, start, round(dist, 5) AS dist FROM hit")
def range_occurrences(spark, d):
    return occurrences(frames(spark, d)).select("series_id", "start", F.round("dist", 5).alias("dist"))


@query("greedy_sweep", HITS.replace("WITH ", "WITH RECURSIVE ", 1) + ", g AS (SELECT series_id, min(start) AS start FROM hit GROUP BY series_id UNION ALL SELECT g.series_id, (SELECT min(h.start) FROM hit h WHERE h.series_id = g.series_id AND h.start >= g.start + 8) FROM g WHERE g.start IS NOT NULL) SELECT series_id, start::INT AS start FROM g WHERE start IS NOT NULL")
def greedy_sweep(spark, d):
    return sweep(occurrences(frames(spark, d)), SIZE)


@query("motif_scan")
def motif_scan(spark, d, sizes: tuple[int, ...] = (6, 8, 10), radii: tuple[float, ...] = (40.0, 80.0, 120.0)):
    """For several lengths and radii, the occurrences that the closest pair of windows has, and the series in which they are."""
    rows, out = checkpointed(frames(spark, d)), None
    for size in sizes:
        near = to_seeds(rows, closest(rows, size), size).select("series_id", "start", "near", F.explode(F.array(*map(F.lit, radii))).alias("radius"))
        occs = sweep(near.where(F.col("near") < F.col("radius")), size, ("series_id", "radius"))
        part = occs.groupBy("radius").agg(F.count("*").alias("n"), F.countDistinct("series_id").alias("n_series")).withColumn("size", F.lit(size))
        out = part if out is None else out.unionByName(part)
    return out


def greedy_sql(rows: str, by: str = "dist, start", size: int = 8) -> str:
    """SQL for the greedy choice, within each series, of rows (series_id, start, dist) that lie `size` apart; the table is `taken`."""
    return f"""h2 AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY {by}) AS r FROM {rows}),
g AS (SELECT series_id, r, [start] AS t FROM h2 WHERE r = 1 UNION ALL SELECT h2.series_id, h2.r, CASE WHEN len(list_filter(g.t, lambda x: abs(x - h2.start) < {size})) = 0 THEN list_append(g.t, h2.start) ELSE g.t END FROM g JOIN h2 ON h2.series_id = g.series_id AND h2.r = g.r + 1),
taken AS (SELECT series_id, unnest(arg_max(t, r)) AS start FROM g GROUP BY series_id)"""


@query("safe_occurrences", f"{HITS}, bad AS (SELECT series_id, t FROM fr WHERE tag = 'error') SELECT series_id, start, round(dist, 5) AS dist FROM hit WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.series_id = hit.series_id AND bad.t >= hit.start AND bad.t < hit.start + 8)")
def safe_occurrences(spark, d, size: int = SIZE):
    """Occurrences that lie whole in spans that are free, here those without errors."""
    rows = frames(spark, d)
    free = complement(of_tag(runs(rows), "error"), whole(rows)).select(F.col("series_id").alias("s"), "a", "b")
    hits = occurrences(rows, size)
    inside = (F.col("series_id") == F.col("s")) & (F.col("a") <= F.col("start")) & (F.col("start") + size - 1 <= F.col("b"))
    return hits.join(free, inside).select("series_id", "start", F.round("dist", 5).alias("dist"))


def spaced(starts: list[int], size: float) -> list[int]:
    """Of starts in order of preference, each that is `size` or more away from all taken before, in order of place."""
    taken: list[int] = []
    for s in starts:
        i = bisect_left(taken, s)
        if (not i or s - taken[i - 1] >= size) and (i == len(taken) or taken[i] - s >= size):
            taken.insert(i, s)
    return taken


@query("greedy_by_distance", HITS.replace("WITH ", "WITH RECURSIVE ", 1) + f", {greedy_sql('hit')} SELECT series_id, start::INT AS start, round(dist, 5) AS dist FROM taken JOIN hit USING (series_id, start)")
def greedy_by_distance(spark, d, size: int = SIZE):
    """Of each series' hits, the nearest first, each that overlaps none taken before; ties by start."""

    def each(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["dist", "start"])
        return g[g["start"].isin(spaced(g["start"].tolist(), size))]

    kept = occurrences(frames(spark, d)).groupBy("series_id").applyInPandas(each, "series_id long, start int, dist double")
    return kept.select("series_id", "start", F.round("dist", 5).alias("dist"))


LB = "list_sum([greatest(0, ys[i] - list_max(xs[greatest(i - 1, 1):least(i + 1, 8)]), list_min(xs[greatest(i - 1, 1):least(i + 1, 8)]) - ys[i]) ** 2 FOR i IN range(1, 9)])"
PAIRS = f"{KNN}, pr AS (SELECT kn.id, kn.nbr, kn.rank, a.xs, b.xs AS ys FROM kn JOIN w a ON a.id = kn.id JOIN w b ON b.id = kn.nbr)"


def _pairs(spark, d) -> DataFrame:
    rows = frames(spark, d)
    w = windows(rows)
    met = window_knn(rows).join(w.withColumnRenamed("v", "xs"), "id")
    return met.join(w.select(F.col("id").alias("nbr"), F.col("v").alias("ys")), "nbr")


@query("lower_bounds", f"{PAIRS} SELECT {AT}, {NBR}, round({LB}, 4) AS lb FROM pr")
def lower_bounds(spark, d):
    """LB_Keogh of each query window and its nearest."""
    return _pairs(spark, d).select(*_at(), *_nbr(), F.round(lower_bound(F.col("xs"), F.col("ys"), 8, 1), 4).alias("lb"))


@query("dtw_pairs", f"{PAIRS} SELECT {AT}, {NBR}, round(dtw, 4) AS dtw, round({LB}, 4) AS lb, round(list_sum([(xs[i] - ys[i]) * (xs[i] - ys[i]) FOR i IN range(1, 9)]), 4) AS ssd FROM ({warped_sql('pr')})")
def dtw_pairs(spark, d):
    """DTW, its lower bound and the squared distance of each query window and its nearest: never below, never above."""
    measured = {"dtw": dtw("xs", "ys"), "lb": lower_bound(F.col("xs"), F.col("ys"), 8, 1), "ssd": squared_distance(F.col("xs"), F.col("ys"))}
    return _pairs(spark, d).select(*_at(), *_nbr(), *[F.round(c, 4).alias(n) for n, c in measured.items()])


WARPED_KNN = f"{W}, pr AS (SELECT a.id, b.id AS nbr, a.xs, b.xs AS ys FROM w a JOIN w b ON a.id % 50 = 0 AND {APART}), dw AS ({warped_sql('pr')})"


@query("dtw_knn", f"{every_window(WARPED_KNN)} SELECT {AT}, {NBR}, round(dtw, 4) / 8 AS dist, row_number() OVER (PARTITION BY id ORDER BY dtw, nbr) AS rank FROM dw QUALIFY rank <= 3")
def dtw_knn(spark, d):
    """Nearest windows by warping distance. Exact: a pair is left unmeasured only if its lower bound passes the query's third best."""
    return window_knn(frames(spark, d), metric="dtw", every=1).select(*_at(), *_nbr(), (F.round(F.col("dist") * SIZE, 4) / SIZE).alias("dist"), "rank")


@query("descriptor_knn")
def descriptor_knn(spark, d, k: int = 5):
    """Approximate neighbours: an index on descriptors (means of four segments), then warping distances in the 36 of 64 cells visited."""
    w = windows(frames(spark, d))
    return indexed(asked(w), w, k, by="ssd", parts=4, probes=36, more=0, apart=SIZE).select(*_at(), *_nbr(), "dist", "rank")


@query("attractor_knn")
def attractor_knn(spark, d, k: int = 5):
    """Approximate neighbours: windows belong to the attractor nearest by warping distance."""
    w = windows(frames(spark, d))
    return indexed(w, w, k, n_pivots=32, probes=14, by="dtw", apart=SIZE).select(*_at(), *_nbr(), "dist", "rank")


@query("motif_mean_error", f"WITH {MARKUP}, e AS (SELECT m.tag, f.t - m.start AS o, unnest([0, 1]) AS dim, unnest([f.x, f.h]) AS x FROM mk m JOIN fr f ON f.series_id = m.series_id AND f.t >= m.start AND f.t < m.stop), c AS (SELECT tag, o, dim, avg(x) AS m, var_pop(x) AS v, count(*) AS n FROM e GROUP BY ALL) SELECT tag, round(sum(v * n) / sum(n), 5) AS dl FROM c GROUP BY tag")
def motif_mean_error(spark, d):
    """The mean squared error of occurrences to their motif's mean, over all offsets and dimensions."""
    rows = frames(spark, d)
    by = Window.partitionBy("series_id", "tag").orderBy("t")
    e = rows.withColumn("g", F.col("t") - F.row_number().over(by))
    o = F.row_number().over(Window.partitionBy("series_id", "tag", "g").orderBy("t"))
    long = e.select("tag", o.alias("o"), F.array("x", "h").alias("v")).select("tag", "o", F.posexplode("v").alias("dim", "v"))
    c = long.groupBy("tag", "o", "dim").agg(F.var_pop("v").alias("v"), F.count("*").alias("n"))
    return c.groupBy("tag").agg(F.round(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 5).alias("dl"))


def components(edges: DataFrame) -> DataFrame:
    """node and root, by min labels that go along edges until none changes; each round is written."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        least = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("m"))
        new = labels.join(least, F.col("node") == F.col("a"), "left").select("node", F.least("root", F.coalesce("m", "root")).alias("root"), "root")
        new = new.toDF("node", "root", "was")
        jump = new.select(F.col("node").alias("j"), F.col("root").alias("up"))
        new = written(new.join(jump, F.col("root") == F.col("j"), "left").select("node", F.coalesce("up", "root").alias("root"), "was"))
        labels = new.select("node", "root")
        if not new.where("root <> was").limit(1).count():
            return labels


@query("components", f"{KNN.replace('WITH ', 'WITH RECURSIVE ', 1)}, ed AS (SELECT id AS a, nbr AS b FROM kn WHERE rank = 1), bo AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), re AS (SELECT a AS node, a AS root FROM bo UNION SELECT bo.b, re.root FROM re JOIN bo ON bo.a = re.node) SELECT node, min(root) AS root FROM re GROUP BY node")
def component_labels(spark, d):
    """Clusters of query windows and their nearest windows that links join."""
    return components(window_knn(frames(spark, d), k=1).select(F.col("id").alias("a"), F.col("nbr").alias("b")))


def disjoint(rows: DataFrame, size: int = SIZE, k: int = 3, every: int = EVERY) -> DataFrame:
    """id, rank, nbr and dist: each query's nearest windows that overlap neither it nor each other.

    One that is taken bars 2 * size - 2 others at most, so the first (k - 1) * (2 * size - 1) + 1 neighbours hold them all.
    """
    near = window_knn(rows, size, (k - 1) * (2 * size - 1) + 1, every=every)
    none = F.array().cast("array<struct<dist:double,nbr:bigint>>")
    apart = lambda a, b: (F.floor(a.nbr / (1 << 32)) != F.floor(b.nbr / (1 << 32))) | (F.abs(a.nbr - b.nbr) >= size)
    step = lambda a, s: F.when((F.size(a) < k) & F.forall(a, lambda x: apart(x, s)), F.concat(a, F.array(s))).otherwise(a)
    s = near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("dist", "nbr"))).alias("s"))
    return s.select("id", F.posexplode(F.aggregate("s", none, step)).alias("rank", "n")).select("id", (F.col("rank") + 1).alias("rank"), "n.nbr", "n.dist")


FREE = "(x.nbr // 4294967296 <> y.nbr // 4294967296 OR abs(x.nbr - y.nbr) >= 8)"
DISJOINT = f"""{KNN.replace('rank <= 3', 'rank <= 31')}, k1 AS (SELECT * FROM kn WHERE rank = 1), k2 AS (SELECT y.* FROM k1 x JOIN kn y ON x.id = y.id AND {FREE} QUALIFY row_number() OVER (PARTITION BY y.id ORDER BY y.rank) = 1),
k3 AS (SELECT y.* FROM k1 x JOIN kn y ON x.id = y.id AND {FREE} JOIN k2 ON k2.id = y.id AND (k2.nbr // 4294967296 <> y.nbr // 4294967296 OR abs(k2.nbr - y.nbr) >= 8) QUALIFY row_number() OVER (PARTITION BY y.id ORDER BY y.rank) = 1), dj AS (SELECT 1 AS rank, id, nbr, dist FROM k1 UNION ALL SELECT 2, id, nbr, dist FROM k2 UNION ALL SELECT 3, id, nbr, dist FROM k3)"""


@query("disjoint_knn", f"{DISJOINT} SELECT {AT}, {NBR}, rank, round(dist, 5) AS dist FROM dj")
def disjoint_knn(spark, d):
    return disjoint(frames(spark, d)).select(*_at(), *_nbr(), "rank", F.round("dist", 5).alias("dist"))


def windows_of(rows: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """id and v of the windows of several lengths, all in one table."""
    out = windows(rows, sizes[0])
    for s in sizes[1:]:
        out = out.union(windows(rows, s))
    return out


#: Neighbours that are sought first where more are needed only if these overlap.
FIRST = 16


def disjoint_any(rows: DataFrame, sizes: tuple[int, ...], k: int = 3, metric: str = "dtw") -> DataFrame:
    """id, len, rank, nbr, nbr_len and dist: each query's nearest windows of any of the lengths, by warping and the longer length, which overlap neither it nor each other.

    One that is taken bars those of each length that begin less than that length before it or its own after it, so that
    with (k - 1) times as many and one more there are k.
    """
    bars = sum(max(sizes) + s - 1 for s in sizes)
    w = celled(windows_of(rows, sizes), sizes)
    none = F.array().cast("array<struct<dist:double,nbr:bigint,nbr_len:int>>")
    apart = lambda a, b: (F.floor(a.nbr / (1 << 32)) != F.floor(b.nbr / (1 << 32))) | (a.nbr + a.nbr_len <= b.nbr) | (b.nbr + b.nbr_len <= a.nbr)
    step = lambda a, s: F.when((F.size(a) < k) & F.forall(a, lambda x: apart(x, s)), F.concat(a, F.array(s))).otherwise(a)
    left, out = asked(w), None
    for most in sorted({min(FIRST, (k - 1) * bars + 1), (k - 1) * bars + 1}):  # a query that has k among its first ones is done
        near = nearest_any(left, w, most, metric, True, sizes)
        s = near.groupBy("id", "len").agg(F.sort_array(F.collect_list(F.struct("dist", "nbr", "nbr_len"))).alias("s"))
        s = checkpointed(s.select("id", "len", F.aggregate("s", none, step).alias("s"), (F.size("s") < most).alias("all")))
        done = (F.size("s") == k) | F.col("all") | F.lit(most > (k - 1) * bars)
        out = s.where(done) if out is None else out.union(s.where(done))
        left = left.withColumn("len", F.size("v")).join(s.where(~done).select("id", "len"), ["id", "len"], "left_semi").select("id", "v")
        if not s.where(~done).limit(1).count():
            break
    return out.select("id", "len", F.posexplode("s").alias("rank", "n")).select("id", "len", (F.col("rank") + 1).alias("rank"), "n.nbr", "n.nbr_len", "n.dist")


@query("mixed_length_knn")
def mixed_length_knn(spark, d, sizes: tuple[int, ...] = (6, 8, 10)):
    """Nearest windows among those of several lengths, found in one search."""
    return disjoint_any(frames(spark, d), sizes).select(*_at(), "len", *_nbr(), "nbr_len", "rank", "dist")


@query("density_curve", f"{every_window(DISJOINT)} SELECT {AT}, rank, round((rank + 1) / dist, 4) AS density FROM dj")
def density_curve(spark, d):
    """How dense a neighbourhood is at each of its disjoint members: members so far, by the distance; null at equal windows, whose distance is 0."""
    return disjoint(frames(spark, d), every=1).select(*_at(), "rank", F.round(F.try_divide(F.col("rank") + 1, "dist"), 4).alias("density"))


@query("edit_greedy", f"WITH RECURSIVE {MARKUP}, {LETTERS}, {WARPED}, {AVERAGE}, h2 AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY dist, start, len) AS r FROM ed), g AS (SELECT series_id, r, [[start, len]] AS t FROM h2 WHERE r = 1 UNION ALL SELECT h2.series_id, h2.r, CASE WHEN len(list_filter(g.t, lambda x: h2.start < x[1] + x[2] AND x[1] < h2.start + h2.len)) = 0 THEN list_append(g.t, [h2.start, h2.len]) ELSE g.t END FROM g JOIN h2 ON h2.series_id = g.series_id AND h2.r = g.r + 1), tk AS (SELECT series_id, unnest(arg_max(t, r)) AS x FROM g GROUP BY series_id) SELECT series_id, x[1]::INT AS start, x[2]::INT AS len FROM tk")
def edit_greedy(spark, d):
    """Occurrences of a pattern by edit distance, the nearest first, that do not overlap."""
    none = F.array().cast("array<struct<dist:bigint,start:int,len:int>>")
    free = lambda a, s: F.forall(a, lambda x: (s.start >= x.start + x.len) | (x.start >= s.start + s.len))
    step = lambda a, s: F.when(free(a, s), F.concat(a, F.array(s))).otherwise(a)
    hits = scored(frames(spark, d)).groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("dist", "start", "len"))).alias("s"))
    return hits.select("series_id", F.explode(F.aggregate("s", none, step)).alias("n")).select("series_id", "n.start", "n.len")


class FreeSpans:
    """Spans of free frames (first, last), disjoint and in order, from which ranges are taken."""

    def __init__(self, spans):
        self.first, self.last = [a for a, _ in spans], [b for _, b in spans]

    def take(self, a: int, b: int) -> bool:
        """Whether the frames a to b are all free; if so they are so no more."""
        i = bisect_right(self.first, a) - 1
        if i < 0 or b > self.last[i]:
            return False
        rest = [(x, y) for x, y in ((self.first[i], a - 1), (b + 1, self.last[i])) if x <= y]
        self.first[i : i + 1], self.last[i : i + 1] = [x for x, _ in rest], [y for _, y in rest]
        return True


def greedy_in_free(hits: DataFrame, free: DataFrame) -> DataFrame:
    """series_id, start and len of hits (series_id, start, len, dist), the nearest first, that lie whole in what is still free of spans (series_id, a, b); ties by start and length."""

    def each(h: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        h, left = h.sort_values(["dist", "start", "len"]), FreeSpans(sorted(zip(f["a"], f["b"])))
        return h[pd.Series([left.take(a, a + n - 1) for a, n in zip(h["start"], h["len"])], h.index, bool)][["series_id", "start", "len"]]

    hits = hits.select("series_id", F.col("start").cast("int").alias("start"), F.col("len").cast("int").alias("len"), "dist")
    return hits.groupBy("series_id").cogroup(free.select(F.col("series_id").alias("s"), "a", "b").groupBy("s")).applyInPandas(each, "series_id long, start int, len int")


@query("edit_greedy_free", f"WITH RECURSIVE {MARKUP}, {LETTERS}, {WARPED}, {AVERAGE}, ef AS (SELECT * FROM ed WHERE NOT EXISTS (SELECT 1 FROM mk WHERE mk.series_id = ed.series_id AND mk.tag = 'signup' AND mk.start < ed.start + ed.len AND ed.start < mk.stop)), h2 AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY dist, start, len) AS r FROM ef), g AS (SELECT series_id, r, [[start, len]] AS t FROM h2 WHERE r = 1 UNION ALL SELECT h2.series_id, h2.r, CASE WHEN len(list_filter(g.t, lambda x: h2.start < x[1] + x[2] AND x[1] < h2.start + h2.len)) = 0 THEN list_append(g.t, [h2.start, h2.len]) ELSE g.t END FROM g JOIN h2 ON h2.series_id = g.series_id AND h2.r = g.r + 1), tk AS (SELECT series_id, unnest(arg_max(t, r)) AS x FROM g GROUP BY series_id) SELECT series_id, x[1]::INT AS start, x[2]::INT AS len FROM tk")
def edit_greedy_free(spark, d):
    """Occurrences of a pattern by edit distance, the nearest first, in frames that are still free, at first all but those of one label."""
    rows = frames(spark, d)
    return greedy_in_free(scored(rows), complement(of_tag(runs(rows), "signup"), whole(rows)))


@query("seed_dl", f"{SEEDS}, fa AS (SELECT series_id, start, max(dist) AS far FROM di GROUP BY ALL HAVING max(dist) < 130) SELECT count(*) AS n, round(avg(far) / 8, 5) AS dl FROM fa")
def seed_dl(spark, d, radius: float = 130.0):
    """The mean of occurrences' larger distance to two seeds, by length."""
    rows = frames(spark, d)
    far = to_seeds(rows, closest(rows)).where(F.col("far") < radius)
    return far.agg(F.count("*").alias("n"), F.round(F.avg("far") / SIZE, 5).alias("dl"))


def _knn_sql(size: int, n: str) -> str:
    return f"""w{n} AS (SELECT series_id, start, series_id * 4294967296 + start AS id, xs FROM (SELECT series_id, t AS start, list(x) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING) AS xs FROM fr) WHERE len(xs) = {size}),
d{n} AS (SELECT id, round(dist / {size}, 6) AS dist FROM (SELECT a.id, b.id AS nbr, sqrt(list_sum([(a.xs[i] - b.xs[i]) * (a.xs[i] - b.xs[i]) FOR i IN range(1, {size + 1})])) AS dist FROM w{n} a JOIN w{n} b ON a.id % 50 = 0 AND (a.series_id <> b.series_id OR abs(a.start - b.start) >= {size})) QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, nbr) = 3)"""


@query("length_winner", f"WITH {FRAMES}, {_knn_sql(8, '8')}, {_knn_sql(12, '12')}, g AS (SELECT id, s.dist AS short, l.dist AS long FROM d12 l JOIN d8 s USING (id)) SELECT {AT}, CASE WHEN long <= short THEN 1 WHEN (long - short) / short < 0.1 THEN 2 WHEN (long - short) / short > 0.5 THEN 4 ELSE 5 END AS rule, CASE WHEN long <= short OR (long - short) / short < 0.1 THEN 12 ELSE 8 END AS len FROM g")
def length_winner(spark, d):
    """Of two seeds at one place, which stays: the longer if it is as dense, or nearly; else the denser."""
    rows = frames(spark, d)
    dk = lambda size: window_knn(rows, size).where("rank = 3").select("id", F.round(F.col("dist") / size, 6).alias(f"d{size}"))
    g = dk(8).join(dk(12), "id")
    gap = F.coalesce(F.try_divide(F.col("d12") - F.col("d8"), "d8"), F.lit(float("inf")))
    rule = F.when(F.col("d12") <= F.col("d8"), 1).when(gap < 0.1, 2).when(gap > 0.5, 4).otherwise(5)
    return g.select(*_at(), rule.alias("rule"), F.when(rule <= 2, 12).otherwise(8).alias("len"))
