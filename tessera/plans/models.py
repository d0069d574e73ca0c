"""Models of labelled classes, decoding of series by them, re-estimation and scores.

A model is a small table: a row for each state and dimension. Statistics come from groupings over all frames; only
decoding is by a function of one whole series, to which the models are sent. Their number is that of the classes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.catalog import FRAMES, MARKUP, query
from tessera.functions import hmm
from tessera.functions.vectors import squared_distance
from tessera.operators.stats import event_scores, frame_confusion, matched  # noqa: F401
from tessera.plans.rounds import checkpointed, written
from tessera.sources.frames import frames, load, markup

STATES = 2
FLOOR = 1e-3
CLASSES_AT_MOST = 10_000


def bounded(rows: DataFrame, most: int) -> list:
    """All rows, of which there are `most` at most; more are an error, as a part of them would give wrong results."""
    out = rows.limit(most + 1).collect()
    if len(out) > most:
        raise ValueError(f"over {most} rows of classes or pairs of classes")
    return out


def examples(rows: DataFrame) -> DataFrame:
    """Frames of runs of equal tags: series_id, tag, start, t, x, h, and o, n, the place in the run and its length."""
    by = Window.partitionBy("series_id", "tag").orderBy("t")
    cut = rows.withColumn("g", F.col("t") - F.row_number().over(by))
    run = Window.partitionBy("series_id", "tag", "g")
    return cut.withColumn("start", F.min("t").over(run)).withColumn("n", F.count("*").over(run)).withColumn("o", F.col("t") - F.col("start")).drop("g")


def class_models(e: DataFrame, states: int = STATES) -> DataFrame:
    """tag, state, dim, mean, var, n: examples are cut into even segments, one a state."""
    s = e.withColumn("state", F.floor(F.col("o") * states / F.col("n")).cast("int"))
    long = s.select("tag", "state", F.posexplode(F.array("x", "h")).alias("dim", "v"))
    return long.groupBy("tag", "state", "dim").agg(F.avg("v").alias("mean"), F.greatest(F.var_pop("v"), F.lit(FLOOR)).alias("var"), F.count("*").alias("n"))


STATE_SQL = f"WITH {MARKUP}, e AS (SELECT m.tag, floor((f.t - m.start) * 2 / (m.stop - m.start))::INT AS state, unnest([0, 1]) AS dim, unnest([f.x, f.h]) AS v FROM mk m JOIN fr f ON f.series_id = m.series_id AND f.t >= m.start AND f.t < m.stop) SELECT tag, state, dim, round(avg(v), 5) AS mean, round(greatest(var_pop(v), 1e-3), 5) AS var, count(*) AS n FROM e GROUP BY ALL"


@query("class_hmm_states", STATE_SQL)
def class_hmm_states(spark, d):
    m = class_models(examples(frames(spark, d)))
    return m.select("tag", "state", "dim", F.round("mean", 5).alias("mean"), F.round("var", 5).alias("var"), "n")


def built(models: DataFrame, e: DataFrame, states: int = STATES) -> tuple[list[str], list[hmm.Hmm]]:
    """The models of classes as objects: left-right, with stays from mean lengths; a class for each, so a small collect."""
    rows = bounded(models, CLASSES_AT_MOST * states * 2)
    dwell = {r["tag"]: r["m"] for r in e.where("o = 0").groupBy("tag").agg(F.avg("n").alias("m")).collect()}
    names = sorted({r["tag"] for r in rows})
    out = []
    for name in names:
        own = {(r["state"], r["dim"]): r for r in rows if r["tag"] == name}
        used = sorted({s for s, _ in own})
        mean = np.array([[own[s, k]["mean"] for k in range(2)] for s in used])
        var = np.array([[own[s, k]["var"] for k in range(2)] for s in used])
        n, stay = len(used), max(0.05, 1 - len(used) / max(dwell[name], len(used) * 1.05))
        trans, start, leave = np.full((n, n), -np.inf), np.full(n, -np.inf), np.full(n, -np.inf)
        for s in range(n):
            trans[s, s] = np.log(stay)
            if s + 1 < n:
                trans[s, s + 1] = np.log(1 - stay)
        start[0], leave[-1] = 0.0, np.log(1 - stay)
        out.append(hmm.Hmm(mean, var, trans, start, leave))
    return names, out


def whole_series(rows: DataFrame) -> DataFrame:
    """series_id, t and v: the frames (x, h) of each series in one row. A series, not the table, is what one row holds."""
    pairs = F.sort_array(F.collect_list(F.struct("t", F.array("x", "h").alias("v"))))
    return rows.groupBy("series_id").agg(pairs.alias("p")).select("series_id", F.transform("p", lambda p: p.t).alias("t"), F.transform("p", lambda p: p.v).alias("v"))


def _arrays(column: pd.Series) -> list[np.ndarray]:
    return [np.stack(list(v)).astype(float) for v in column]


#: Frames of a block in which a series is decoded.
BLOCK_FRAMES = 4096
#: Rows (blocks, series or examples) that a task works on together.
CHUNK_ROWS = 1024


def blocks(rows: DataFrame, size: int, columns: tuple[str, ...] = ("x", "h")) -> DataFrame:
    """series_id, block, t, the columns, first and only: the frames of each stretch of `size` of a series in one row; whether it is its series' first, and the only one."""
    by = rows.groupBy("series_id", F.floor(F.col("t") / size).alias("block"))
    out = by.agg(F.sort_array(F.collect_list(F.struct("t", *columns))).alias("p")).select("series_id", "block", *[F.col(f"p.{c}").alias(c) for c in ("t", *columns)])
    start = out.groupBy("series_id").agg(F.min("block").alias("least"), F.count("*").alias("many"))
    return out.join(start, "series_id").select("series_id", "block", "t", *columns, (F.col("block") == F.col("least")).alias("first"), (F.col("many") == 1).alias("only"))


def _frames(g: pd.DataFrame, columns: tuple[str, ...] = ("x", "h")) -> list[np.ndarray]:
    return [np.column_stack(v).astype(float) for v in zip(*[g[c] for c in columns])]


def aligned(rows: DataFrame, joint: hmm.Hmm | hmm.Discrete, size: int, columns: tuple[str, ...] = ("x", "h")) -> DataFrame:
    """Blocks with the best joint path's state before and at the end of each (enters, -1 at a series' first; ends), the scores of all states before it, and ll, the path's log likelihood.

    A block gives a matrix of best scores between states; a series' matrices are composed in order, so what one task has of a
    series is a matrix a block. A series of one block is composed where its matrix is made.
    """
    shared = rows.sparkSession.sparkContext.broadcast(joint)
    own = checkpointed(blocks(rows, size, columns))

    def multiply(batches):
        for g in batches:
            for k in range(0, len(g), CHUNK_ROWS):
                some = g.iloc[k : k + CHUNK_ROWS]
                m, only = hmm.block_products(shared.value, _frames(some, columns), some["first"].tolist()), some["only"].tolist()
                done = [(o, [], -1, int(x.argmax()), float(x.max())) if o else (o, x.ravel(), None, None, None) for x, o in zip(m, only)]
                made = pd.DataFrame(done, columns=["only", "m", "enters", "ends", "ll"], index=some.index).astype({"enters": "Int32", "ends": "Int32"})
                yield pd.concat([some[["series_id", "block"]], made], axis=1)

    def compose(g: pd.DataFrame) -> pd.DataFrame:
        g, k = g.sort_values("block"), len(shared.value.start)
        m = [np.asarray(x) for x in g["m"]]
        before, enters, ends, ll = hmm.composed([m[0], *[x.reshape(k, k) for x in m[1:]]])
        return pd.DataFrame({"series_id": g["series_id"], "block": g["block"], "before": before, "enters": enters, "ends": ends, "ll": ll})

    met = checkpointed(own.mapInPandas(multiply, "series_id long, block long, only boolean, m array<double>, enters int, ends int, ll double"))
    alone = met.where("only").select("series_id", "block", F.col("m").alias("before"), "enters", "ends", "ll")
    met = met.where("not only").select("series_id", "block", "m").groupBy("series_id").applyInPandas(compose, "series_id long, block long, before array<double>, enters int, ends int, ll double")
    return own.drop("only").join(alone.union(met), ["series_id", "block"])


def decode(rows: DataFrame, names: list[str], models: list[hmm.Hmm] | list[hmm.Discrete], size: int = BLOCK_FRAMES, columns: tuple[str, ...] = ("x", "h")) -> DataFrame:
    """series_id, tag, start, stop and ll: the best joint path of all models through each series, in blocks of `size` frames, so that one long series is decoded by many tasks. Without models there are no segments."""
    if not models:
        return rows.sparkSession.createDataFrame([], "series_id long, tag string, start int, stop int, ll double")
    joint, owner = hmm.join(models)
    first = np.concatenate([np.arange(len(m.start)) == 0 for m in models])
    shared = rows.sparkSession.sparkContext.broadcast((joint, owner, first, names))

    def each(batches):
        joint, owner, first, names = shared.value
        for g in (g.iloc[k : k + CHUNK_ROWS] for g in batches for k in range(0, len(g), CHUNK_ROWS)):
            out = []
            paths = hmm.viterbi_within_many(joint, _frames(g, columns), [np.asarray(b) for b in g["before"]], g["ends"].tolist())
            for series, block, t, path, enters, ll in zip(g["series_id"], g["block"], g["t"], paths, g["enters"], g["ll"]):
                last = np.concatenate([[enters], path[:-1]])
                new = (owner[path] != owner[last]) | (first[path] & (path < last)) | (last < 0)
                at = np.flatnonzero(new)
                out += [(series, block, names[owner[path[a]]], int(t[a]), int(t[b]) if b is not None else None, int(t[-1]) + 1, ll) for a, b in zip(at, [*at[1:], None])]
                if not len(at):  # a run goes on through the whole block
                    out.append((series, block, None, None, None, int(t[-1]) + 1, ll))
            yield pd.DataFrame(out, columns=["series_id", "block", "tag", "start", "stop", "until", "ll"]).astype({"start": "Int32", "stop": "Int32"})

    runs_ = checkpointed(aligned(rows, joint, size, columns).mapInPandas(each, "series_id long, block long, tag string, start int, stop int, until int, ll double"))
    after = Window.partitionBy("series_id").orderBy("block").rowsBetween(1, Window.unboundedFollowing)  # a row a block
    per = runs_.groupBy("series_id", "block").agg(F.min("start").alias("s"), F.max("until").alias("until"))
    per = per.select("series_id", "block", F.coalesce(F.first("s", True).over(after), F.max("until").over(Window.partitionBy("series_id"))).alias("next"))
    return runs_.where("start is not null").join(per, ["series_id", "block"]).select("series_id", "tag", "start", F.coalesce("stop", "next").cast("int").alias("stop"), "ll")


@query("hmm_decode")
def hmm_decode(spark, d):
    """Segments of every series by the models of all classes."""
    rows = frames(spark, d)
    e = examples(rows)
    return decode(rows, *built(class_models(e), e))


@query("state_distributions")
def state_distributions(spark, d):
    """What falls in each state of each class once every series is aligned with all models: frames, and mean and variance of each dimension."""
    rows = frames(spark, d)
    e = examples(rows)
    names, models = built(class_models(e), e)
    joint, owner = hmm.join(models)
    begin = np.concatenate([[0], np.cumsum([len(m.mean) for m in models])])
    shared = spark.sparkContext.broadcast((joint, owner, begin, names))

    def each(batches):
        joint, owner, begin, names = shared.value
        for g in batches:
            xs = _arrays(g["v"])
            for x, path in zip(xs, hmm.viterbi_many(joint, xs)[0]):
                m = owner[path]
                yield pd.DataFrame({"tag": [names[i] for i in m], "state": path - begin[m], "x": x[:, 0], "h": x[:, 1]})

    long = whole_series(rows).mapInPandas(each, "tag string, state int, x double, h double").select("tag", "state", F.posexplode(F.array("x", "h")).alias("dim", "v"))
    return long.groupBy("tag", "state", "dim").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"))


@dataclass
class Gaussian:
    """A probability model of frames: any class with `fit` and `log_likelihood` can take its place."""

    mean: list[float]
    var: list[float]

    @classmethod
    def fit(cls, rows: DataFrame) -> Gaussian:
        got = rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.greatest(F.var_pop("x"), F.lit(FLOOR)).alias("s")).orderBy("i").collect()
        return cls([r["m"] for r in got], [r["s"] for r in got])

    def log_likelihood(self, v: str) -> Column:
        terms = [-0.5 * (F.lit(float(np.log(2 * np.pi * s))) + (F.get(v, F.lit(i)) - m) * (F.get(v, F.lit(i)) - m) / s) for i, (m, s) in enumerate(zip(self.mean, self.var))]
        return sum(terms[1:], terms[0])


@dataclass
class Mixture:
    parts: list[tuple[float, Gaussian]]

    @classmethod
    def fit(cls, rows: DataFrame, k: int = 2) -> Mixture:
        return cls([(w, Gaussian(mean, var)) for w, mean, var in mixture_fit(rows, k, restarts=1, rounds=6)[1]])

    def log_likelihood(self, v: str) -> Column:
        logs = F.array(*[F.lit(float(np.log(w))) + g.log_likelihood(v) for w, g in self.parts])
        top = F.array_max(logs)
        return top + F.ln(F.aggregate(logs, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def _weighed(parts: str) -> Column:
    """The logarithm of weight and density of v in each component of an array of (w, mean, var)."""
    one = lambda x, m, z: -0.5 * (F.ln(2 * F.pi() * z) + (x - m) * (x - m) / z)
    density = lambda p: F.aggregate(F.zip_with(F.arrays_zip("v", p["mean"].alias("m")), p["var"], lambda a, z: one(a["v"], a["m"], z)), F.lit(0.0), lambda a, x: a + x)
    return F.transform(parts, lambda p: F.ln(p["w"]) + density(p))


def _total(logs: str) -> Column:
    top = F.array_max(logs)
    return top + F.ln(F.aggregate(logs, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def mixtures(rows: DataFrame, k: int, rounds: int = 5) -> DataFrame:
    """tag and parts, an array of (w, mean, var): a mixture of k Gaussians for each class of frames (tag, v), all classes at the same time.

    It begins with the k different frames of each class whose hashes are least; each round is one grouping by class,
    component and dimension. A component that has no share of any frame goes.
    """
    order = Window.partitionBy("tag").orderBy(F.xxhash64("v"), "v")
    first = rows.select("tag", "v").distinct().withColumn("c", F.row_number().over(order) - 1).where(F.col("c") < k)
    spread = rows.select("tag", F.posexplode("v").alias("i", "x")).groupBy("tag", "i").agg(F.greatest(F.var_pop("x"), F.lit(FLOOR)).alias("z"))
    spread = spread.groupBy("tag").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "z"))), lambda p: p["z"]).alias("var"))
    size = Window.partitionBy("tag")
    parts = first.join(spread, "tag").select("tag", "c", F.struct((1 / F.count("*").over(size)).alias("w"), F.col("v").alias("mean"), "var").alias("p"))
    gather = lambda df: written(df.groupBy("tag").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "p"))), lambda x: x["p"]).alias("parts")))
    parts = gather(parts)
    for _ in range(rounds):
        met = rows.join(parts, "tag").withColumn("logs", _weighed("parts")).withColumn("total", _total("logs"))
        long = met.select("tag", "v", F.posexplode(F.transform("logs", lambda x: F.exp(x - F.col("total")))).alias("c", "share")).select("tag", "c", "share", F.posexplode("v").alias("i", "x"))
        g = long.groupBy("tag", "c", "i").agg(F.sum("share").alias("n"), F.sum(F.col("share") * F.col("x")).alias("s"), F.sum(F.col("share") * F.col("x") * F.col("x")).alias("q")).where("n > 1e-9")
        mean = F.col("s") / F.col("n")
        g = g.select("tag", "c", "n", F.struct("i", mean.alias("m"), F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(FLOOR)).alias("z")).alias("d"))
        g = g.groupBy("tag", "c").agg(F.first("n").alias("n"), F.sort_array(F.collect_list("d")).alias("d"))
        parts = gather(g.select("tag", "c", F.struct((F.col("n") / F.sum("n").over(size)).alias("w"), F.col("d.m").alias("mean"), F.col("d.z").alias("var")).alias("p")))
    return parts


def model_scores(rows: DataFrame, k: int) -> DataFrame:
    """tag, n and ll: the mean log-likelihood of each class's frames (tag, v) under its own mixture of k Gaussians; k = 1 is one Gaussian."""
    met = rows.join(mixtures(rows, k, 5 if k > 1 else 1), "tag").withColumn("logs", _weighed("parts"))
    return met.groupBy("tag").agg(F.count("*").alias("n"), F.round(F.avg(_total("logs")), 6).alias("ll"))


@query("gaussian_scores", f"WITH {FRAMES}, g AS (SELECT tag, avg(x) AS mx, greatest(var_pop(x), 1e-3) AS vx, avg(h) AS mh, greatest(var_pop(h), 1e-3) AS vh FROM fr GROUP BY tag) SELECT tag, count(*) AS n, round(avg(-0.5 * (ln(2 * pi() * vx) + (x - mx) * (x - mx) / vx) - 0.5 * (ln(2 * pi() * vh) + (h - mh) * (h - mh) / vh)), 6) AS ll FROM fr JOIN g USING (tag) GROUP BY tag")
def gaussian_scores(spark, d):
    return model_scores(checkpointed(frames(spark, d).select("tag", F.array("x", "h").alias("v"))), 1)


@query("mixture_scores")
def mixture_scores(spark, d):
    return model_scores(checkpointed(frames(spark, d).select("tag", F.array("x", "h").alias("v"))), 2)


@query("hmm_spot_scores")
def hmm_spot_scores(spark, d):
    """Overlap in frames of decoded classes with labels."""
    found = hmm_decode(spark, d).drop("ll")
    return matched(markup(spark, d), found).groupBy("truth", "found").agg(F.sum(F.least("a2", "b2") - F.greatest("a1", "b1")).alias("frames"))


@query("best_label_mapping")
def best_label_mapping(spark, d):
    """The one-to-one naming of decoded classes that agrees with most frames."""
    m = bounded(hmm_spot_scores(spark, d), CLASSES_AT_MOST)  # pairs of classes
    truth, found = sorted({r["truth"] for r in m}), sorted({r["found"] for r in m})
    gain = np.zeros((len(truth), max(len(truth), len(found))))
    for r in m:
        gain[truth.index(r["truth"]), found.index(r["found"])] = r["frames"]
    rows = [(truth[i], found[j] if j < len(found) else None, int(gain[i, j])) for i, j in enumerate(hmm.assignment(gain))]
    return spark.createDataFrame(rows, "truth string, found string, frames long").coalesce(1)


def supervised_models(e: DataFrame) -> DataFrame:
    """Class models with 2 * (shortest run) - 1 states each."""
    least = e.where("o = 0").groupBy("tag").agg((2 * F.min("n") - 1).alias("states"))
    s = e.join(F.broadcast(least), "tag").withColumn("state", F.floor(F.col("o") * F.col("states") / F.col("n")).cast("int"))  # a row a class
    long = s.select("tag", "state", F.posexplode(F.array("x", "h")).alias("dim", "v"))
    return long.groupBy("tag", "state", "dim").agg(F.avg("v").alias("mean"), F.greatest(F.var_pop("v"), F.lit(FLOOR)).alias("var"), F.count("*").alias("n"))


@query("supervised_hmm_events")
def supervised_hmm_events(spark, d):
    """Correct events of each class: decoded segments that share half of the shorter of them and a label of the class."""
    rows, labels = frames(spark, d), markup(spark, d)
    e = examples(rows)
    found = decode(rows, *built(supervised_models(e), e)).drop("ll")
    same = matched(labels, found).where("truth = found and 2 * (least(a2, b2) - greatest(a1, b1)) >= least(a2 - a1, b2 - b1)")
    hits = same.select(F.col("truth").alias("tag"), "series_id", "a1").distinct().groupBy("tag").agg(F.count("*").alias("correct"))
    out = labels.groupBy("tag").agg(F.count("*").alias("labels")).join(hits, "tag", "left").fillna(0, ["correct"])
    return out.withColumn("recall", F.round(F.col("correct") / F.col("labels"), 6))


def example_scores(spark, d) -> tuple[DataFrame, DataFrame]:
    """Decoded segments with z, the log-likelihood by frame under their class's Gaussians against the distribution of this over its labelled examples."""
    rows = frames(spark, d)
    e = examples(rows)
    m = class_models(e, 1).select("tag", "dim", "mean", "var")

    def scored(r: DataFrame) -> DataFrame:
        long = r.select("series_id", "tag", "start", "t", F.posexplode(F.array("x", "h")).alias("dim", "v")).join(F.broadcast(m), ["tag", "dim"])
        one = -0.5 * (F.ln(2 * F.pi() * F.col("var")) + (F.col("v") - F.col("mean")) * (F.col("v") - F.col("mean")) / F.col("var"))
        return long.groupBy("series_id", "tag", "start").agg((F.sum(one) / F.countDistinct("t")).alias("s"))

    own = scored(e).groupBy("tag").agg(F.avg("s").alias("m"), F.stddev_samp("s").alias("sd"))
    found = checkpointed(decode(rows, *built(class_models(e), e)))
    at = rows.join(found.select("series_id", F.col("tag").alias("found"), "start", "stop"), "series_id").where("t >= start and t < stop")
    z = scored(at.select("series_id", F.col("found").alias("tag"), "start", "t", "x", "h")).join(F.broadcast(own), "tag")
    return found, z.select("series_id", "tag", "start", F.try_divide(F.col("s") - F.col("m"), "sd").alias("z"))


@query("rescored_spots")
def rescored_spots(spark, d, least: float = -2.0):
    """Decoded segments that are not much less likely under their class than its own examples are."""
    found, z = example_scores(spark, d)
    return found.join(z, ["series_id", "tag", "start"]).where(F.col("z") >= least).select("series_id", "tag", "start", "stop", "z")


def expectations(rows: DataFrame, joint: hmm.Hmm) -> list:
    """Expected counts, sums and squares of each state and dimension (kind 0), and of moves between states (kind 1), over all series: a row for each."""
    shared = rows.sparkSession.sparkContext.broadcast(joint)

    def expect(batches):
        for g in batches:
            n, s, q, moves = 0.0, 0.0, 0.0, 0.0
            for k in range(0, len(g), CHUNK_ROWS):
                xs = _arrays(g["v"].iloc[k : k + CHUNK_ROWS])
                for x, (p, m, _) in zip(xs, hmm.forward_backward_many(shared.value, xs)):
                    n, s, q, moves = n + p.sum(0), s + p.T @ x, q + p.T @ (x * x), moves + m
            if not len(g):
                continue
            k, dims = s.shape
            i, j = np.nonzero(moves > 0)
            yield pd.concat([pd.DataFrame({"kind": 0, "i": np.repeat(np.arange(k), dims), "j": np.tile(np.arange(dims), k), "n": np.repeat(n, dims), "s": s.ravel(), "q": q.ravel()}), pd.DataFrame({"kind": 1, "i": i, "j": j, "n": moves[i, j], "s": 0.0, "q": 0.0})])

    got = whole_series(rows).mapInPandas(expect, "kind int, i int, j int, n double, s double, q double")
    return got.groupBy("kind", "i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect()


def reestimated(models: list[hmm.Hmm], counts: list) -> list[hmm.Hmm]:
    """Models with means, variances, transitions and chances to leave by expected counts."""
    total, at, out = sum(len(m.mean) for m in models), 0, []
    moves = np.zeros((total, total))
    by = {(r["i"], r["j"]): r for r in counts if r["kind"] == 0}
    for r in counts:
        if r["kind"] == 1:
            moves[r["i"], r["j"]] = r["n"]
    for m in models:
        k, dims = m.mean.shape
        n = np.array([[by[at + s, j]["n"] for j in range(dims)] for s in range(k)])
        mean = np.array([[by[at + s, j]["s"] for j in range(dims)] for s in range(k)]) / np.maximum(n, 1e-9)
        var = np.maximum(np.array([[by[at + s, j]["q"] for j in range(dims)] for s in range(k)]) / np.maximum(n, 1e-9) - mean**2, FLOOR)
        own, every = moves[at : at + k, at : at + k], moves[at : at + k].sum(1)
        again = np.exp(m.leave)[:, None] * np.exp(m.start) / max(len(models), 1)  # moves within may also be an exit and a new entry
        own = own * np.exp(m.trans) / np.maximum(np.exp(m.trans) + again, 1e-12)
        with np.errstate(divide="ignore", invalid="ignore"):
            trans = np.where(every[:, None] > 1e-9, np.log(own / every[:, None]), m.trans)
            leave = np.where((every > 1e-9) & np.isfinite(m.leave), np.log(np.maximum(1 - own.sum(1) / every, 1e-6)), m.leave)
        out.append(hmm.Hmm(mean, var, trans, m.start, leave))
        at += k
    return out


@query("em_segmentation")
def em_segmentation(spark, d, rounds: int = 3):
    """Expectation-maximisation of a joint model: each series gives expected counts, which groupings sum; then segments."""
    rows = checkpointed(frames(spark, d))
    e = examples(rows)
    names, models = built(class_models(e), e)
    for _ in range(rounds):
        models = reestimated(models, expectations(rows, hmm.join(models)[0]))
    return decode(rows, names, models)


def likelihoods_beside(series: DataFrame, base: list[hmm.Hmm], tried: list[hmm.Hmm]) -> DataFrame:
    """model (its place) and ll: the log likelihood of all whole series' best paths by `base` and each of the models tried, joined."""
    shared = series.sparkSession.sparkContext.broadcast((base, tried))

    def score(batches):
        for g in batches:
            for k in range(0, len(g), CHUNK_ROWS):
                yield pd.DataFrame({"model": range(len(shared.value[1])), "ll": hmm.best_totals(*shared.value, _arrays(g["v"].iloc[k : k + CHUNK_ROWS]))})

    return series.mapInPandas(score, "model int, ll double").groupBy("model").agg(F.sum("ll").alias("ll"))


def likelihoods(rows: DataFrame, sets: list[list[hmm.Hmm]], names: list[int]) -> DataFrame:
    """model and ll: the log likelihood of all series' best paths by each set of models, joined."""
    shared = rows.sparkSession.sparkContext.broadcast([hmm.join(s)[0] for s in sets])

    def score(batches):
        for g in batches:
            for k in range(0, len(g), CHUNK_ROWS):
                xs = _arrays(g["v"].iloc[k : k + CHUNK_ROWS])
                yield pd.DataFrame({"model": names, "ll": [float(sum(s.max() for s in hmm.block_products(m, xs, [True] * len(xs)))) for m in shared.value]})

    return whole_series(rows).mapInPandas(score, "model int, ll double").groupBy("model").agg(F.sum("ll").alias("ll"))


@query("greedy_cover")
def greedy_cover(spark, d, take: int = 3):
    """Models chosen one after another, each the one that raises the total likelihood most beside a wide background."""
    rows = frames(spark, d)
    e = examples(rows)
    names, models = built(class_models(e), e)
    g = rows.agg(F.avg("x").alias("mx"), F.avg("h").alias("mh"), F.var_pop("x").alias("vx"), F.var_pop("h").alias("vh")).first()
    wide = hmm.background(np.array([g["mx"], g["mh"]]), 5 * np.array([g["vx"], g["vh"]]))
    chosen: list[int] = []
    out = []
    for place in range(min(take, len(models))):
        left, held = [i for i in range(len(models)) if i not in chosen], list(chosen)

        total = likelihoods(rows, [[wide, *[models[c] for c in held], models[i]] for i in left], left)
        best = total.orderBy(F.desc("ll"), "model").first()
        chosen.append(best["model"])
        out.append((place, names[best["model"]], float(best["ll"])))
    return spark.createDataFrame(out, "place int, tag string, ll double").coalesce(1)


def mixture_fit(rows: DataFrame, k: int, restarts: int = 3, rounds: int = 12, floor: float = FLOOR) -> tuple[float, list[tuple[float, list[float], list[float]]]]:
    """A mixture of k diagonal Gaussians over frames (v, an array): the best of several restarts, with its log likelihood.

    Each round is one grouping: every frame's shares in the components are an expression of the last round's
    parameters, and counts, sums and squares are added. A restart begins with the frames whose hashes are least.
    """
    spread = rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("s")).orderBy("i").collect()
    var = [max(floor, r["s"]) for r in spread]
    best = (-np.inf, [])
    for seed in range(restarts):
        start = rows.select("v").distinct().orderBy(F.xxhash64(F.lit(seed), "v"), "v").limit(k).collect()
        parts = [(1 / len(start), list(r["v"]), list(var)) for r in start]
        for _ in range(rounds):
            logs = [F.lit(float(np.log(w))) + sum((-0.5 * (F.lit(float(np.log(2 * np.pi * s))) + (F.get("v", F.lit(i)) - m) * (F.get("v", F.lit(i)) - m) / s) for i, (m, s) in enumerate(zip(mean, var_))), F.lit(0.0)) for w, mean, var_ in parts]
            r = rows.select("v", F.array(*logs).alias("l")).withColumn("top", F.array_max("l"))
            r = r.withColumn("total", F.col("top") + F.ln(F.aggregate("l", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))))
            sums = [F.sum("total").alias("ll"), F.count("*").alias("n")]
            for c in range(len(parts)):
                share = F.exp(F.get("l", F.lit(c)) - F.col("total"))
                sums.append(F.sum(share).alias(f"n{c}"))
                for i in range(len(var)):
                    x = F.get("v", F.lit(i))
                    sums += [F.sum(share * x).alias(f"s{c}_{i}"), F.sum(share * x * x).alias(f"q{c}_{i}")]
            got = r.agg(*sums).first()
            if got["ll"] > best[0]:
                best = (got["ll"], parts)
            new = []
            for c in range(len(parts)):
                n = max(got[f"n{c}"], 1e-9)
                mean = [got[f"s{c}_{i}"] / n for i in range(len(var))]
                new.append((max(n / got["n"], 1e-12), mean, [max(floor, got[f"q{c}_{i}"] / n - mean[i] ** 2) for i in range(len(var))]))
            parts = new
    return best


@query("gmm_background")
def gmm_background(spark, d, k: int = 3, widen: float = 5.0):
    """A mixture of Gaussians over all frames, its variances widened and floored."""
    rows = checkpointed(frames(spark, d).select(F.array("x", "h").alias("v")))
    _, parts = mixture_fit(rows, k)
    out = [(i, float(w), *map(float, mean), *[max(FLOOR, widen * s) for s in var]) for i, (w, mean, var) in enumerate(parts)]
    return spark.createDataFrame(out, "component int, weight double, mean_x double, mean_h double, var_x double, var_h double").coalesce(1)


def tree_split(rows: DataFrame, levels: int, rounds: int = 3) -> DataFrame:
    """id, v and leaf: rows split in two again and again, all nodes of a level at the same time.

    A node's two centres begin as its row farthest from its mean and the row farthest from that one, and are moved to
    their rows' means `rounds` times. A node has as many rows in the driver's view as it has centres: two.
    """
    mean = lambda df, *by: df.select(*by, F.posexplode("v").alias("i", "x")).groupBy(*by, "i").agg(F.avg("x").alias("x")).groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p.x).alias("c"))
    rows = checkpointed(rows.select("id", "v", F.lit(0).alias("leaf")))
    far = lambda a, b: F.round(squared_distance(a, b), 9)
    for _ in range(levels):
        m = mean(rows, "leaf")
        one = rows.join(F.broadcast(m), "leaf").groupBy("leaf").agg(F.max_by("v", F.struct(far(F.col("v"), F.col("c")), -F.col("id"))).alias("a"))
        pair = rows.join(F.broadcast(one), "leaf").groupBy("leaf").agg(F.first("a").alias("a"), F.max_by("v", F.struct(far(F.col("v"), F.col("a")), -F.col("id"))).alias("b"))
        pair = checkpointed(pair)
        for last in [False] * rounds + [True]:
            side = rows.join(F.broadcast(pair), "leaf").withColumn("side", (far(F.col("v"), F.col("b")) < far(F.col("v"), F.col("a"))).cast("int"))
            if last:
                rows = checkpointed(side.select("id", "v", (2 * F.col("leaf") + F.col("side")).alias("leaf")))
                break
            moved = mean(side, "leaf", "side").groupBy("leaf").agg(F.max(F.when(F.col("side") == 0, F.col("c"))).alias("na"), F.max(F.when(F.col("side") == 1, F.col("c"))).alias("nb"))
            pair = checkpointed(pair.join(moved, "leaf").select("leaf", F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b")))
    return rows


@query("tree_clusters")
def tree_clusters(spark, d, levels: int = 3):
    """Vectors split in two again and again; the leaf of each, and whether it is the leaf's prototype, the one nearest to its mean."""
    v = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = tree_split(v, levels)
    m = rows.select("leaf", F.posexplode("v").alias("i", "x")).groupBy("leaf", "i").agg(F.avg("x").alias("x")).groupBy("leaf").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p.x).alias("c"))
    best = rows.join(F.broadcast(m), "leaf").groupBy("leaf").agg(F.min_by("id", F.struct(F.round(squared_distance(F.col("v"), F.col("c")), 9), "id")).alias("best"))
    return rows.join(F.broadcast(best), "leaf").select(F.col("id").alias("vec_id"), F.col("leaf").alias("cluster"), (F.col("id") == F.col("best")).alias("prototype"))


def linked(pairs: DataFrame, how: str) -> DataFrame:
    """step, i, j and dist: merges of an agglomerative clustering from the distances of all pairs (l1 < l2, dist), clusters named by their least member.

    Pairs that are each other's nearest are merged at the same time: for complete and average linkage later merges bring
    no cluster nearer, so these merges, in order of their distances, are those of one after another. Any number of labels will do.
    """
    now, out = written(pairs.select("l1", "l2", F.col("dist").cast("double").alias("dist"), F.lit(1.0).alias("n1"), F.lit(1.0).alias("n2"))), None
    while not now.isEmpty():
        both = now.select(F.col("l1").alias("a"), F.col("l2").alias("b"), "dist").union(now.select("l2", "l1", "dist"))
        near = both.groupBy("a").agg(F.min(F.struct("dist", "b")).alias("m")).select("a", "m.b", "m.dist")
        back = near.select(F.col("a").alias("b"), F.col("b").alias("a"))
        met = written(near.where("a < b").join(back, ["a", "b"]).select(F.col("a").alias("i"), F.col("b").alias("j"), "dist"))
        out = met if out is None else out.unionByName(met)
        into = [met.select(F.col("j").alias(f"l{k}"), F.col("i").alias(f"to{k}")) for k in (1, 2)]
        moved = now.join(into[0], "l1", "left").join(into[1], "l2", "left")
        moved = moved.select(F.coalesce("to1", "l1").alias("a"), F.coalesce("to2", "l2").alias("b"), "dist", "n1", "n2", "l1", "l2").where("a <> b")
        flip = F.col("a") > F.col("b")
        moved = moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "dist", *[F.when(flip, y).otherwise(F.col(x)).alias(n) for n, x, y in (("n1", "n1", F.col("n2")), ("n2", "n2", F.col("n1")), ("l1", "l1", F.col("l2")), ("l2", "l2", F.col("l1")))])
        far = F.max("dist") if how == "complete" else F.sum(F.col("dist") * F.col("n1") * F.col("n2")) / F.sum(F.col("n1") * F.col("n2"))
        total = lambda k: F.sum(f"n{k}") / F.count_distinct(f"l{3 - k}")  # noqa: E731  each part is there once for every part of the other
        now = written(moved.groupBy("a", "b").agg(far.alias("dist"), total(1).alias("n1"), total(2).alias("n2")).select(F.col("a").alias("l1"), F.col("b").alias("l2"), "dist", "n1", "n2"))
    if out is None:
        out = pairs.select(F.col("l1").alias("i"), F.col("l2").alias("j"), F.col("dist").cast("double").alias("dist"))
    return out.withColumn("step", F.row_number().over(Window.orderBy("dist", "i", "j")) - 1).select("step", "i", "j", "dist")  # a row a label


def _merges(spark, d, how: str):
    """Merges of labels; average linkage starts from the mean squared distances of all pairs, complete linkage from the greatest distance of all vectors of two labels."""
    from tessera.operators.neighbours import group_distance, vectors
    from tessera.operators.search import pair_farthest

    if how == "average":
        found = group_distance(spark, d).select("l1", "l2", F.col("mean_ssd").alias("dist"))
    else:
        v = vectors(spark, d).where("v is not null").select(F.col("vec_id").alias("id"), "v", F.col("label").alias("g"))
        found = pair_farthest(v)
        found = found.select(F.least(*(ends := [F.col(g).cast("int") for g in ("g1", "g2")])).alias("l1"), F.greatest(*ends).alias("l2"), F.round("high", 5).alias("dist"))
    return linked(found, how)


@query("merge_groups_average")
def merge_groups_average(spark, d):
    return _merges(spark, d, "average")


@query("merge_groups_complete")
def merge_groups_complete(spark, d):
    return _merges(spark, d, "complete")


def _welch() -> tuple[Column, Column]:
    """Welch's t and its degrees of freedom from means, variances and counts of two samples; null where they have no variance or too few members."""
    a, b = F.try_divide("v0", "n0"), F.try_divide("v1", "n1")
    within = F.try_divide(a * a, F.col("n0") - 1) + F.try_divide(b * b, F.col("n1") - 1)
    return F.try_divide(F.col("m0") - F.col("m1"), F.sqrt(a + b)), F.try_divide((a + b) * (a + b), within)


@query("growth_test", f"WITH {MARKUP}, e AS (SELECT m.tag, f.x, (f.t - m.start) AS o FROM mk m JOIN fr f ON f.series_id = m.series_id AND f.t >= m.start AND f.t < m.stop), s AS (SELECT tag, avg(x) FILTER (o = 0) AS m0, var_samp(x) FILTER (o = 0) AS v0, count(*) FILTER (o = 0) AS n0, avg(x) FILTER (o > 0) AS m1, var_samp(x) FILTER (o > 0) AS v1, count(*) FILTER (o > 0) AS n1 FROM e GROUP BY tag) SELECT tag, round((m0 - m1) / sqrt(v0 / n0 + v1 / n1), 5) AS t FROM s")
def growth_test(spark, d):
    """Welch's t of the first frames of examples against the rest, from moments by one grouping."""
    e = examples(frames(spark, d))
    first, rest = F.when(F.col("o") == 0, F.col("x")), F.when(F.col("o") > 0, F.col("x"))
    s = e.groupBy("tag").agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate((first, rest)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    return s.select("tag", F.round(_welch()[0], 5).alias("t"))


@query("growth_accepted")
def growth_accepted(spark, d, level: float = 0.05):
    """Whether the first frames of examples may be grown onto the rest: Welch's t, its degrees of freedom, its one-sided chance, and the test at `level`."""
    e = examples(frames(spark, d))
    first, rest = F.when(F.col("o") == 0, F.col("x")), F.when(F.col("o") > 0, F.col("x"))
    s = e.groupBy("tag").agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate((first, rest)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    t, df = _welch()
    s = s.select("tag", t.alias("t"), df.alias("df"))

    @F.pandas_udf("double")
    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([hmm.t_tail(x, n) if np.isfinite(x) and np.isfinite(n) else None for x, n in zip(t, df)], dtype=object)

    return s.withColumn("p", tail("t", "df")).withColumn("accepted", F.col("p") >= level)


@query("state_means_scaled", f"{STATE_SQL.replace('SELECT tag, state, dim, round(avg(v), 5) AS mean, round(greatest(var_pop(v), 1e-3), 5) AS var, count(*) AS n FROM e GROUP BY ALL', 'SELECT * FROM e')}".replace("SELECT * FROM e", ", st AS (SELECT tag, state, dim, avg(v) AS mean FROM e GROUP BY ALL), lim AS (SELECT dim, min(v) AS lo, max(v) AS hi FROM e GROUP BY dim) SELECT tag, state, dim, round(least(greatest((mean - lo) / (hi - lo), 0), 1), 5) AS level FROM st JOIN lim USING (dim)"))
def state_means_scaled(spark, d):
    """State means within the global range of their dimension, clamped."""
    rows = frames(spark, d)
    lim = rows.select(F.posexplode(F.array("x", "h")).alias("dim", "v")).groupBy("dim").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    m = class_models(examples(rows)).join(lim, "dim")
    level = F.try_divide(F.col("mean") - F.col("lo"), F.col("hi") - F.col("lo"))
    level = F.when(level.isNotNull(), F.least(F.greatest(level, F.lit(0.0)), F.lit(1.0)))
    return m.select("tag", "state", "dim", F.round(level, 5).alias("level"))


@query("model_replay")
def model_replay(spark, d, rounds: int = 2):
    """Decoding and re-estimation by turns: models are built anew from the segments that the last ones decoded."""
    rows = frames(spark, d)
    e = examples(rows)
    found = decode(rows, *built(class_models(e), e))
    for _ in range(rounds):
        held = checkpointed(found).select("series_id", F.col("tag").alias("found"), F.col("start").alias("a"), F.col("stop").alias("b"))
        met = rows.select("series_id", "t", "x", "h").join(held, "series_id").where("t >= a and t < b")
        e = met.select("series_id", F.col("found").alias("tag"), "t", "x", "h", F.col("a").alias("start"), (F.col("b") - F.col("a")).alias("n"), (F.col("t") - F.col("a")).alias("o"))
        found = decode(rows, *built(class_models(e), e))
    return found
