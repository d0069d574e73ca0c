"""Word spotting: a trained model a class, of values or of symbols; how well it fits its own examples; detections that are judged by it, and classes that are renamed to agree with the labels.

Training goes over all examples of all classes at a time: tasks give the expected counts (or, by Viterbi, the counts of the
best paths) of their examples, a grouping adds them by class, and new parameters follow. The driver sees the parameters
of the models, and sums of the same number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import hmm
from tessera.functions.vectors import symbol
from tessera.operators.stats import matched
from tessera.plans.models import CHUNK_ROWS, CLASSES_AT_MOST, FLOOR, bounded, decode
from tessera.plans.rounds import checkpointed
from tessera.sources.frames import frames, markup

SYMBOLS, STATES, ROUNDS = 6, 3, 3


def quantised(rows: DataFrame, n: int = SYMBOLS) -> DataFrame:
    """rows with q, the symbol of x among n that are about as frequent if x is normal; all 0 where x does not vary."""
    m = rows.agg(F.avg("x").alias("q_m"), F.stddev_pop("x").alias("q_s"))  # one row
    z = F.coalesce(F.try_divide(F.col("x") - F.col("q_m"), "q_s"), F.lit(0.0))
    return rows.join(F.broadcast(m)).withColumn("q", symbol(z, n)).drop("q_m", "q_s")


def sequences(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """series_id, tag, start, n and the columns as arrays, for each run of equal tags."""
    by = Window.partitionBy("series_id", "tag").orderBy("t")
    cut = rows.withColumn("g", F.col("t") - F.row_number().over(by))
    own = cut.groupBy("series_id", "tag", "g").agg(F.sort_array(F.collect_list(F.struct("t", *columns))).alias("p"))
    return own.select("series_id", "tag", F.get("p.t", F.lit(0)).alias("start"), F.size("p").alias("n"), *[F.col(f"p.{c}").alias(c) for c in columns])


@dataclass
class Kind:
    """What models read (columns), and how parameters come from sums over states."""

    columns: tuple[str, ...]
    symbols: int = 0
    smooth: float = 1e-3

    def sums(self, p: np.ndarray, x: np.ndarray) -> np.ndarray:
        """(states, what is counted): of each state the frames, and sums and squares or symbols."""
        if self.symbols:
            return p.T @ np.eye(self.symbols)[x[:, 0].astype(int)]
        return np.concatenate([p.sum(0)[:, None], p.T @ x, p.T @ (x * x)], axis=1)

    def model(self, sums: np.ndarray, trans: np.ndarray, start: np.ndarray, leave: np.ndarray, last: bool) -> hmm.Hmm | hmm.Discrete:
        """last: chances of symbols are mixed with an even share `smooth`, so that no symbol is impossible."""
        if self.symbols:
            total = sums.sum(1, keepdims=True)
            p = np.where(total > 1e-12, sums / np.maximum(total, 1e-12), 1 / self.symbols)
            p = (1 - self.smooth) * p + self.smooth / self.symbols if last else p
            with np.errstate(divide="ignore"):
                return hmm.Discrete(np.log(p), trans, start, leave)
        n, d = np.maximum(sums[:, :1], 1e-9), len(self.columns)
        mean = sums[:, 1 : 1 + d] / n
        return hmm.Hmm(mean, np.maximum(sums[:, 1 + d :] / n - mean**2, FLOOR), trans, start, leave)


VALUES, LETTERS = Kind(("x", "h")), Kind(("q",), SYMBOLS)


def _arrays(g: pd.DataFrame, columns: tuple[str, ...]) -> list[np.ndarray]:
    return [np.column_stack(v).astype(float) for v in zip(*[g[c] for c in columns])]


def _by_tag(g: pd.DataFrame, columns: tuple[str, ...]) -> Iterator[tuple[str | None, pd.DataFrame, list[np.ndarray]]]:
    """The examples of each class of a batch, as rows and arrays, CHUNK_ROWS at a time at most."""
    for tag, own in g.groupby("tag", sort=False, dropna=False):
        for k in range(0, len(own), CHUNK_ROWS):
            some = own.iloc[k : k + CHUNK_ROWS]
            yield tag if isinstance(tag, str) else None, some, _arrays(some, columns)


def _counted(examples: DataFrame, kind: Kind, count) -> dict[str, dict[str, np.ndarray]]:
    """Sums over all examples of each class of what `count` gives for (tag, xs), some of them: arrays by name."""

    def each(batches):
        for g in batches:
            total: dict[tuple[str, str], np.ndarray] = {}
            for tag, _, xs in _by_tag(g, kind.columns):
                for name, a in count(tag, xs).items():
                    total[tag, name] = total[tag, name] + a if (tag, name) in total else a
            rows = [pd.DataFrame({"tag": tag, "name": name, "at": np.arange(a.size), "v": a.ravel().astype(float)}) for (tag, name), a in total.items()]
            yield pd.concat(rows) if rows else pd.DataFrame(columns=["tag", "name", "at", "v"])

    got = examples.select("tag", *kind.columns).mapInPandas(each, "tag string, name string, at int, v double")
    out: dict[str, dict[str, dict[int, float]]] = {}
    for r in got.groupBy("tag", "name", "at").agg(F.sum("v").alias("v")).collect():  # as many as parameters
        out.setdefault(r["tag"], {}).setdefault(r["name"], {})[r["at"]] = r["v"]
    return {t: {n: np.array([v[i] for i in range(len(v))]) for n, v in a.items()} for t, a in out.items()}


def train(examples: DataFrame, kind: Kind = VALUES, states: int = STATES, rounds: int = ROUNDS, how: str = "bw") -> tuple[dict[str, hmm.Hmm | hmm.Discrete], list[dict[str, float]]]:
    """A left-right model for each tag of `examples` (tag, and the kind's columns as arrays), and each class's log likelihood before every round.

    It begins with even segments, and is trained on all paths (`bw`) or on the best one (`viterbi`). A path may end in any state.
    """
    examples = checkpointed(examples)
    bounded(examples.select("tag").distinct(), CLASSES_AT_MOST)
    eye = np.eye(states)

    def even(tag: str, xs: list[np.ndarray]) -> dict[str, np.ndarray]:
        p = np.concatenate([eye[np.arange(len(x)) * states // len(x)] for x in xs])
        return {"sums": kind.sums(p, np.concatenate(xs)), "size": np.array([len(p), float(len(xs))])}

    models = {}
    for tag, c in _counted(examples, kind, even).items():
        stay = min(0.95, max(0.1, 1 - states * c["size"][1] / c["size"][0]))
        with np.errstate(divide="ignore"):
            trans = np.log(stay * eye + (1 - stay) * np.eye(states, k=1))
            trans[-1, -1] = 0.0
            start = np.log(eye[0])
        leave = np.full(states, -np.inf)
        leave[-1] = np.log(1 - stay)
        models[tag] = kind.model(c["sums"].reshape(states, -1), trans, start, leave, True)
    seen = []
    for n in range(rounds):
        shared = examples.sparkSession.sparkContext.broadcast(models)

        def expected(tag: str, xs: list[np.ndarray], shared=shared) -> dict[str, np.ndarray]:
            m, moves = shared.value[tag], np.zeros((states, states))
            if how == "viterbi":
                paths, lls = hmm.viterbi_many(m, xs)
                ps = [eye[path] for path in paths]
                for path in paths:
                    np.add.at(moves, (path[:-1], path[1:]), 1)
            else:
                ps, each, lls = zip(*hmm.forward_backward_many(m, xs))
                moves = np.sum(each, axis=0)
            return {"sums": kind.sums(np.concatenate(ps), np.concatenate(xs)), "moves": moves, "start": np.sum([p[0] for p in ps], axis=0), "ll": np.array([sum(lls)])}

        new = {}
        counts = _counted(examples, kind, expected)
        for tag, c in counts.items():
            moves, old = c["moves"].reshape(states, states), models[tag]
            with np.errstate(divide="ignore", invalid="ignore"):
                trans = np.where(moves.sum(1, keepdims=True) > 1e-12, np.log(moves / moves.sum(1, keepdims=True)), old.trans)
                start = np.log(c["start"] / c["start"].sum())
            new[tag] = kind.model(c["sums"].reshape(states, -1), trans, start, old.leave, n == rounds - 1)
        seen.append({tag: float(c["ll"][0]) for tag, c in counts.items()})
        models = new
    return models, seen


def scores(examples: DataFrame, models: dict, kind: Kind, how: str = "forward") -> DataFrame:
    """series_id, tag, start, n and score: each example's log-likelihood by frame under its own class's model, over all paths (`forward`) or the best one (`viterbi`)."""
    shared = examples.sparkSession.sparkContext.broadcast(models)

    def each(batches):
        for g in batches:
            for tag, some, xs in _by_tag(g, kind.columns):
                lls = hmm.forward_many(shared.value[tag], xs) if how == "forward" else hmm.viterbi_many(shared.value[tag], xs)[1]
                yield some[["series_id", "tag", "start", "n"]].assign(score=np.array(lls, float) / [len(x) for x in xs])

    return examples.select("series_id", "tag", "start", "n", *kind.columns).mapInPandas(each, "series_id long, tag string, start int, n int, score double")


def distribution(scored: DataFrame) -> DataFrame:
    """tag, n, mean and sd of the scores of each class's examples."""
    return scored.groupBy("tag").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"))


def spotted(rows: DataFrame, models: dict, kind: Kind, least: float | None = -2.0) -> DataFrame:
    """series_id, tag, start, stop and z: segments of the best joint path, z being how their score by their class's model stands among those of its examples; those below `least` are dropped. z is null where the examples do not vary."""
    names = sorted(models)
    found = checkpointed(decode(rows, names, [models[n] for n in names], columns=kind.columns))
    at = found.select("series_id", "tag", "start", "stop", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("t"))
    met = at.join(rows.select("series_id", "t", *kind.columns), ["series_id", "t"])
    own = met.groupBy("series_id", "tag", "start", "stop").agg(F.sort_array(F.collect_list(F.struct("t", *kind.columns))).alias("p"))
    own = own.select("series_id", "tag", "start", F.size("p").alias("n"), *[F.col(f"p.{c}").alias(c) for c in kind.columns])
    of = distribution(scores(sequences(rows, kind.columns).where(F.col("tag").isin(names)), models, kind))
    z = scores(own, models, kind).join(F.broadcast(of.drop("n")), "tag")  # a row a class
    out = z.select("series_id", "tag", "start", (F.col("start") + F.col("n")).alias("stop"), F.try_divide(F.col("score") - F.col("mean"), "sd").alias("z"))
    return out if least is None else out.where(F.coalesce(F.col("z") >= least, F.lit(True)))


def remapped(found: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Detections with their classes renamed, one to one, so that most frames agree with the labels; and the new names."""
    over = matched(labels, found).groupBy("truth", "found").agg(F.sum(F.least("a2", "b2") - F.greatest("a1", "b1")).alias("frames"))
    m = bounded(over, CLASSES_AT_MOST)  # pairs of classes
    truth, own = sorted({r["truth"] for r in m}), sorted({r["found"] for r in m})
    gain = np.zeros((len(own), max(len(truth), len(own))))
    for r in m:
        gain[own.index(r["found"]), truth.index(r["truth"])] = r["frames"]
    to = {own[i]: truth[j] for i, j in enumerate(hmm.assignment(gain)) if j < len(truth)} if own else {}
    if not to:
        return found, to
    names = F.create_map(*[F.lit(x) for kv in to.items() for x in kv])
    return found.withColumn("tag", F.coalesce(F.element_at(names, F.col("tag")), F.col("tag"))), to


def _spoken(spark, d, kind: Kind) -> tuple[DataFrame, DataFrame, dict]:
    rows = checkpointed(quantised(frames(spark, d)).select("series_id", "t", "tag", "x", "h", "q"))
    own = checkpointed(sequences(rows, kind.columns))
    return rows, own, train(own, kind)[0]


@query("discrete_hmms")
def discrete_hmms(spark, d):
    """A discrete model of each class over symbols of its values: the chance of each symbol in each state."""
    models = _spoken(spark, d, LETTERS)[2]
    out = [(tag, s, q, float(np.exp(p))) for tag, m in sorted(models.items()) for s, row in enumerate(m.symbols) for q, p in enumerate(row)]
    return spark.createDataFrame(out, "tag string, state int, symbol int, p double").coalesce(1)


@query("trained_score_distribution")
def trained_score_distribution(spark, d):
    """How the log-likelihoods by frame, over all paths of the class's trained model, spread over its own examples, for both kinds of models."""
    out = None
    for name, kind in (("values", VALUES), ("symbols", LETTERS)):
        _, own, models = _spoken(spark, d, kind)
        part = distribution(scores(own, models, kind)).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("spotted_words")
def spotted_words(spark, d, least: float = -2.0):
    """Detections by discrete models, judged by the scores of their class's examples, with classes renamed to agree with the labels."""
    rows, _, models = _spoken(spark, d, LETTERS)
    return remapped(spotted(rows, models, LETTERS, least), markup(spark, d))[0]
