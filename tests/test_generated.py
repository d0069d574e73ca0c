"""Generated series: labels tile them, letters keep their shapes, noise is as asked for, and a written set is read back."""

import collections

import numpy as np
from pyspark.sql import functions as F

from tessera.plans import spotting
from tessera.sources import generated, text_files


def test_shapes_and_labels(spark):
    frames, labels = generated.labelled_series(spark, 6, 12, 5, seed=3)
    again = generated.labelled_series(spark, 6, 12, 5, seed=3)
    assert sorted(map(tuple, labels.collect())) == sorted(map(tuple, again[1].repartition(3).collect()))
    x = collections.defaultdict(dict)
    for r in frames.collect():
        x[r.series_id][r.t] = (r.x, r.h, r.tag)
    shapes = collections.defaultdict(list)
    by = collections.defaultdict(list)
    for r in labels.collect():
        by[r.series_id].append(r)
    assert len(by) == 6 and all(len(v) == 12 for v in by.values()) and {r.tag for v in by.values() for r in v} == set("abcde")
    for s, own in by.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and 12 <= r.stop - r.start < 21 and all(x[s][t][2] == r.tag for t in range(r.start, r.stop))
            assert all(x[s][t] == (0.0, 0.0, None) for t in range(r.stop, r.stop + 3))
            shapes[r.tag, r.stop - r.start].append([x[s][t][:2] for t in range(r.start, r.stop)])
            at = r.stop + 3
        assert sorted(x[s]) == list(range(at))
    assert all(np.allclose(v, v[0]) for v in shapes.values()) and max(map(len, shapes.values())) > 1
    assert labels.collect() != generated.labelled_series(spark, 6, 12, 5, seed=4)[1].collect()


def test_noise_and_shots(spark):
    clean, _ = generated.labelled_series(spark, 20, 10, seed=1)
    noisy = generated.frames_of(generated.letters_of(spark, 20, 10, seed=1), noise=2.0, seed=1)
    met = clean.alias("a").join(noisy.alias("b"), ["series_id", "t"]).select((F.col("a.x") - F.col("b.x")).alias("d"))
    got = met.agg(F.avg("d").alias("m"), F.stddev_pop("d").alias("s"), F.count("*").alias("n")).first()
    assert got.n > 2500 and abs(got.m) < 0.2 and abs(got.s - 2) < 0.15
    shot = generated.frames_of(generated.letters_of(spark, 20, 10, seed=1), shots=0.1, seed=1)
    n = clean.alias("a").join(shot.alias("b"), ["series_id", "t"]).where("abs(a.x - b.x) > 1e-9").count()
    assert abs(n / got.n - 0.1) < 0.03


def test_letters_are_recognised(spark):
    """Models trained on a set's letters spot those of another set of the same shapes."""
    frames, _ = generated.labelled_series(spark, 12, 15, 3, noise=1.0, seed=5)
    rows = spotting.quantised(frames.withColumn("tag", F.coalesce("tag", F.lit("gap"))))
    models, _ = spotting.train(spotting.sequences(rows, ("x", "h")).where("n >= 3"), states=4)
    other = generated.frames_of(generated.letters_of(spark, 4, 15, 3, seed=5).withColumn("series_id", F.col("series_id") + 100), noise=1.0, seed=5).withColumn("tag", F.coalesce("tag", F.lit("gap")))
    truth = {(r.series_id, r.t): r.tag for r in other.collect()}
    found = spotting.spotted(other, models, spotting.VALUES, None).collect()
    right = sum(truth[r.series_id, t] == r.tag for r in found for t in range(r.start, r.stop))
    assert right > 0.75 * len(truth)


def test_a_written_set_is_read_back(spark, tmp_path):
    frames, labels = generated.labelled_series(spark, 3, 4, 4, seed=2)
    one = frames.withColumn("series_id", F.col("series_id") + 1), labels.withColumn("series_id", F.col("series_id") + 1)
    text_files.write_dataset(*one, f"{tmp_path}/set")
    got = text_files.read_labels(spark, f"{tmp_path}/set/labels/*/*.txt").select(F.regexp_extract("file", "series_id=(\\d+)", 1).cast("long").alias("s"), "tag", "start", "stop")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, one[1].collect()))
    entries = text_files.read_definition(spark, f"{tmp_path}/set/def/*.txt")
    assert [e["data"] for e in entries] == [f"raw/series_id={i}" for i in (1, 2, 3)]
