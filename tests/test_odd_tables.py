"""Queries that divide, on values that are all the same, on one series, and on an empty table of events: no division by zero, no crash."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera import catalog

DIVIDE = "class_histogram minmax_normalise density_curve state_means_scaled growth_test growth_accepted event_scores worst_frames model_selection score_distribution length_winner motif_radius rescored_spots collision_guard frame_confusion calc_stop discrete_hmms trained_score_distribution spotted_words".split()


@pytest.fixture(scope="module")
def folders(spark, data, tmp_path_factory):
    """The tables of the smallest scale, with the events changed."""
    events = spark.read.parquet(f"{data}/events.parquet")
    kinds = {"constant": events.withColumn("value", F.lit(5.0).cast(events.schema["value"].dataType)), "one": events.where(F.col("user_id") == events.agg(F.min("user_id")).first()[0]), "none": events.limit(0)}
    out = {}
    for name, df in kinds.items():
        folder = tmp_path_factory.mktemp(name)
        df.write.parquet(f"{folder}/events.parquet")
        for t in ("documents", "conversations", "embeddings", "labels"):
            spark.read.parquet(f"{data}/{t}.parquet").limit(50).write.parquet(f"{folder}/{t}.parquet")
        out[name] = str(folder)
    return out


@pytest.mark.parametrize("name", DIVIDE)
def test_constant_values(spark, folders, name):
    rows = entry.queries()[name](spark, folders["constant"]).collect()
    assert all(v != float("inf") and v == v for r in rows for v in r if isinstance(v, float))


@pytest.mark.parametrize("kind", ["one", "none"])
@pytest.mark.parametrize("name", DIVIDE)
def test_one_series_and_none(spark, folders, name, kind):
    entry.queries()[name](spark, folders[kind]).collect()


def test_values_that_do_not_vary(spark, folders):
    """What the results are: the first bin, no scaled value, no test."""
    d = folders["constant"]
    assert {r.bin for r in catalog.QUERIES["class_histogram"](spark, d).collect()} == {0}
    assert {r.x for r in catalog.QUERIES["minmax_normalise"](spark, d).collect()} == {None}
    assert {(r.t, r.p, r.accepted) for r in catalog.QUERIES["growth_accepted"](spark, d).collect()} == {(None, None, None)}
    assert {r.level for r in catalog.QUERIES["state_means_scaled"](spark, d).where("dim = 0").collect()} == {None}
