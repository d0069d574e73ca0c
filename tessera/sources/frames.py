"""Time series as rows: frames (series_id, t, x), labels (series_id, tag, start, stop) and symbols (series_id, t, sym)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, t, x, tag, h: the events of a user in order of time; x is the value, h the hour."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = load(spark, sf_dir, "events")
    return events.select(F.col("user_id").alias("series_id"), (F.row_number().over(order) - 1).alias("t"), F.col("value").alias("x"), F.col("event_type").alias("tag"), F.hour("ts").cast("double").alias("h"))


def runs(rows: DataFrame, symbol: str = "tag") -> DataFrame:
    """series_id, symbol, start and stop (exclusive) of each run of equal symbols."""
    by = Window.partitionBy("series_id", symbol).orderBy("t")
    islands = rows.select("series_id", "t", symbol, (F.col("t") - F.row_number().over(by)).alias("g"))
    return islands.groupBy("series_id", symbol, "g").agg(F.min("t").alias("start"), (F.max("t") + 1).alias("stop")).drop("g")


def markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels: runs of equal event types."""
    return runs(frames(spark, sf_dir))


def symbols(rows: DataFrame, key: str = "tag") -> DataFrame:
    """rows with `sym`, the rank of key among its distinct values from 0; the list of values is joined by its key."""
    place = Window.orderBy(key)
    ranks = rows.select(key).distinct().withColumn("sym", F.dense_rank().over(place) - 1)
    return rows.join(ranks, key)


def series(rows: DataFrame, value: str = "x") -> DataFrame:
    """series_id and xs, all values of the series in order of t. A series, not the table, is what one row holds."""
    pairs = F.sort_array(F.collect_list(F.struct("t", F.col(value).alias("v"))))
    return rows.groupBy("series_id").agg(F.transform(pairs, lambda p: p.v).alias("xs"))
