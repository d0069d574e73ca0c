"""Labelled series made by rule: lines of letters, each with a shape of its own, at several widths, with noise on request.

Every number is a hash of its place, so any part of a set can be made by itself, in any number of tasks, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Frames of a gap between letters, the least width of a letter, and how much wider it may be.
GAP, WIDTH, WIDER = 3, 12, 9
WAVES, HEIGHT = 4, 20.0


def chance(*parts) -> Column:
    """A number between 0 and 1 for each value of some columns."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def letters_of(spark: SparkSession, lines: int = 10, chars: int = 20, letters: int = 26, seed: int = 0) -> DataFrame:
    """series_id, tag, letter, start, stop: the labels of `lines` series of `chars` letters each, with a gap after each."""
    rows = spark.range(lines * chars).select((F.col("id") / chars).cast("long").alias("series_id"), (F.col("id") % chars).alias("place"))
    letter = F.pmod(F.xxhash64(F.lit(seed), F.lit("letter"), "series_id", "place"), F.lit(letters)).cast("int")
    width = WIDTH + F.pmod(F.xxhash64(F.lit(seed), F.lit("width"), "series_id", "place"), F.lit(WIDER)).cast("int")
    before = Window.partitionBy("series_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("letter", letter).withColumn("width", width).withColumn("start", F.coalesce(F.sum(F.col("width") + GAP).over(before), F.lit(0)).cast("int"))
    return rows.select("series_id", F.chr(F.col("letter") + 97).alias("tag"), "letter", "start", (F.col("start") + F.col("width")).cast("int").alias("stop"))


def frames_of(labels: DataFrame, noise: float = 0.0, shots: float = 0.0, seed: int = 0) -> DataFrame:
    """series_id, t, tag (null in gaps), x and h of the letters: sums of waves of the letter, stretched over its width; zero in gaps.

    noise: the deviation of Gaussian noise; shots: the share of frames that are struck out by any value.
    """
    rows = labels.withColumn("t", F.explode(F.sequence(F.col("start"), F.col("stop") + GAP - 1)))
    u = (F.col("t") - F.col("start")) / (F.col("stop") - F.col("start") - 1)
    inside = F.col("t") < F.col("stop")

    def value(dim: int) -> Column:
        waves = sum(((2 * chance(F.lit("shape"), F.lit(seed), "letter", F.lit(k), F.lit(dim)) - 1) * HEIGHT * F.sin(F.pi() * k * u) for k in range(1, WAVES + 1)), F.lit(0.0))
        part = lambda name: chance(F.lit(name), F.lit(seed), "series_id", "t", F.lit(dim))
        out = F.when(inside, waves).otherwise(0.0) + noise * F.sqrt(-2 * F.ln(part("a"))) * F.cos(2 * F.pi() * part("b"))
        return F.when(part("hit") < shots, (2 * part("shot") - 1) * 3 * HEIGHT).otherwise(out)

    return rows.select("series_id", "t", F.when(inside, F.col("tag")).alias("tag"), value(0).alias("x"), value(1).alias("h"))


def labelled_series(spark: SparkSession, lines: int = 10, chars: int = 20, letters: int = 26, noise: float = 0.0, shots: float = 0.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Frames and labels (series_id, tag, start, stop) of a set; `text_files.write_dataset` writes them."""
    labels = letters_of(spark, lines, chars, letters, seed)
    return frames_of(labels, noise, shots, seed), labels.select("series_id", "tag", "start", "stop")
