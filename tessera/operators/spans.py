"""Algebra of intervals, per series, with inclusive ends a and b; every step is a window or a join on the series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.catalog import FRAMES, MARKUP, query
from tessera.sources.frames import frames, markup



def _by() -> WindowSpec:
    return Window.partitionBy("series_id").orderBy("a", "b")


def coalesce(spans: DataFrame, tolerance: int = 1) -> DataFrame:
    """Spans joined where the next begins at most `tolerance` after the end; 1 joins neighbours, more closes gaps."""
    reach = F.max("b").over(_by().rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", (reach.isNull() | (F.col("a") > reach + tolerance)).cast("int"))
    grouped = marked.withColumn("g", F.sum("new").over(_by().rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("series_id", "g").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("g")


def complement(spans: DataFrame, whole: DataFrame) -> DataFrame:
    """What spans leave of each series of whole (series_id, a, b)."""
    ends = whole.select("series_id", (F.col("b") + 1).alias("a"), (F.col("b") + 1).alias("b"))
    cut = coalesce(spans).unionByName(ends)
    last = F.max("b").over(_by().rowsBetween(Window.unboundedPreceding, -1))
    out = cut.select("series_id", F.coalesce(last + 1, F.lit(0)).alias("a"), (F.col("a") - 1).alias("b"))
    return out.where("a <= b")


def intersect(x: DataFrame, y: DataFrame) -> DataFrame:
    """Common parts of two sets of disjoint spans: an equi-join on the series with a range condition."""
    y = y.select(F.col("series_id").alias("s"), F.col("a").alias("c"), F.col("b").alias("d"))
    met = x.join(y, (F.col("series_id") == F.col("s")) & (F.col("a") <= F.col("d")) & (F.col("c") <= F.col("b")))
    return met.select("series_id", F.greatest("a", "c").alias("a"), F.least("b", "d").alias("b"))


def subtract(x: DataFrame, y: DataFrame, whole: DataFrame) -> DataFrame:
    return intersect(x, complement(y, whole))


def whole(rows: DataFrame) -> DataFrame:
    return rows.groupBy("series_id").agg(F.lit(0).alias("a"), F.max("t").alias("b"))


def of_tag(labels: DataFrame, tag: str, before: int = 0, after: int = 0) -> DataFrame:
    return labels.where(F.col("tag") == tag).select("series_id", F.greatest(F.col("start") - before, F.lit(0)).alias("a"), (F.col("stop") - 1 + after).alias("b"))


A = "sa AS (SELECT series_id, greatest(start - 1, 0) AS a, stop + 1 AS b FROM mk WHERE tag = 'click')"
B = "sb AS (SELECT series_id, start AS a, stop - 1 AS b FROM mk WHERE tag IN ('view', 'error'))"


def _joined(name: str, source: str, gap: int) -> str:
    return f"""{name}1 AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY series_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap}, true)::INT AS n FROM {source}),
{name}2 AS (SELECT *, sum(n) OVER (PARTITION BY series_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM {name}1), {name} AS (SELECT series_id, min(a) AS a, max(b) AS b FROM {name}2 GROUP BY series_id, g)"""


WHOLE = "wh AS (SELECT series_id, 0 AS a, max(t) AS b FROM fr GROUP BY series_id)"


def _left(name: str, source: str) -> str:
    return f"""{name}e AS (SELECT series_id, a, b FROM {source} UNION ALL SELECT series_id, b + 1, b + 1 FROM wh), {name}0 AS (SELECT series_id, coalesce(max(b) OVER (PARTITION BY series_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 0) AS a, a - 1 AS b FROM {name}e), {name} AS (SELECT * FROM {name}0 WHERE a <= b)"""


@query("span_union", f"WITH {MARKUP}, {A}, {_joined('u', 'sa', 1)} SELECT series_id, a, b FROM u")
def span_union(spark, d):
    return coalesce(of_tag(markup(spark, d), "click", 1, 2))


@query("span_close", f"WITH {MARKUP}, {A}, {_joined('u', 'sa', 4)} SELECT series_id, a, b FROM u")
def span_close(spark, d):
    """Gaps of up to three frames are bridged."""
    return coalesce(of_tag(markup(spark, d), "click", 1, 2), 4)


@query("span_keep_long", f"WITH {MARKUP}, {A}, {_joined('u', 'sa', 4)} SELECT series_id, a, b FROM u WHERE b - a + 1 >= 8")
def span_keep_long(spark, d):
    return span_close(spark, d).where("b - a + 1 >= 8")


@query("span_complement", f"WITH {MARKUP}, {A}, {WHOLE}, {_joined('u', 'sa', 1)}, {_left('f', 'u')} SELECT series_id, a, b FROM f")
def span_complement(spark, d):
    return complement(of_tag(markup(spark, d), "click", 1, 2), whole(frames(spark, d)))


@query("span_intersect", f"WITH {MARKUP}, {A}, {B}, {_joined('u', 'sa', 1)}, {_joined('v', 'sb', 1)} SELECT u.series_id, greatest(u.a, v.a) AS a, least(u.b, v.b) AS b FROM u JOIN v ON u.series_id = v.series_id AND u.a <= v.b AND v.a <= u.b")
def span_intersect(spark, d):
    m = markup(spark, d)
    return intersect(coalesce(of_tag(m, "click", 1, 2)), coalesce(of_tag(m, "view").union(of_tag(m, "error"))))


@query("span_subtract", f"WITH {MARKUP}, {A}, {B}, {WHOLE}, {_joined('u', 'sa', 1)}, {_joined('v', 'sb', 1)}, {_left('f', 'v')} SELECT u.series_id, greatest(u.a, f.a) AS a, least(u.b, f.b) AS b FROM u JOIN f ON u.series_id = f.series_id AND u.a <= f.b AND f.a <= u.b")
def span_subtract(spark, d):
    m = markup(spark, d)
    return subtract(coalesce(of_tag(m, "click", 1, 2)), of_tag(m, "view").union(of_tag(m, "error")), whole(frames(spark, d)))


@query("span_restore", f"WITH {MARKUP}, {A}, {B}, sc AS (SELECT * FROM sa UNION ALL SELECT * FROM sb), {_joined('u', 'sc', 1)} SELECT series_id, a, b FROM u")
def span_restore(spark, d):
    """Spans given back: the union of what is free and what is restored."""
    m = markup(spark, d)
    return coalesce(of_tag(m, "click", 1, 2).union(of_tag(m, "view")).union(of_tag(m, "error")))


@query("start_guard", f"WITH {MARKUP}, {WHOLE}, g AS (SELECT series_id, greatest(start - 5, 0) AS a, stop - 1 AS b FROM mk WHERE tag = 'click'), {_joined('u', 'g', 1)}, {_left('f', 'u')} SELECT series_id, a, b FROM f")
def start_guard(spark, d, size: int = 6):
    """Starts of windows of `size` that touch no click: each click is taken out with the size - 1 frames before it."""
    return complement(of_tag(markup(spark, d), "click", size - 1), whole(frames(spark, d)))


@query("overlap_measure", f"WITH {MARKUP}, {A}, {B}, {_joined('u', 'sa', 1)}, {_joined('v', 'sb', 1)} SELECT u.series_id, sum(least(u.b, v.b) - greatest(u.a, v.a) + 1)::BIGINT AS n FROM u JOIN v ON u.series_id = v.series_id AND u.a <= v.b AND v.a <= u.b GROUP BY 1")
def overlap_measure(spark, d):
    return span_intersect(spark, d).groupBy("series_id").agg(F.sum(F.col("b") - F.col("a") + 1).alias("n"))


@query("fits_free_run", f"WITH {MARKUP}, {A}, {WHOLE}, {_joined('u', 'sa', 1)}, {_left('f', 'u')} SELECT w.series_id, w.t AS start FROM fr w JOIN f ON w.series_id = f.series_id AND f.a <= w.t AND w.t + 5 <= f.b")
def fits_free_run(spark, d, size: int = 6):
    """Starts of windows that lie in a free span as a whole."""
    free = span_complement(spark, d).select(F.col("series_id").alias("s"), "a", "b")
    rows = frames(spark, d).select("series_id", F.col("t").alias("start"))
    return rows.join(free, (F.col("series_id") == F.col("s")) & (F.col("a") <= F.col("start")) & (F.col("start") + size - 1 <= F.col("b"))).select("series_id", "start")


@query("window_overlaps", f"WITH {MARKUP}, {A}, o AS (SELECT x.series_id, x.a AS a1, x.b AS b1, y.a AS a2, y.b AS b2 FROM sa x JOIN sa y ON x.series_id = y.series_id AND x.a < y.a AND y.a <= x.b) SELECT *, round((b1 - a2 + 1.0) / least(b1 - a1 + 1, b2 - a2 + 1), 6) AS share FROM o WHERE b2 >= b1")
def window_overlaps(spark, d):
    """Overlapping pairs and the shared part of the shorter one; spans' ends rise with their starts here."""
    x = of_tag(markup(spark, d), "click", 1, 2)
    a = x.select("series_id", F.col("a").alias("a1"), F.col("b").alias("b1"))
    b = x.select("series_id", F.col("a").alias("a2"), F.col("b").alias("b2"))
    met = a.join(b, "series_id").where("a1 < a2 and a2 <= b1 and b2 >= b1")
    share = (F.col("b1") - F.col("a2") + 1) / F.least(F.col("b1") - F.col("a1") + 1, F.col("b2") - F.col("a2") + 1)
    return met.withColumn("share", F.round(share.cast("double"), 6))
