"""Windows, projections and reshaping of series."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.catalog import FRAMES, MARKUP, query
from tessera.sources.frames import frames, load, markup, series, symbols


def sliding(rows: DataFrame, size: int, step: int = 1, value: str = "x") -> DataFrame:
    """series_id, start, len, xs: every window of `size` frames that starts at a multiple of `step`."""
    ahead = Window.partitionBy("series_id").orderBy("t").rowsBetween(0, size - 1)
    out = rows.select("series_id", F.col("t").alias("start"), F.collect_list(value).over(ahead).alias("xs"))
    return out.where((F.size("xs") == size) & (F.col("start") % step == 0)).select("series_id", "start", F.lit(size).alias("len"), "xs")


def lengths(low: int, high: int) -> list[int]:
    """Between one and five window lengths, evenly spaced from low to high: as many as half the range's size, rounded."""
    n = int(min(5, max(1, (high - low + 1) / 2)) + 0.5)
    return [low] if n == 1 else [round(low + i * (high - low) / (n - 1)) for i in range(n)]


def placed(rows: DataFrame, sizes: list[int], step: int = 1) -> DataFrame:
    """win_id, series_id, start and len of windows of several lengths, in the order of series, length and start, from the lengths of series alone: no frame is read twice or held.

    The ids of a series begin after the windows of all series before it, which their lengths give, so only one row a
    series is ordered globally.
    """
    per = rows.groupBy("series_id").agg(F.count("*").alias("n"))
    counts = [F.greatest(F.floor((F.col("n") - s) / step) + 1, F.lit(0)) for s in sizes]
    before = Window.orderBy("series_id").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("series_id", F.coalesce(F.sum(sum(counts[1:], counts[0])).over(before), F.lit(0)).alias("base"), F.array(*counts).alias("many"))
    first = lambda i: F.col("base") + sum((F.get("many", F.lit(k)) for k in range(i)), F.lit(0))
    each = F.array(*[F.struct(F.lit(s).alias("len"), first(i).alias("first"), F.get("many", F.lit(i)).alias("k")) for i, s in enumerate(sizes)])
    each = base.select("series_id", F.inline(each)).where("k > 0")
    own = each.select("series_id", "len", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("j"))
    return own.select((F.col("first") + F.col("j")).cast("long").alias("win_id"), "series_id", (F.col("j") * step).cast("int").alias("start"), "len")


def multi(rows: DataFrame, sizes: list[int], step: int = 1) -> DataFrame:
    """Windows of several lengths with win_id, as `placed`, and xs, their values."""
    out = None
    for s in sizes:
        own = sliding(rows, s, step)
        out = own if out is None else out.unionByName(own)
    return placed(rows, sizes, step).join(out, ["series_id", "start", "len"]).select("win_id", "series_id", "start", "len", "xs")


def at_offsets(rows: DataFrame) -> DataFrame:
    """series_id and first, each series' place in the concatenation of all."""
    before = Window.orderBy("series_id").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy("series_id").agg(F.count("*").alias("n"))
    return per.select("series_id", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))


def paa_descriptor(xs: Column, n: Column, parts: int) -> Column:
    """Means of `parts` segments that overlap by half."""
    width = n / F.lit(parts - (parts - 1) * 0.5)

    def mean(i: Column) -> Column:
        a = F.floor(i * width * 0.5).cast("int")
        b = F.least(F.greatest(F.ceil(i * width * 0.5 + width).cast("int"), a + 1), n.cast("int"))
        return F.aggregate(F.slice(xs, a + 1, b - a), F.lit(0.0), lambda s, x: s + x) / (b - a)

    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), mean)


def resample(xs: Column, n: Column, size: int) -> Column:
    """Linear interpolation to `size` points, ends kept."""

    def point(i: Column) -> Column:
        at = i * (n - 1) / F.lit(float(size - 1))
        a = F.floor(at).cast("int")
        b = F.least(a + 1, (n - 1).cast("int"))
        return F.get(xs, a) + (at - a) * (F.get(xs, b) - F.get(xs, a))

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), point)


WINDOW8 = "w8 AS (SELECT series_id, t AS start, list(x) OVER o AS xs FROM fr WINDOW o AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING))"


@query("sliding_windows", f"WITH {FRAMES}, {WINDOW8} SELECT series_id, start, 8 AS len, round(list_sum(xs), 6) AS total, xs[1] AS first, xs[8] AS last FROM w8 WHERE len(xs) = 8 AND start % 2 = 0")
def sliding_windows(spark, d):
    w = sliding(frames(spark, d), 8, 2)
    return w.select("series_id", "start", "len", F.round(F.aggregate("xs", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.get("xs", F.lit(0)).alias("first"), F.get("xs", F.lit(7)).alias("last"))


@query("multi_length_windows", f"""WITH {FRAMES}, n AS (SELECT series_id, count(*) AS n FROM fr GROUP BY series_id), l(len) AS (VALUES (24), (28), (32), (36), (40)),
s AS (SELECT series_id, len, t AS start FROM n, l, range(0, n - len + 1, 2) r(t))
SELECT row_number() OVER (ORDER BY series_id, len, start) - 1 AS win_id, series_id, start, len FROM s""")
def multi_length_windows(spark, d):
    return placed(frames(spark, d), lengths(24, 40), 2)


@query("window_series_map", f"""WITH {FRAMES}, n AS (SELECT series_id, count(*) AS n FROM fr GROUP BY series_id), w AS (SELECT series_id, t AS start FROM n, range(0, n - 7, 4) r(t))
SELECT row_number() OVER (ORDER BY series_id, start) - 1 AS win_id, series_id, start FROM w""")
def window_series_map(spark, d):
    """Half-overlapping windows of 8; the global id maps back to the series whose first id is the last one not above it."""
    return placed(frames(spark, d), [8], 4).select("win_id", "series_id", "start")


LOCATED = "n AS (SELECT series_id, count(*) AS n FROM fr GROUP BY series_id), w AS (SELECT series_id, t AS start FROM n, range(0, n - 7) r(t)), i AS (SELECT row_number() OVER (ORDER BY series_id, start) - 1 AS win_id, series_id, start FROM w)"


@query("window_locations", f"WITH {FRAMES}, {LOCATED} SELECT win_id, series_id, start FROM i")
def window_locations(spark, d, size: int = 8):
    """Each global window number with its place: the series whose first number is the last one not above it.

    Series say which numbers are theirs, and numbers are joined with them, so no range is searched.
    """
    rows = frames(spark, d)
    per = rows.groupBy("series_id").agg(F.count("*").alias("n"))
    before = Window.orderBy("series_id").rowsBetween(Window.unboundedPreceding, -1)  # a row a series
    many = F.greatest(F.col("n") - size + 1, F.lit(0))
    per = per.select("series_id", many.alias("k"), F.coalesce(F.sum(many).over(before), F.lit(0)).alias("first"))
    owned = per.where("k > 0").select("series_id", "first", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("k") - 1)).alias("win_id"))
    asked = placed(rows, [size]).select("win_id")
    return asked.join(owned, "win_id").select("win_id", "series_id", (F.col("win_id") - F.col("first")).alias("start"))


def dim_groups(control: str) -> list[list[int]]:
    """Groups of dimensions from words of letters: capitals stand for dimensions from 0 on, small letters for those from 26 on."""
    groups = []
    for word in re.split("[, \\r\\n\\t]+", control.strip(", \r\n\t")):
        if not re.fullmatch("[A-Za-z]+", word):
            raise ValueError(f"no letters: {word!r}")
        groups.append([ord(c) - 65 if c <= "Z" else 26 + ord(c) - 97 for c in word])
    return groups


@query("dim_group_means", f"WITH {FRAMES}, c AS (SELECT tag, dense_rank() OVER (ORDER BY tag) - 1 AS code FROM (SELECT DISTINCT tag FROM fr)) SELECT series_id, t, unnest([0, 1]) AS grp, round(unnest([(x + h) / 2, code::DOUBLE]), 6) AS mean FROM fr JOIN c USING (tag)")
def dim_group_means(spark, d, control: str = "AB C"):
    """The mean of each group of dimensions in each frame."""
    rows = symbols(frames(spark, d)).select("series_id", "t", F.array("x", "h", F.col("sym").cast("double")).alias("v"))
    means = [sum((F.get("v", F.lit(i)) for i in g[1:]), F.get("v", F.lit(g[0]))) / len(g) for g in dim_groups(control)]
    return rows.select("series_id", "t", F.posexplode(F.array(*means)).alias("grp", "mean")).withColumn("mean", F.round("mean", 6))


@query("linear_index", f"""WITH {FRAMES}, n AS (SELECT series_id, count(*) AS n FROM fr GROUP BY series_id), b AS (SELECT series_id, coalesce(sum(n) OVER (ORDER BY series_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first, row_number() OVER (ORDER BY series_id) - 1 AS k FROM n)
SELECT series_id, t, first + t AS lin, first + k + t AS lin_term FROM fr JOIN b USING (series_id)""")
def linear_index(spark, d):
    """Place in the concatenation of all series, without and with a terminator after each."""
    rows = frames(spark, d)
    b = at_offsets(rows).withColumn("k", F.row_number().over(Window.orderBy("series_id")) - 1)
    return rows.join(b, "series_id").select("series_id", "t", (F.col("first") + F.col("t")).alias("lin"), (F.col("first") + F.col("k") + F.col("t")).alias("lin_term"))


@query("dim_select_append", f"""WITH {FRAMES}, c AS (SELECT tag, dense_rank() OVER (ORDER BY tag) - 1 AS code FROM (SELECT DISTINCT tag FROM fr))
SELECT series_id, t, x AS x0, h AS x1, code::DOUBLE AS x2 FROM fr JOIN c USING (tag)""")
def dim_select_append(spark, d):
    """Dimensions appended to the value, then chosen by number from the array."""
    rows = symbols(frames(spark, d)).select("series_id", "t", F.array("x", "h").alias("a"), F.array(F.col("sym").cast("double")).alias("b"))
    both = rows.withColumn("v", F.concat("a", "b")).withColumn("v", F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: F.get("v", i)))
    return both.select("series_id", "t", *[F.get("v", F.lit(i)).alias(f"x{i}") for i in range(3)])


@query("extract_labelled", f"WITH {MARKUP} SELECT m.series_id, m.tag, m.start, m.stop, round(sum(f.x), 6) AS total, min(f.x) AS low, max(f.x) AS high FROM mk m JOIN fr f ON f.series_id = m.series_id AND f.t >= m.start AND f.t < m.stop GROUP BY ALL")
def extract_labelled(spark, d):
    """Subsequences of labels: a slice of the series' array, not a join of every frame."""
    cut = F.slice("xs", F.col("start") + 1, F.col("stop") - F.col("start"))
    rows = markup(spark, d).join(series(frames(spark, d)), "series_id").withColumn("p", cut)
    return rows.select("series_id", "tag", "start", "stop", F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.array_min("p").alias("low"), F.array_max("p").alias("high"))


@query("minmax_normalise", f"WITH {FRAMES}, m AS (SELECT min(x) AS lo, max(x) AS hi FROM fr) SELECT series_id, t, round((x - lo) / (hi - lo), 6) AS x FROM fr, m")
def minmax_normalise(spark, d):
    rows = frames(spark, d)
    m = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))  # one row
    return rows.join(F.broadcast(m)).select("series_id", "t", F.round(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")), 6).alias("x"))


@query("not_finite", f"WITH {FRAMES}, z AS (SELECT series_id, t, CASE WHEN t % 50 = 7 THEN 'NaN'::DOUBLE WHEN t % 50 = 9 THEN 'Infinity'::DOUBLE ELSE x END AS x FROM fr) SELECT series_id, t, isnan(x) AS is_nan FROM z WHERE isnan(x) OR isinf(x)")
def not_finite(spark, d):
    bad = F.when(F.col("t") % 50 == 7, F.lit(float("nan"))).when(F.col("t") % 50 == 9, F.lit(float("inf"))).otherwise(F.col("x"))
    rows = frames(spark, d).withColumn("x", bad)
    return rows.where(F.isnan("x") | (F.abs("x") == float("inf"))).select("series_id", "t", F.isnan("x").alias("is_nan"))


@query("smooth", f"WITH {FRAMES}, a AS (SELECT series_id, t, avg(x) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS x FROM fr) SELECT series_id, t, round(avg(x) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS x FROM a")
def smooth(spark, d, times: int = 2, reach: int = 2):
    """A moving mean of five frames, applied again to its own result."""
    near = Window.partitionBy("series_id").orderBy("t").rowsBetween(-reach, reach)
    rows = frames(spark, d).select("series_id", "t", "x")
    for _ in range(times):
        rows = rows.withColumn("x", F.avg("x").over(near))
    return rows.select("series_id", "t", F.round("x", 6).alias("x"))


@query("resample_series", f"""WITH {FRAMES}, s AS (SELECT series_id, list(x ORDER BY t) AS xs, count(*) AS n FROM fr GROUP BY series_id), i AS (SELECT *, k * (n - 1) / 31.0::DOUBLE AS pos FROM s, range(32) r(k))
SELECT series_id, k::INT AS k, round(xs[floor(pos)::INT + 1] + (pos - floor(pos)) * (xs[least(floor(pos)::INT + 1, n - 1) + 1] - xs[floor(pos)::INT + 1]), 6) AS x FROM i""")
def resample_series(spark, d):
    s = series(frames(spark, d))
    out = s.select("series_id", F.posexplode(resample(F.col("xs"), F.size("xs").cast("double"), 32)).alias("k", "x"))
    return out.select("series_id", "k", F.round("x", 6).alias("x"))


@query("paa_descriptors", f"""WITH {FRAMES}, s AS (SELECT series_id, list(x ORDER BY t) AS xs, count(*)::DOUBLE AS n FROM fr GROUP BY series_id),
p AS (SELECT *, n / 4.5 AS w FROM s, range(8) r(k)), b AS (SELECT *, floor(k * w * 0.5)::INT AS a FROM p), c AS (SELECT *, least(greatest(ceil(k * w * 0.5 + w)::INT, a + 1), n::INT) AS e FROM b)
SELECT series_id, k::INT AS k, round(list_sum(xs[a + 1:e]) / (e - a), 6) AS x FROM c""")
def paa_descriptors(spark, d):
    s = series(frames(spark, d)).withColumn("n", F.size("xs").cast("double"))
    out = s.select("series_id", F.posexplode(paa_descriptor(F.col("xs"), F.col("n"), 8)).alias("k", "x"))
    return out.select("series_id", "k", F.round("x", 6).alias("x"))


@query("band_pooling", "WITH e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT vec_id, (i // 8)::INT AS band, round(avg(v::DOUBLE), 6) AS x FROM e GROUP BY ALL")
def band_pooling(spark, d, bands: int = 8):
    """Means of bands of eight values."""
    mean = lambda b: F.aggregate(F.slice("embedding", b * 8 + 1, 8), F.lit(0.0), lambda a, x: a + x) / 8
    rows = load(spark, d, "embeddings").select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), mean)).alias("band", "x"))
    return rows.select("vec_id", "band", F.round("x", 6).alias("x"))


@query("densify", f"WITH {FRAMES} SELECT series_id, t, dense_rank() OVER (ORDER BY tag) - 1 AS sym FROM fr")
def densify(spark, d):
    return symbols(frames(spark, d)).select("series_id", "t", F.col("sym").cast("long").alias("sym"))


@query("symbol_strings", f"WITH {FRAMES}, q AS (SELECT series_id, t, dense_rank() OVER (ORDER BY tag) - 1 AS sym FROM fr) SELECT series_id, string_agg(chr((97 + sym)::INT), '' ORDER BY t) AS s FROM q GROUP BY series_id")
def symbol_strings(spark, d):
    s = series(symbols(frames(spark, d)), "sym")
    return s.select("series_id", F.array_join(F.transform("xs", lambda x: F.chr(x + 97)), "").alias("s"))


@query("label_edit", f"WITH {MARKUP} SELECT series_id, regexp_replace(tag, '^(.).*(.)$', '\\1\\2') AS tag, start, stop FROM mk WHERE stop - start >= 2 AND tag <> 'error'")
def label_edit(spark, d):
    """Labels kept by a predicate and renamed by an expression."""
    m = markup(spark, d).where("stop - start >= 2 and tag <> 'error'")
    return m.select("series_id", F.regexp_replace("tag", "^(.).*(.)$", "$1$2").alias("tag"), "start", "stop")


@query("chop", f"""WITH {MARKUP}, g AS (SELECT series_id, start, stop FROM mk WHERE stop - start >= 2), n AS (SELECT series_id, count(*) AS n FROM fr GROUP BY series_id),
e AS (SELECT series_id, start AS a, stop AS b FROM g UNION ALL SELECT series_id, n, n FROM n), f AS (SELECT series_id, coalesce(max(b) OVER (PARTITION BY series_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, a AS b FROM e)
SELECT series_id, a AS start, b AS stop, row_number() OVER (PARTITION BY series_id ORDER BY a) - 1 AS part FROM f WHERE b - a >= 4""")
def chop(spark, d, least: int = 4):
    """What is left of each series when long runs are taken out, in pieces of `least` frames or more."""
    gone = markup(spark, d).where("stop - start >= 2").select("series_id", F.col("start").alias("a"), F.col("stop").alias("b"))
    ends = frames(spark, d).groupBy("series_id").agg(F.count("*").alias("n")).select("series_id", F.col("n").alias("a"), F.col("n").alias("b"))
    by = Window.partitionBy("series_id").orderBy("a", "b")
    left = gone.union(ends).select("series_id", F.coalesce(F.max("b").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.col("a").alias("stop"))
    part = F.row_number().over(Window.partitionBy("series_id").orderBy("start")) - 1
    return left.where(F.col("stop") - F.col("start") >= least).withColumn("part", part)


@query("concat_class_series", f"WITH {FRAMES} SELECT tag, series_id, t, row_number() OVER (PARTITION BY tag ORDER BY series_id, t) - 1 AS k, x FROM fr")
def concat_class_series(spark, d):
    """All examples of a class one after another, over all series: a series' frames begin after those of the series before it, which counts give."""
    rows = frames(spark, d)
    order = Window.partitionBy("tag", "series_id").orderBy("t")
    before = Window.partitionBy("tag").orderBy("series_id").rowsBetween(Window.unboundedPreceding, -1)  # a row a series
    first = rows.groupBy("tag", "series_id").agg(F.count("*").alias("n")).select("tag", "series_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = rows.select("tag", "series_id", "t", (F.row_number().over(order) - 1).alias("k"), "x")
    return own.join(first, ["tag", "series_id"]).select("tag", "series_id", "t", (F.col("first") + F.col("k")).alias("k"), "x")
