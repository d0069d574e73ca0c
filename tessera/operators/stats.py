"""Aggregations, analytic functions and scores over frames, labels and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.catalog import FRAMES, MARKUP, query
from tessera.operators.windows import WINDOW8, sliding
from tessera.sources.frames import frames, load, markup, runs, symbols

CODE = "c AS (SELECT tag, dense_rank() OVER (ORDER BY tag) - 1 AS code FROM (SELECT DISTINCT tag FROM fr)), v AS (SELECT series_id, t, tag, unnest([0, 1, 2]) AS dim, unnest([x, h, code::DOUBLE]) AS x FROM fr JOIN c USING (tag))"


def dims(rows: DataFrame) -> DataFrame:
    """A row for each frame and dimension: the value, the hour and the symbol."""
    v = F.array("x", "h", F.col("sym").cast("double"))
    return symbols(rows).select("series_id", "t", "tag", F.posexplode(v).alias("dim", "x"))


def gaussian(x: str, mean: str, var: str) -> Column:
    """The log-likelihood of a column by a Gaussian; null where it has no variance."""
    gap = F.col(x) - F.col(mean)
    return -0.5 * (F.ln(2 * F.pi() * F.col(var)) + F.try_divide(gap * gap, F.col(var)))


def _round(c: Column | str, name: str) -> Column:
    return F.round(c, 6).alias(name)


@query("frame_stats", f"WITH {FRAMES}, {CODE} SELECT dim, count(*) AS n, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS var, min(x) AS low, max(x) AS high FROM v GROUP BY dim")
def frame_stats(spark, d):
    return dims(frames(spark, d)).groupBy("dim").agg(F.count("*").alias("n"), _round(F.avg("x"), "mean"), _round(F.var_pop("x"), "var"), F.min("x").alias("low"), F.max("x").alias("high"))


@query("length_stats", f"WITH {FRAMES}, n AS (SELECT count(*) AS n FROM fr GROUP BY series_id) SELECT count(*) AS n_series, sum(n)::BIGINT AS total, round(avg(n))::BIGINT AS mean FROM n")
def length_stats(spark, d):
    n = frames(spark, d).groupBy("series_id").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("n_series"), F.sum("n").alias("total"), F.round(F.avg("n")).cast("long").alias("mean"))


@query("class_counts", f"WITH {MARKUP} SELECT dense_rank() OVER (ORDER BY tag) - 1 AS class_id, tag, count(*) AS n, sum(stop - start)::BIGINT AS frames FROM mk GROUP BY tag")
def class_counts(spark, d):
    n = markup(spark, d).groupBy("tag").agg(F.count("*").alias("n"), F.sum(F.col("stop") - F.col("start")).alias("frames"))
    return n.withColumn("class_id", (F.dense_rank().over(Window.orderBy("tag")) - 1).cast("long"))


@query("class_gaussians", f"WITH {FRAMES}, {CODE} SELECT tag, dim, round(avg(x), 6) AS mean, round(coalesce(var_samp(x), 0), 6) AS var FROM v GROUP BY tag, dim")
def class_gaussians(spark, d):
    return dims(frames(spark, d)).groupBy("tag", "dim").agg(_round(F.avg("x"), "mean"), _round(F.coalesce(F.var_samp("x"), F.lit(0.0)), "var"))


@query("class_histogram", f"WITH {FRAMES}, m AS (SELECT min(x) AS lo, max(x) AS hi FROM fr), b AS (SELECT tag, least(floor((x - lo) / (hi - lo) * 10)::INT, 9) AS bin FROM fr, m) SELECT tag, bin, count(*) AS n FROM b GROUP BY ALL")
def class_histogram(spark, d, bins: int = 10):
    rows = frames(spark, d)
    m = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))  # one row
    share = F.coalesce(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))  # equal values: all in the first bin
    at = F.least(F.floor(share * bins).cast("int"), F.lit(bins - 1))
    return rows.join(F.broadcast(m)).select("tag", at.alias("bin")).groupBy("tag", "bin").agg(F.count("*").alias("n"))


@query("window_variance", f"WITH {FRAMES} SELECT series_id, t, round(v, 6) AS var FROM (SELECT series_id, t, var_samp(x) OVER o AS v, count(*) OVER o AS n FROM fr WINDOW o AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) WHERE n = 8")
def window_variance(spark, d, size: int = 8):
    ahead = Window.partitionBy("series_id").orderBy("t").rowsBetween(0, size - 1)
    rows = frames(spark, d).select("series_id", "t", F.var_samp("x").over(ahead).alias("v"), F.count("*").over(ahead).alias("n"))
    return rows.where(F.col("n") == size).select("series_id", "t", _round("v", "var"))


SILENT = f"WITH {FRAMES}, w AS (SELECT series_id, t, var_samp(x) OVER o AS v0, var_samp(h) OVER o AS v1, count(*) OVER o AS n FROM fr WINDOW o AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)), f AS (SELECT * FROM w WHERE n = 8), m AS (SELECT min(v0) AS l0, max(v0) AS h0, min(v1) AS l1, max(v1) AS h1 FROM f)"


@query("silence", f"{SILENT} SELECT series_id, t FROM f, m WHERE v0 <= l0 + (h0 - l0) / 4 AND v1 <= l1 + (h1 - l1) / 4")
def silence(spark, d, size: int = 8):
    """Windows in which every dimension's variance is in the lowest quarter of its range."""
    ahead = Window.partitionBy("series_id").orderBy("t").rowsBetween(0, size - 1)
    rows = frames(spark, d).select("series_id", "t", F.array(F.var_samp("x").over(ahead), F.var_samp("h").over(ahead)).alias("v"), F.count("*").over(ahead).alias("n")).where(F.col("n") == size)
    ends = rows.agg(*[f(F.get("v", F.lit(i))).alias(f"{n}{i}") for i in range(2) for n, f in (("l", F.min), ("h", F.max))])  # one row
    limits = F.array(*[F.col(f"l{i}") + (F.col(f"h{i}") - F.col(f"l{i}")) / 4 for i in range(2)])
    met = rows.join(F.broadcast(ends.select(limits.alias("limits"))))
    return met.where(F.forall(F.zip_with("v", "limits", lambda a, b: a <= b), lambda x: x)).select("series_id", "t")


@query("flat_segments", f"WITH {MARKUP}, p AS (SELECT m.series_id, m.tag, m.start, m.stop, var_samp(x) AS vx, var_samp(h) AS vh FROM mk m JOIN fr f ON f.series_id = m.series_id AND f.t >= m.start AND f.t < m.stop GROUP BY ALL) SELECT series_id, tag, start, stop FROM p WHERE round(vx, 9) <= 400 AND round(vh, 9) <= 60")
def flat_segments(spark, d):
    """Segments whose variances, to nine decimals, are within limits: a variance that is at its limit exactly is, in whichever order its frames were added."""
    rows = frames(spark, d)
    by = Window.partitionBy("series_id", "tag").orderBy("t")
    part = rows.withColumn("g", F.col("t") - F.row_number().over(by)).groupBy("series_id", "tag", "g").agg(F.min("t").alias("start"), (F.max("t") + 1).alias("stop"), F.var_samp("x").alias("vx"), F.var_samp("h").alias("vh"))
    return part.where("round(vx, 9) <= 400 and round(vh, 9) <= 60").select("series_id", "tag", "start", "stop")


@query("linear_segments", f"WITH {FRAMES}, w AS (SELECT series_id, t, regr_r2(x, t) OVER o AS r2, regr_slope(x, t) OVER o AS slope, count(*) OVER o AS n FROM fr WINDOW o AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) SELECT series_id, t, round(slope, 5) AS slope FROM w WHERE n = 8 AND r2 >= 0.5")
def linear_segments(spark, d, size: int = 8, least: float = 0.5):
    """Windows that a straight line explains well."""
    ahead = Window.partitionBy("series_id").orderBy("t").rowsBetween(0, size - 1)
    rows = frames(spark, d).select("series_id", "t", F.regr_r2("x", "t").over(ahead).alias("r2"), F.regr_slope("x", "t").over(ahead).alias("slope"), F.count("*").over(ahead).alias("n"))
    return rows.where((F.col("n") == size) & (F.col("r2") >= least)).select("series_id", "t", F.round("slope", 5).alias("slope"))


GRAMS = "g AS (SELECT series_id, t, tag || ',' || lead(tag) OVER o || ',' || lead(tag, 2) OVER o AS gram FROM fr WINDOW o AS (PARTITION BY series_id ORDER BY t))"


def ngrams(rows: DataFrame, n: int = 3) -> DataFrame:
    """series_id, t and gram: n symbols from t on."""
    order = Window.partitionBy("series_id").orderBy("t")
    parts = [F.lead("tag", i).over(order) for i in range(n)]
    last = parts[-1]
    return rows.select("series_id", "t", F.when(last.isNotNull(), F.concat_ws(",", *parts)).alias("gram")).where("gram is not null")


@query("char_counts", "WITH c AS (SELECT unnest(string_split(text, '')) AS ch FROM documents) SELECT ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY ch")
def char_counts(spark, d):
    chars = load(spark, d, "documents").select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''")
    return chars.groupBy("ch").agg(F.count("*").alias("n"))


@query("char_probability", "WITH c AS (SELECT unnest(string_split(text, '')) AS ch FROM documents), n AS (SELECT ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY ch) SELECT ch, round(n / (SELECT sum(n) FROM n), 8) AS p FROM n")
def char_probability(spark, d):
    n = char_counts(spark, d)
    return n.join(F.broadcast(n.agg(F.sum("n").alias("total")))).select("ch", F.round(F.col("n") / F.col("total"), 8).alias("p"))


@query("distinct_alphabet", "WITH c AS (SELECT unnest(string_split(text, '')) AS ch FROM documents) SELECT DISTINCT ch FROM c WHERE ch <> ''")
def distinct_alphabet(spark, d):
    return char_counts(spark, d).select("ch")


@query("ngram_counts", f"WITH {FRAMES}, {GRAMS} SELECT gram, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS p FROM g WHERE gram IS NOT NULL GROUP BY gram")
def ngram_counts(spark, d):
    n = ngrams(frames(spark, d)).groupBy("gram").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("total")))).select("gram", "n", F.round(F.col("n") / F.col("total"), 8).alias("p"))


@query("ngram_likelihood", f"WITH {FRAMES}, {GRAMS}, n AS (SELECT gram, count(*) / sum(count(*)) OVER () AS p FROM g WHERE gram IS NOT NULL GROUP BY gram) SELECT series_id, round(sum(ln(p)), 6) AS ll FROM g JOIN n USING (gram) GROUP BY series_id")
def ngram_likelihood(spark, d):
    """The sum of logarithms of each series' n-gram probabilities."""
    g = ngrams(frames(spark, d))
    n = g.groupBy("gram").agg(F.count("*").alias("n"))
    p = n.join(F.broadcast(n.agg(F.sum("n").alias("total")))).select("gram", F.ln(F.col("n") / F.col("total")).alias("lp"))
    return g.join(p, "gram").groupBy("series_id").agg(_round(F.sum("lp"), "ll"))


@query("symbol_likelihood", f"WITH {FRAMES}, n AS (SELECT tag, count(*) / sum(count(*)) OVER () AS p FROM fr GROUP BY tag) SELECT series_id, round(sum(ln(p)), 6) AS ll FROM fr JOIN n USING (tag) GROUP BY series_id")
def symbol_likelihood(spark, d):
    rows = frames(spark, d)
    n = rows.groupBy("tag").agg(F.count("*").alias("n"))
    p = n.join(F.broadcast(n.agg(F.sum("n").alias("total")))).select("tag", F.ln(F.col("n") / F.col("total")).alias("lp"))
    return rows.groupBy("series_id", "tag").agg(F.count("*").alias("k")).join(p, "tag").groupBy("series_id").agg(_round(F.sum(F.col("k") * F.col("lp")), "ll"))


@query("distinct_tags", "SELECT DISTINCT role AS tag FROM conversations UNION SELECT DISTINCT event_type FROM events")
def distinct_tags(spark, d):
    return load(spark, d, "conversations").select(F.col("role").alias("tag")).union(load(spark, d, "events").select("event_type")).distinct()


BIGRAM = f"WITH {MARKUP}, k AS (SELECT series_id, tag AS tag1, lead(tag) OVER (PARTITION BY series_id ORDER BY start) AS tag2 FROM mk), n AS (SELECT tag1, tag2, count(*) AS n FROM k WHERE tag2 IS NOT NULL AND tag1 <> 'error' AND tag2 <> 'error' GROUP BY ALL)"


@query("bigram", f"{BIGRAM} SELECT tag1, tag2, n, round(n / sum(n) OVER (PARTITION BY tag1), 6) AS p FROM n")
def bigram(spark, d):
    """Counts and row shares of adjacent labels; a label that is left out breaks the chain."""
    order = Window.partitionBy("series_id").orderBy("start")
    pairs = markup(spark, d).select(F.col("tag").alias("tag1"), F.lead("tag").over(order).alias("tag2"))
    n = pairs.where("tag2 is not null and tag1 <> 'error' and tag2 <> 'error'").groupBy("tag1", "tag2").agg(F.count("*").alias("n"))
    return n.withColumn("p", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("tag1")), 6))


@query("role_bigram", "WITH k AS (SELECT conv_id, role AS tag1, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS tag2 FROM conversations), n AS (SELECT tag1, tag2, count(*) AS n FROM k WHERE tag2 IS NOT NULL GROUP BY ALL) SELECT tag1, tag2, n, round(n / sum(n) OVER (PARTITION BY tag1), 6) AS p FROM n")
def role_bigram(spark, d):
    order = Window.partitionBy("conv_id").orderBy("turn")
    pairs = load(spark, d, "conversations").select(F.col("role").alias("tag1"), F.lead("role").over(order).alias("tag2")).where("tag2 is not null")
    n = pairs.groupBy("tag1", "tag2").agg(F.count("*").alias("n"))
    return n.withColumn("p", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("tag1")), 6))


@query("bigram_graph", f"""{BIGRAM}, p AS (SELECT tag1, tag2, round(n / sum(n) OVER (PARTITION BY tag1), 6) AS p FROM n) SELECT tag1, string_agg('"' || tag1 || '" -> "' || tag2 || '";', ' ' ORDER BY tag2) AS edges FROM p WHERE p >= 0.2 GROUP BY tag1""")
def bigram_graph(spark, d):
    """Edges of a graph for Graphviz, those of a share of a fifth or more."""
    line = F.concat(F.lit('"'), "tag1", F.lit('" -> "'), "tag2", F.lit('";'))
    e = bigram(spark, d).where("p >= 0.2").select("tag1", F.struct("tag2", line.alias("line")).alias("e"))
    return e.groupBy("tag1").agg(F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda x: x.line), " ").alias("edges"))


@query("first_difference", f"WITH {FRAMES} SELECT series_id, t, round(x - lag(x) OVER (PARTITION BY series_id ORDER BY t), 6) AS dx FROM fr QUALIFY dx IS NOT NULL")
def first_difference(spark, d):
    order = Window.partitionBy("series_id").orderBy("t")
    return frames(spark, d).select("series_id", "t", F.round(F.col("x") - F.lag("x").over(order), 6).alias("dx")).where("dx is not null")


FALLS = f"WITH {FRAMES}, a AS (SELECT series_id, t, x - lag(x) OVER (PARTITION BY series_id ORDER BY t) AS dx FROM fr), b AS (SELECT *, sum((dx >= 0)::INT) OVER (PARTITION BY series_id ORDER BY t) AS g FROM a WHERE dx IS NOT NULL), c AS (SELECT series_id, t, g, sum(dx) OVER (PARTITION BY series_id, g ORDER BY t) AS fall FROM b WHERE dx < 0)"


@query("negative_runs", f"{FALLS} SELECT series_id, t, round(fall, 6) AS fall FROM c")
def negative_runs(spark, d):
    """Sums of differences, begun again after each that is not negative."""
    order = Window.partitionBy("series_id").orderBy("t")
    a = frames(spark, d).select("series_id", "t", (F.col("x") - F.lag("x").over(order)).alias("dx")).where("dx is not null")
    b = a.withColumn("g", F.sum((F.col("dx") >= 0).cast("int")).over(order)).where("dx < 0")
    return b.select("series_id", "t", _round(F.sum("dx").over(Window.partitionBy("series_id", "g").orderBy("t")), "fall"))


def _smoothed_sql(times: int = 5) -> str:
    names = ["fr", *[f"s{i}" for i in range(times)]]
    return ", ".join(f"{b} AS (SELECT series_id, t, round(avg(x) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS x FROM {a})" for a, b in zip(names, names[1:]))


@query("calc_stop", f"""WITH {FRAMES}, {_smoothed_sql()}, a AS (SELECT series_id, t, round(x - lag(x) OVER (PARTITION BY series_id ORDER BY t), 6) AS dx FROM s4), b AS (SELECT *, sum((dx >= 0)::INT) OVER (PARTITION BY series_id ORDER BY t) AS g FROM a WHERE dx IS NOT NULL),
m AS (SELECT series_id, g, round(sum(dx), 6) AS low FROM b WHERE dx < 0 GROUP BY ALL), k AS (SELECT series_id, g FROM m QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY low, g) = 1)
SELECT b.series_id, ceil(round(sum(t * -dx) / sum(-dx), 6))::BIGINT AS stop FROM b JOIN k USING (series_id, g) WHERE dx < 0 GROUP BY 1""")
def calc_stop(spark, d, times: int = 5):
    """Where a smoothed series falls most: the run of differences with the least sum, and its weighted centre, rounded up."""
    order = Window.partitionBy("series_id").orderBy("t")
    rows = frames(spark, d).select("series_id", "t", "x")
    for _ in range(times):
        rows = rows.withColumn("x", F.round(F.avg("x").over(order.rowsBetween(-2, 2)), 6))
    a = rows.select("series_id", "t", F.round(F.col("x") - F.lag("x").over(order), 6).alias("dx")).where("dx is not null")
    b = a.withColumn("g", F.sum((F.col("dx") >= 0).cast("int")).over(order)).where("dx < 0")
    runs = b.groupBy("series_id", "g").agg(F.round(F.sum("dx"), 6).alias("low"), (F.sum(F.col("t") * -F.col("dx")) / F.sum(-F.col("dx"))).alias("centre"))
    best = F.min_by("centre", F.struct("low", "g"))
    return runs.groupBy("series_id").agg(F.ceil(F.round(best, 6)).alias("stop"))


@query("run_segments", f"WITH {MARKUP} SELECT series_id, tag, start, stop FROM mk WHERE tag <> 'view'")
def run_segments(spark, d):
    """Segments of a path of states, but for the background's."""
    return markup(spark, d).where("tag <> 'view'")


@query("run_lengths", f"WITH {MARKUP} SELECT tag, stop - start AS run, count(*) AS n FROM mk GROUP BY ALL")
def run_lengths(spark, d):
    return markup(spark, d).groupBy("tag", (F.col("stop") - F.col("start")).alias("run")).agg(F.count("*").alias("n"))


@query("top_k_per_series", f"WITH {FRAMES} SELECT series_id, t, x, row_number() OVER (PARTITION BY series_id ORDER BY x, t) AS rank FROM fr QUALIFY rank <= 3")
def top_k_per_series(spark, d, k: int = 3):
    order = Window.partitionBy("series_id").orderBy("x", "t")
    return frames(spark, d).select("series_id", "t", "x", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


@query("worst_frames", f"WITH {FRAMES}, g AS (SELECT avg(x) AS m, var_pop(x) AS v FROM fr) SELECT series_id, t, round(-0.5 * (ln(2 * pi() * v) + (x - m) * (x - m) / v), 6) AS ll FROM fr, g ORDER BY round(-0.5 * (ln(2 * pi() * v) + (x - m) * (x - m) / v), 6), series_id, t LIMIT 50")
def worst_frames(spark, d, n: int = 50):
    """The frames least likely under one Gaussian, a top-n report."""
    rows = frames(spark, d)
    g = rows.agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"))  # one row
    ll = gaussian("x", "m", "v")
    return rows.join(F.broadcast(g)).select("series_id", "t", _round(ll, "ll")).orderBy("ll", "series_id", "t").limit(n)


@query("background_model", f"WITH {FRAMES}, {CODE} SELECT dim, round(avg(x), 6) AS mean, round(5 * var_pop(x), 6) AS var, round(ln(0.2), 6) AS leave FROM v GROUP BY dim")
def background_model(spark, d, widen: float = 5.0):
    """One Gaussian state over all frames with its variance widened."""
    return dims(frames(spark, d)).groupBy("dim").agg(_round(F.avg("x"), "mean"), _round(widen * F.var_pop("x"), "var"), _round(F.ln(F.lit(0.2)), "leave"))


@query("model_selection", f"""WITH {FRAMES}, {CODE}, k AS (SELECT tag, dim, avg(x) AS m, greatest(var_pop(x), 1e-6) AS s FROM v GROUP BY ALL), l AS (SELECT v.tag, count(*) / 3 AS n, sum(-0.5 * (ln(2 * pi() * s) + (x - m) * (x - m) / s)) AS ll FROM v JOIN k USING (tag, dim) GROUP BY v.tag)
SELECT tag, 2 * 3 - 1 AS params, round(2.0 * 5 - 2 * ll, 4) AS aic, round(2.0 * 5 - 2 * ll + 2.0 * 5 * 6 / (n - 6), 4) AS aicc, round(-2 * ll + 5 * ln(n), 4) AS bic, round(-ll + 5.0 / 2 * ln(n), 4) AS mdl FROM l""")
def model_selection(spark, d):
    """AIC, AICc, BIC and MDL of a one-state model for each class; parameters by 2 * states * dims + 2 * states - 3."""
    v = dims(frames(spark, d))
    k = v.groupBy("tag", "dim").agg(F.avg("x").alias("m"), F.greatest(F.var_pop("x"), F.lit(1e-6)).alias("s"))
    one = gaussian("x", "m", "s")
    ll = v.join(k, ["tag", "dim"]).groupBy("tag").agg((F.count("*") / 3).alias("n"), F.sum(one).alias("ll"))
    p = 2 * 1 * 3 + 2 * 1 - 3
    n, ll_ = F.col("n"), F.col("ll")
    return ll.select("tag", F.lit(p).alias("params"), F.round(2.0 * p - 2 * ll_, 4).alias("aic"), F.round(2.0 * p - 2 * ll_ + F.try_divide(F.lit(2.0 * p * (p + 1)), n - p - 1), 4).alias("aicc"), F.round(-2 * ll_ + p * F.ln(n), 4).alias("bic"), F.round(-ll_ + p / 2 * F.ln(n), 4).alias("mdl"))


SPOTS = """cg AS (SELECT tag, avg(x) AS mx, var_pop(x) AS vx, avg(h) AS mh, var_pop(h) AS vh FROM fr GROUP BY tag),
cl AS (SELECT series_id, t, g.tag, round(-0.5 * (ln(2 * pi() * vx) + (x - mx) * (x - mx) / vx) - 0.5 * (ln(2 * pi() * vh) + (h - mh) * (h - mh) / vh), 9) AS ll FROM fr, cg g),
pd AS (SELECT series_id, t, tag FROM cl QUALIFY row_number() OVER (PARTITION BY series_id, t ORDER BY ll DESC, tag) = 1),
pi AS (SELECT series_id, t, tag, t - row_number() OVER (PARTITION BY series_id, tag ORDER BY t) AS g FROM pd), sp AS (SELECT series_id, tag, min(t) AS start, max(t) + 1 AS stop FROM pi GROUP BY series_id, tag, g)"""


def spots(rows: DataFrame) -> DataFrame:
    """Detections to be scored: runs of frames that one class's Gaussian explains best. A class without variance explains none."""
    g = rows.groupBy("tag").agg(F.avg("x").alias("mx"), F.var_pop("x").alias("vx"), F.avg("h").alias("mh"), F.var_pop("h").alias("vh")).withColumnRenamed("tag", "c")  # a row a class
    met = rows.select("series_id", "t", "x", "h").join(F.broadcast(g)).select("series_id", "t", "c", F.round(gaussian("x", "mx", "vx") + gaussian("h", "mh", "vh"), 9).alias("ll"))
    best = met.groupBy("series_id", "t").agg(F.max("ll").alias("top"), F.collect_list(F.struct("ll", "c")).alias("all"))
    tag = F.array_min(F.transform(F.filter("all", lambda r: r.ll == F.col("top")), lambda r: r.c))
    return runs(best.select("series_id", "t", tag.alias("tag")).where("tag is not null"))


MATCHED = f"WITH {MARKUP}, {SPOTS}, m AS (SELECT a.series_id, a.tag AS truth, b.tag AS found, a.start AS a1, a.stop AS a2, b.start AS b1, b.stop AS b2 FROM mk a JOIN sp b ON a.series_id = b.series_id AND a.start < b.stop AND b.start < a.stop)"


def matched(labels: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of a label and a detection that overlap: an equi-join on the series with a range condition."""
    a = labels.select("series_id", F.col("tag").alias("truth"), F.col("start").alias("a1"), F.col("stop").alias("a2"))
    b = found.select("series_id", F.col("tag").alias("found"), F.col("start").alias("b1"), F.col("stop").alias("b2"))
    return a.join(b, "series_id").where("a1 < b2 and b1 < a2")


@query("frame_confusion", f"{MATCHED} SELECT truth, found, sum(least(a2, b2) - greatest(a1, b1))::BIGINT AS frames FROM m GROUP BY ALL")
def frame_confusion(spark, d):
    m = markup(spark, d)
    return matched(m, spots(frames(spark, d))).groupBy("truth", "found").agg(F.sum(F.least("a2", "b2") - F.greatest("a1", "b1")).alias("frames"))


EVENTS = f"""{MATCHED}, h AS (SELECT DISTINCT series_id, truth, a1, b1 FROM m WHERE truth = found AND 2 * (least(a2, b2) - greatest(a1, b1)) >= least(a2 - a1, b2 - b1)),
c AS (SELECT truth AS tag, count(DISTINCT (series_id, a1)) AS correct, count(DISTINCT (series_id, b1)) AS right_spots FROM h GROUP BY 1), n AS (SELECT tag, count(*) AS labels FROM mk GROUP BY 1), s AS (SELECT tag, count(*) AS spots FROM sp GROUP BY 1)"""


@query("event_scores", f"{EVENTS} SELECT tag, coalesce(correct, 0) AS correct, labels - coalesce(correct, 0) AS deleted, coalesce(spots, 0) - coalesce(right_spots, 0) AS inserted, round(coalesce(correct, 0) / labels, 6) AS recall, round(coalesce(right_spots, 0) / spots, 6) AS precision, round((labels - (labels - coalesce(correct, 0)) - (coalesce(spots, 0) - coalesce(right_spots, 0))) / labels, 6) AS accuracy FROM n LEFT JOIN c USING (tag) LEFT JOIN s USING (tag)")
def event_scores(spark, d):
    """Correct, inserted and deleted events of each class: a detection is right if it shares half of the shorter of it and a label of its class. A class that is never detected has no precision."""
    m = markup(spark, d)
    found = spots(frames(spark, d))
    same = matched(m, found).where("truth = found and 2 * (least(a2, b2) - greatest(a1, b1)) >= least(a2 - a1, b2 - b1)")
    hits = same.select(F.col("truth").alias("tag"), "series_id", "a1").distinct().groupBy("tag").agg(F.count("*").alias("correct"))
    right = same.select(F.col("truth").alias("tag"), "series_id", "b1").distinct().groupBy("tag").agg(F.count("*").alias("right_spots"))
    out = m.groupBy("tag").agg(F.count("*").alias("labels"))
    for part in (found.groupBy("tag").agg(F.count("*").alias("spots")), hits, right):
        out = out.join(part, "tag", "left")
    out = out.fillna(0, ["correct", "right_spots"])
    inserted = F.coalesce("spots", F.lit(0)) - F.col("right_spots")
    return out.select("tag", "correct", (F.col("labels") - F.col("correct")).alias("deleted"), inserted.alias("inserted"), F.round(F.col("correct") / F.col("labels"), 6).alias("recall"), F.round(F.col("right_spots") / F.col("spots"), 6).alias("precision"), F.round((F.col("correct") - inserted) / F.col("labels"), 6).alias("accuracy"))


@query("score_distribution", f"WITH {MARKUP}, g AS (SELECT tag, avg(x) AS m, var_pop(x) AS v FROM fr GROUP BY tag), e AS (SELECT k.tag, k.series_id, k.start, avg(-0.5 * (ln(2 * pi() * g.v) + (f.x - g.m) * (f.x - g.m) / g.v)) AS s FROM mk k JOIN fr f ON f.series_id = k.series_id AND f.t >= k.start AND f.t < k.stop JOIN g ON g.tag = k.tag GROUP BY ALL) SELECT tag, count(*) AS n, round(avg(s), 6) AS mean, round(var_samp(s), 6) AS var FROM e GROUP BY tag")
def score_distribution(spark, d):
    """The distribution of each class's length-normalised log-likelihoods over its own examples."""
    rows = frames(spark, d)
    g = rows.groupBy("tag").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    by = Window.partitionBy("series_id", "tag").orderBy("t")
    cut = rows.withColumn("g", F.col("t") - F.row_number().over(by)).join(g, "tag")
    one = gaussian("x", "m", "v")
    e = cut.groupBy("tag", "series_id", "g").agg(F.avg(one).alias("s"))
    return e.groupBy("tag").agg(F.count("*").alias("n"), _round(F.avg("s"), "mean"), _round(F.var_samp("s"), "var"))


@query("lower_tail", f"WITH {FRAMES} SELECT series_id, t, x FROM fr QUALIFY row_number() OVER (ORDER BY x, series_id, t) <= (SELECT round(0.1 * count(*)) FROM fr)")
def lower_tail(spark, d, share: float = 0.1):
    """The smallest tenth of all values. An exact quantile bounds it; only rows that tie with the bound are ordered."""
    rows = frames(spark, d).select("series_id", "t", "x")
    counts = rows.groupBy("x").agg(F.count("*").alias("n"))
    upto = counts.withColumn("bin", F.floor("x"))
    bins = upto.groupBy("bin").agg(F.sum("n").alias("bn"))
    before = F.coalesce(F.sum("bn").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.withColumn("before", before)
    goal = F.round(F.lit(share) * F.sum("bn").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    bins = bins.withColumn("goal", goal).where("before < goal").select("bin", "before", "goal", (F.col("before") + F.col("bn") <= F.col("goal")).alias("whole"))
    near = rows.withColumn("bin", F.floor("x")).join(bins, "bin")
    place = F.col("before") + F.row_number().over(Window.partitionBy("bin").orderBy("x", "series_id", "t"))
    edge = near.where("not whole").withColumn("place", place).where("place <= goal")
    return near.where("whole").select("series_id", "t", "x").union(edge.select("series_id", "t", "x"))


@query("window_symbols", f"WITH {FRAMES}, w AS (SELECT series_id, t AS start, list(tag) OVER o AS q FROM fr WINDOW o AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) SELECT series_id, start, len(list_distinct(q)) AS uniq, list_sum([(q[i] <> q[i + 1])::INT FOR i IN range(1, 8)])::BIGINT AS trans FROM w WHERE len(q) = 8")
def window_symbols(spark, d):
    """Distinct symbols and transitions of each window."""
    w = sliding(frames(spark, d), 8, 1, "tag")
    trans = F.size(F.filter(F.zip_with(F.slice("xs", 1, 7), F.slice("xs", 2, 7), lambda a, b: a != b), lambda x: x))
    return w.select("series_id", "start", F.size(F.array_distinct("xs")).alias("uniq"), trans.cast("long").alias("trans"))
