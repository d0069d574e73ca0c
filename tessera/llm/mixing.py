"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words by its weight; what would pass `cap` times its size is shared again by weight.
A source first takes every document as many whole times as its target divided by its size allows; for the words left
over a Pareto sample is drawn: document i of size s_i gets the chance p_i = min(1, c * m_i), where m_i grows with the
square root of s_i and c is such that the expected words, the sum of p_i * s_i, are the words left; documents are
ranked by the random odds u / (1 - u) divided by the odds p / (1 - p) and taken in that order until the words are
reached. u is a hash of the doc_id, so reruns agree. c comes from counts of documents by size. No source is ever
ordered in one task: a histogram over `BINS` of the ranks gives the bin in which the last taken document lies, and
only that bin is ordered.

Nulls and odd rows: a null source is a source, the last; a null text has size 0 and is never counted; a null doc_id
has the random number of an empty one. Rows that tie in rank and doc_id are taken or left together. An empty table
gives an empty one; other columns pass through, but for one named as our output, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.base import cut, fresh, small, table

SHARE = 1.5
CAP = 2
WEIGHTS = (3, 1, 2)
BINS = 4096
WORD = "[^\\x20\\x09-\\x0D]+"
SEED = "mix"


def _sized(docs: DataFrame, text: str, source: str, seed: str) -> DataFrame:
    """docs with m_size, m_u (from 0 to 1, by the doc_id) and m_weight, a whole number that grows with the root of the size."""
    out = docs.withColumn("m_source", F.col(source)).withColumn("m_id", F.col("doc_id"))
    out = out.withColumn("m_size", F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long"))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13)
    out = out.withColumn("m_u", (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52)))
    return out.withColumn("m_weight", F.floor(F.sqrt(F.col("m_size").cast("double")) * 1024).cast("long"))


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows with m_size, m_u, m_weight, and their source's m_scale and m_limit get m_rank, null where they have no chance, and m_bin, which rises with the rank. Documents larger than m_limit are certain."""
    chance = F.col("m_scale") * F.col("m_weight")
    odds = F.col("m_u") / (1 - F.col("m_u")) * ((1 - chance) / chance)
    rank = F.when(F.col("m_size") > F.col("m_limit"), F.lit(0.0)).when((F.col("m_size") > 0) & (F.col("m_scale") > 0), odds)
    return rows.withColumn("m_rank", rank).withColumn("m_bin", F.floor(F.col("m_rank") / (1 + F.col("m_rank")) * BINS).cast("int"))


def targets(sizes: DataFrame, share: float = SHARE, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sizes (m_source, m_total), a row for each source, with `target`: water-filling in closed form.

    In the order of cap * size / weight the sources that are held at their cap come first; the level of the first
    that is not is everyone's level. The tables here have one row for a source.
    """
    place = Window.orderBy(F.col("m_source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1)
    rows = sizes.withColumn("m_weight", weight.cast("long")).withColumn("m_cap", F.col("m_total") * cap)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("m_all", F.sum("m_total").over(every) * share).withColumn("m_weights", F.sum("m_weight").over(every))
    order = Window.orderBy(F.col("m_cap") / F.col("m_weight"), F.col("m_source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    held, gone = F.coalesce(F.sum("m_cap").over(before), F.lit(0)), F.coalesce(F.sum("m_weight").over(before), F.lit(0))
    rows = rows.withColumn("m_level", (F.col("m_all") - held) / (F.col("m_weights") - gone))
    free = F.when(F.col("m_cap") > F.col("m_level") * F.col("m_weight"), F.col("m_level"))
    rows = rows.withColumn("m_level", F.first(free, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    share_of = F.col("m_level") * F.col("m_weight")
    target = F.when(F.col("m_level").isNull() | (F.col("m_cap") <= share_of), F.col("m_cap").cast("double")).otherwise(share_of)
    return rows.select("m_source", "m_total", target.alias("target"))


def _scales(sizes: DataFrame) -> DataFrame:
    """m_source, m_scale and m_limit: c of each source, and the size above which its documents are certain.

    sizes: m_source, m_size, m_weight, n and m_left, a row for each size of a source. From the largest size down, documents
    are certain for as long as c, which the words still left then give for all others, makes the next one's chance 1.
    """
    up = Window.partitionBy("m_source").orderBy("m_size").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("m_source").orderBy(F.desc("m_size")).rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.withColumn("m_rest", F.sum(F.col("n") * F.col("m_size") * F.col("m_weight")).over(up)).withColumn("m_sure", F.coalesce(F.sum(F.col("n") * F.col("m_size")).over(down), F.lit(0)))
    rows = rows.withColumn("m_scale", (F.col("m_left") - F.col("m_sure")) / F.col("m_rest")).where(F.col("m_scale") * F.col("m_weight") < 1)
    return rows.groupBy("m_source").agg(F.max_by("m_scale", "m_size").alias("m_scale"), F.max("m_size").alias("m_limit"))


def _cuts(sized: DataFrame, share: float, cap: int, weights: tuple[int, ...]) -> DataFrame:
    """A row for each source: its size and target, m_whole copies of every document, its m_scale and m_limit, and the last bin, rank and id that are taken once more."""
    sizes = cut(sized.groupBy("m_source", "m_size", "m_weight").agg(F.count("*").alias("n")))
    totals = targets(sizes.groupBy("m_source").agg(F.sum(F.col("m_size") * F.col("n")).alias("m_total")), share, cap, weights)
    whole = F.when(F.col("m_total") > 0, F.floor(F.col("target") / F.col("m_total"))).otherwise(F.lit(0)).cast("long")
    totals = cut(totals.withColumn("m_whole", whole).withColumn("m_left", F.col("target") - F.col("m_whole") * F.col("m_total")))
    left = small(totals.select(F.col("m_source").alias("t_source"), "m_left"))
    scales = _scales(sizes.where("m_size > 0").join(left, F.col("m_source").eqNullSafe(F.col("t_source"))))
    scales = scales.withColumnRenamed("m_source", "s_source")
    totals = cut(totals.join(scales, F.col("m_source").eqNullSafe(F.col("s_source")), "left").drop("s_source"))
    own = small(totals.select(F.col("m_source").alias("t_source"), "m_scale", "m_limit"))
    ranked = _ranked(sized.join(own, F.col("m_source").eqNullSafe(F.col("t_source")))).drop("t_source", "m_scale", "m_limit")
    bins = cut(ranked.where("m_bin is not null").groupBy("m_source", "m_bin").agg(F.sum("m_size").alias("m_words")))
    upto = Window.partitionBy("m_source").orderBy("m_bin").rowsBetween(Window.unboundedPreceding, -1)
    spread = bins.withColumn("m_before", F.coalesce(F.sum("m_words").over(upto), F.lit(0)))
    spread = spread.withColumnRenamed("m_source", "b_source").join(small(totals), F.col("b_source").eqNullSafe(F.col("m_source")))
    last = spread.where((F.col("m_before") <= F.col("m_left")) & (F.col("m_left") < F.col("m_before") + F.col("m_words")))
    last = cut(last.select(F.col("m_source").alias("b_source"), F.col("m_bin").alias("b_bin"), "m_before", "m_left"))
    met = ranked.join(small(last), F.col("m_source").eqNullSafe(F.col("b_source")) & (F.col("m_bin") == F.col("b_bin")))
    tied = met.groupBy("b_source", "b_bin", "m_before", "m_left", "m_rank", "m_id").agg(F.sum("m_size").alias("m_size"))
    running = Window.partitionBy("b_source").orderBy("m_rank", "m_id").rowsBetween(Window.unboundedPreceding, 0)
    tied = tied.withColumn("m_sum", F.col("m_before") + F.sum("m_size").over(running))
    taken = tied.where(F.col("m_sum") - F.col("m_size") / 2 <= F.col("m_left"))
    taken = taken.groupBy("b_source").agg(F.max(F.struct("m_rank", F.coalesce("m_id", F.lit(-(2**63))).alias("m_id"))).alias("m_last"))
    cuts = totals.join(last.select("b_source", "b_bin"), F.col("m_source").eqNullSafe(F.col("b_source")), "left").drop("b_source")
    cuts = cuts.join(taken, F.col("m_source").eqNullSafe(F.col("b_source")), "left")
    bin_ = F.coalesce("b_bin", F.when(F.col("m_left") > 0, F.lit(BINS)).otherwise(F.lit(-1)))
    return cut(cuts.select(F.col("m_source").alias("c_source"), "m_total", "target", "m_whole", "m_scale", "m_limit", bin_.alias("c_bin"), "m_last"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", share: float = SHARE, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS, out: str = "mixed", seed: str = SEED) -> DataFrame:
    """docs with a struct column `out`: size, source_size, target and copies, the times that the document is taken."""
    columns = [c for c in docs.columns if c != out]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("m_row"), "doc_id", F.col(text).alias("m_text"), F.col(source).alias("m_from"))
    sized = _sized(own, "m_text", "m_from", seed)
    cuts = small(_cuts(cut(sized.select("m_source", "m_id", "m_size", "m_u", "m_weight")), share, cap, weights))
    met = _ranked(sized.join(cuts, F.col("m_source").eqNullSafe(F.col("c_source"))))
    place = F.struct("m_rank", F.coalesce("m_id", F.lit(-(2**63))).alias("m_id"))
    chosen = (F.col("m_bin") < F.col("c_bin")) | ((F.col("m_bin") == F.col("c_bin")) & (place <= F.col("m_last")))
    copies = F.col("m_whole") + F.coalesce(chosen, F.lit(False)).cast("long")
    parts = F.struct(F.col("m_size").alias("size"), F.col("m_total").alias("source_size"), "target", copies.alias("copies"))
    return met.select(*[F.col("m_row").getField(c).alias(c) for c in columns], parts.alias(out))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "mixed.size", "mixed.source_size", "mixed.target", (F.col("mixed.size") * F.col("mixed.copies")).alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    out = fresh(docs, "mixed")
    mixed = mix(docs, out=out).where(f"{out}.copies > 0")
    return mixed.withColumn(out, F.explode(F.sequence(F.lit(1), F.col(f"{out}.copies")))).select(*[f"`{c}`" for c in docs.columns])


#: DuckDB SQL for op1_mixing.
ORACLE = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
a AS (SELECT *, 2 * total AS most, 1.5::DOUBLE * (sum(total) OVER ())::BIGINT AS goal, (sum(weight) OVER ())::BIGINT AS weights FROM w),
l AS (SELECT *, (goal - coalesce((sum(most) OVER o)::BIGINT, 0)) / (weights - coalesce((sum(weight) OVER o)::BIGINT, 0)) AS lev FROM a
    WINDOW o AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(lev, most / weight) AS lev FROM l WHERE most > lev * weight),
t AS (SELECT l.source, l.total, CASE WHEN f.lev IS NULL OR most <= f.lev * weight THEN most::DOUBLE ELSE f.lev * weight END AS target FROM l, f),
c AS (SELECT *, CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END::BIGINT AS whole FROM t),
z AS (SELECT source, size, floor(sqrt(size::DOUBLE) * 1024)::BIGINT AS m, count(*) AS n FROM d WHERE size > 0 GROUP BY ALL),
y AS (SELECT z.*, c.target - c.whole * c.total AS rest, (sum(n * size * m) OVER (PARTITION BY z.source ORDER BY size))::BIGINT AS under, coalesce((sum(n * size) OVER (PARTITION BY z.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) AS sure FROM z JOIN c ON z.source IS NOT DISTINCT FROM c.source),
k AS (SELECT source, arg_max(scale, size) AS scale, max(size) AS lim FROM (SELECT *, (rest - sure) / under AS scale FROM y) WHERE scale * m < 1 GROUP BY source),
r AS (SELECT d.*, CASE WHEN size > lim THEN 0 WHEN size > 0 AND scale > 0 THEN u / (1 - u) * ((1 - scale * floor(sqrt(size::DOUBLE) * 1024)) / (scale * floor(sqrt(size::DOUBLE) * 1024))) END AS q FROM d LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source),
x AS (SELECT r.*, c.total, c.target, c.whole, c.target - c.whole * c.total AS rest,
    sum(size) OVER (PARTITION BY r.source ORDER BY q NULLS LAST, doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
    FROM r JOIN c ON r.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, total AS source_size, target, size * (whole + CASE WHEN q IS NOT NULL AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END) AS taken FROM x
"""
