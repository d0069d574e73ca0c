"""URL filters: a sort-merge range join of reversed-host keys with rules, by a sweep over sorted rows.

A host's labels, reversed and each ended by a dot, make its key (`a.b.com` is `com.b.a.`), so that a rule's host and
all its subdomains are one interval of keys, and intervals nest or lie apart. Each interval's start is a row that
carries the stack of rules then active, from the outermost to itself; its end is a row with the stack without it.
These rows and the urls are sorted by key together, and each url takes the last stack before it. Of the rules on the
stack whose path its own begins with, the longest wins.

Urls are dealt to slices by a hash of the row, never by host, so a hot host is spread evenly; every slice sweeps its
own copy of the rule rows, so these cost rules x slices. Only DataFrame functions are used.

Nulls and odd rows: a null url, or one without ://, has an empty host and path and no rule; rules with a null are
left out, and of equal rules with different verdicts block wins. Repeated rows get equal verdicts. An empty table of
rules or urls gives no rule or no rows. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.base import partitions, table

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.", -1)), "."), F.lit("."))


def _parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, CAPITALS, CAPITALS.lower()), path


def _boundaries(rules: DataFrame) -> DataFrame:
    """Two rows for each host of the rules: b_key, and b_stack, the rules that are active from there on."""
    rules = rules.where("host is not null and path is not null and verdict is not null")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.select(F.translate("host", CAPITALS, CAPITALS.lower()).alias("host"), F.struct(F.concat("host", "path").alias("rule"), "path", F.length("host").alias("size"), "verdict").alias("r"))
    own = rules.groupBy("host").agg(F.sort_array(F.collect_list("r")).alias("own"))
    labels = own.withColumn("labels", F.split("host", "\\.", -1))
    outer = labels.select("host", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))).alias("depth", "above"))
    held = outer.join(own.select(F.col("host").alias("above"), "own"), "above")
    stacks = held.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("depth", "own")), asc=False).alias("s"))
    whole = F.flatten(F.transform("s", lambda x: x.own))
    without = F.flatten(F.transform(F.filter("s", lambda x: x.depth > 0), lambda x: x.own))
    key = _key(F.col("host"))
    end = F.concat(F.regexp_replace(key, "\\.$", ""), F.lit("/"))  # the first key after all that begin with `key`
    both = F.array(F.struct(key.alias("b_key"), whole.alias("b_stack")), F.struct(end.alias("b_key"), without.alias("b_stack")))
    return stacks.select(F.inline(both))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", slices: int | None = None, out: str = "judged") -> DataFrame:
    """pages with a struct column `out`: host, path, rule (null where none fits) and verdict. rules: host, path, verdict."""
    slices = slices or 2 * partitions(pages)
    columns = [c for c in pages.columns if c != out]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("u_row"), *[c.alias(n) for c, n in zip(_parts(F.col(url)), ("u_host", "u_path"))])
    rows = rows.withColumn("u_key", F.when(F.col("u_host") == "", F.lit("")).otherwise(_key(F.col("u_host"))))
    own = [F.col("u_row").getField(c) for c, kind in pages.dtypes if c in columns and "map<" not in kind and "variant" not in kind]  # of equal urls too, rows of other ids go to other slices
    rows = rows.withColumn("u_slice", F.pmod(F.xxhash64(*own), F.lit(slices)))
    marks = _boundaries(rules).withColumn("u_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    sweep = rows.select("*", F.lit(1).alias("u_kind")).unionByName(marks.select(F.col("b_key").alias("u_key"), "b_stack", "u_slice", F.lit(0).alias("u_kind")), allowMissingColumns=True)
    order = Window.partitionBy("u_slice").orderBy("u_key", "u_kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = sweep.withColumn("u_stack", F.last("b_stack", ignorenulls=True).over(order)).where("u_kind = 1")
    fits = F.filter("u_stack", lambda r: F.startswith(F.col("u_path"), r.path))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r.rule).alias("n"), r.size.alias("size"), r.rule.alias("rule"), r.verdict.alias("verdict"))))
    swept = swept.withColumn("u_best", best)
    verdict = F.coalesce(F.col("u_best.verdict"), F.lit(default))
    return swept.select(*[F.col("u_row").getField(c).alias(c) for c in columns], F.struct(F.col("u_host").alias("host"), F.col("u_path").alias("path"), F.col("u_best.rule").alias("rule"), verdict.alias("verdict")).alias(out))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, ("host", "path", "verdict"))]) for r in RULES])))
    judged = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


#: DuckDB SQL for op3_urls.
ORACLE = """
WITH r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
x AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE url[strpos(url, '://') + 3:] END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM x)
SELECT page_id, host, path, (SELECT arg_max(h || p, length(h || p)) FROM r WHERE (host = h OR suffix(host, '.' || h)) AND prefix(path, p)) AS rule,
    coalesce((SELECT arg_max(v, length(h || p)) FROM r WHERE (host = h OR suffix(host, '.' || h)) AND prefix(path, p)), 'allow') AS verdict FROM u
"""
