"""Readers and writers of line-based formats of series, neighbours, motifs, patterns and labels, as DataFrames of lines.

Files are read and written by Spark alone, so any file system will do. A file whose lines depend on lines before them
(motifs, patterns) is read whole, as one row; such a file describes motifs, not data.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.catalog import FRAMES, MARKUP, query
from tessera.sources.frames import frames, markup, series


def _lines() -> Column:
    return F.split(F.regexp_replace("value", "\\s+$", ""), "\\r?\\n")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """file, t, x (array): a frame a line, values between blanks; path may be a pattern. t is the line's number in its file.

    Files are read whole, a series each, so that lines keep their order.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(_lines()).alias("t", "line"))
    return whole.where(F.trim("line") != "").select("file", "t", F.transform(F.split(F.trim("line"), "\\s+"), lambda v: v.cast("double")).alias("x"))


def write_raw(rows: DataFrame, path: str, value: str = "x") -> None:
    """A folder for each series, with a text file of its frames in order."""
    s = series(rows, value)
    lines = F.array_join(F.transform("xs", lambda v: F.format_string("%.2f", v)), "\n")
    s.select("series_id", lines.alias("value")).write.partitionBy("series_id").text(path)


def read_neighbours(spark: SparkSession, path: str) -> DataFrame:
    """win_id, rank, nbr_id, dist from a file with a header line and then a line of (index distance) pairs a window."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(_lines()).alias("n", "line")).where("n > 0")
    parts = lines.select((F.col("n") - 1).cast("long").alias("win_id"), F.split(F.trim("line"), "\\s+").alias("p"))
    pairs = parts.select("win_id", "p", F.explode(F.sequence(F.lit(0), F.floor(F.size("p") / 2).cast("int") - 1)).alias("k"))
    return pairs.select("win_id", (F.col("k") + 1).alias("rank"), F.get("p", F.col("k") * 2).cast("long").alias("nbr_id"), F.get("p", F.col("k") * 2 + 1).cast("double").alias("dist"))


def neighbour_lines(knn: DataFrame) -> DataFrame:
    """win_id and line, the pairs of its neighbours in order of rank."""
    pairs = F.sort_array(F.collect_list(F.struct("rank", F.concat_ws(" ", F.col("nbr_id").cast("string"), F.format_string("%.6f", "dist")).alias("p"))))
    return knn.groupBy("win_id").agg(F.array_join(F.transform(pairs, lambda r: r.p), " ").alias("line"))


def neighbour_header(spark: SparkSession, path: str) -> dict[str, int]:
    """The header of a file of neighbours: n, k, low, high and step, or n, k, size and step where all windows have one length."""
    line = spark.read.text(path, wholetext=True).select(_lines().alias("l")).select(F.get("l", F.lit(0))).first()[0]
    values = [int(float(x)) for x in line.split()]
    return dict(zip(("n", "k", "low", "high", "step") if len(values) == 5 else ("n", "k", "size", "step"), values))


#: A text file of neighbours is of one row; more windows are written as Parquet.
LINES_AT_MOST = 1_000_000


def write_neighbours(knn: DataFrame, path: str, *sizes: int) -> None:
    """One text file: a header of the number of windows, that of neighbours and the sizes given, then a line a window. Windows are numbered from 0 without gaps."""
    n = knn.agg(F.countDistinct("win_id"), F.max("rank")).first()
    if n[0] > LINES_AT_MOST:
        raise ValueError(f"over {LINES_AT_MOST} windows; write them as Parquet")
    head = " ".join(map(str, (n[0], n[1] or 0, *sizes)))
    lines = neighbour_lines(knn).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("win_id", "line"))), lambda r: r.line), "\n").alias("l"))
    lines.select(F.concat(F.lit(head + "\n"), "l").alias("value")).coalesce(1).write.text(path)


def read_motifs(spark: SparkSession, path: str) -> DataFrame:
    """motif_id, hash, n_fixed, mdl, series_id, start, len: a count; for each motif a line of hash, fixed count, occurrences and mdl, then a line an occurrence."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(_lines()).alias("n", "line")).where("n > 0")
    by = Window.partitionBy("file").orderBy("n")
    parts = lines.withColumn("p", F.split(F.trim("line"), "\\s+")).withColumn("head", (F.size("p") == 4).cast("int"))
    parts = parts.withColumn("motif_id", F.sum("head").over(by) - 1)
    keep = lambda i, kind: F.last(F.when(F.col("head") == 1, F.get("p", F.lit(i)).cast(kind)), ignorenulls=True).over(by)
    parts = parts.select("*", keep(0, "string").alias("hash"), keep(1, "int").alias("n_fixed"), keep(3, "double").alias("mdl"))
    return parts.where("head = 0").select("motif_id", "hash", "n_fixed", "mdl", *[F.get("p", F.lit(i)).cast("int").alias(n) for i, n in enumerate(("series_id", "start", "len"))])


def motif_lines(motifs: DataFrame) -> DataFrame:
    """motif_id and text, the lines of each motif in the form that read_motifs reads."""
    occs = F.sort_array(F.collect_list(F.struct("series_id", "start", "len")))
    g = motifs.groupBy("motif_id", "hash", "n_fixed", "mdl").agg(occs.alias("o"))
    head = F.concat_ws(" ", "hash", F.col("n_fixed").cast("string"), F.size("o").cast("string"), F.format_string("%.6f", "mdl"))
    rows = F.transform("o", lambda r: F.concat_ws(" ", r.series_id.cast("string"), r.start.cast("string"), r.len.cast("string")))
    return g.select("motif_id", F.array_join(F.concat(F.array(head), rows), "\n").alias("text"))


def write_motifs(motifs: DataFrame, path: str) -> None:
    """One text file of all motifs; motifs are few, their count is checked."""
    n = motifs.select("motif_id").distinct().count()
    if n > 1_000_000:
        raise ValueError("over a million motifs; write them as Parquet")
    text = motif_lines(motifs).agg(F.concat(F.lit(f"{n}\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("motif_id", "text"))), lambda r: r.text), "\n")).alias("value"))
    text.coalesce(1).write.text(path)


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """pattern_id, series_id, start, len: `*` begins a comment, a line `pattern` a new pattern."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(_lines()).alias("n", "line"))
    lines = lines.where("trim(line) <> '' and not startswith(trim(line), '*')")
    head = F.startswith(F.lower(F.trim("line")), F.lit("pattern")).cast("int")
    p = lines.withColumn("head", head).withColumn("pattern_id", F.sum("head").over(Window.partitionBy("file").orderBy("n")) - 1).where("head = 0")
    part = F.split(F.trim("line"), "\\s+")
    return p.select("pattern_id", *[F.get(part, F.lit(i)).cast("int").alias(n) for i, n in enumerate(("series_id", "start", "len"))])


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """file, tag, start, stop: lines of a quoted tag and two numbers."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value")
    part = '^\\s*"([^"]*)"\\s+(\\d+)\\s+(\\d+)'
    got = lines.where(F.col("value").rlike(part))
    return got.select("file", F.regexp_extract("value", part, 1).alias("tag"), F.regexp_extract("value", part, 2).cast("int").alias("start"), F.regexp_extract("value", part, 3).cast("int").alias("stop"))


def label_lines(labels: DataFrame) -> DataFrame:
    return labels.select("series_id", F.format_string('"%s" %d %d', "tag", "start", "stop").alias("line"))


def write_labels(labels: DataFrame, path: str) -> None:
    """A folder for each series, with its labels in order."""
    rows = F.sort_array(F.collect_list(F.struct("start", F.format_string('"%s" %d %d', "tag", "start", "stop").alias("line"))))
    labels.groupBy("series_id").agg(F.array_join(F.transform(rows, lambda r: r.line), "\n").alias("value")).write.partitionBy("series_id").text(path)


def write_cuts(spans: DataFrame, path: str) -> None:
    """The pieces (series_id, a, b) that series were cut into, lines of a quoted series, first and last frame."""
    spans.select(F.format_string('"%s" %d %d', F.col("series_id").cast("string"), "a", "b").alias("value")).write.text(path)


def definition(entries: list[dict[str, str]]) -> str:
    """The text of a definition: a block of names and values for each entry."""
    return "\n\n".join("\n".join(["<data>", *[f"{k} = {v}" for k, v in e.items()], "</data>"]) for e in entries) + "\n"


def looped_definition(entry: dict[str, str], n: int) -> str:
    """The text of a definition of n series by one block in a loop: `i` in brackets and behind a dollar stands for their number."""
    return "\n".join([f"!(for,i,1,1,{n})", "<data>", *[f"{k} = {v}" for k, v in entry.items()], "</data>", "!(endfor)"]) + "\n"


def read_definition(spark: SparkSession, path: str) -> list[dict[str, str]]:
    """The entries of a definition file, its loops (first, step, last) unrolled and comments left out. It describes data sets and is as small as their list."""
    lines = [x.split("#")[0].strip() for x in spark.read.text(path, wholetext=True).first()[0].splitlines()]

    def unrolled(lines: list[str]) -> list[str]:
        out, at = [], 0
        while at < len(lines):
            if loop := re.fullmatch(r"!\(for,(\w+),(-?\d+),(-?\d+),(-?\d+)\)", lines[at]):
                end, depth = at + 1, 1
                while depth:
                    depth += lines[end].startswith("!(for,") - (lines[end] == "!(endfor)")
                    end += 1
                body, (name, first, step, last) = lines[at + 1 : end - 1], loop.groups()
                for i in range(int(first), int(last) + 1, int(step)):
                    out += unrolled([x.replace(f"$({name})", str(i)) for x in body])
                at = end
            else:
                out.append(lines[at])
                at += 1
        return out

    entries: list[dict[str, str]] = []
    for line in unrolled(lines):
        if line == "<data>":
            entries.append({})
        elif "=" in line and entries:
            key, value = line.split("=", 1)
            entries[-1][key.strip()] = value.strip()
    return entries


def write_dataset(rows: DataFrame, labels: DataFrame, path: str, name: str = "set", value: str = "x") -> None:
    """A data set as folders of text: raw series, their labels, and a looped definition of both for series numbered from 1."""
    write_raw(rows, f"{path}/raw", value)
    write_labels(labels, f"{path}/labels")
    n = rows.agg(F.countDistinct("series_id")).first()[0]
    entry = {"name": f"{name}_$(i)", "data": "raw/series_id=$(i)", "dataLoader": "DLRaw", "labels": "labels/series_id=$(i)", "labelLoader": "MLGeneral"}
    rows.sparkSession.range(1).select(F.lit(looped_definition(entry, n)).alias("value")).coalesce(1).write.text(f"{path}/def")


def read_indices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").cast("long").alias("win_id"))


def read_with(spark: SparkSession, form: str, path: str, *transforms, **options) -> DataFrame:
    """Any format that Spark knows by name, through a chain of functions of DataFrames."""
    df = spark.read.format(form).options(**options).load(path)
    for t in transforms:
        df = df.transform(t)
    return df


@query("label_lines", f"""WITH {MARKUP} SELECT series_id, '"' || tag || '" ' || start || ' ' || stop AS line FROM mk""")
def label_lines_query(spark, d):
    return label_lines(markup(spark, d))


@query("raw_lines", f"WITH {FRAMES} SELECT series_id, string_agg(format('{{:.2f}}', x), ' ' ORDER BY t) AS line FROM fr GROUP BY series_id")
def raw_lines(spark, d):
    """Each series as a line of its values."""
    return series(frames(spark, d)).select("series_id", F.array_join(F.transform("xs", lambda v: F.format_string("%.2f", v)), " ").alias("line"))


@query("pattern_rows", f"""WITH {MARKUP} SELECT series_id + 1 AS series, '"A"' AS tag, start + 1 AS first, stop + 1 AS last FROM mk WHERE tag = 'click'""")
def pattern_rows(spark, d):
    """Occurrences as rows of a report, numbered from one; the end is start, length and one."""
    return markup(spark, d).where("tag = 'click'").select((F.col("series_id") + 1).alias("series"), F.lit('"A"').alias("tag"), (F.col("start") + 1).alias("first"), (F.col("stop") + 1).alias("last"))
