"""SAX words, random projection, run-length strings, substring statistics and description lengths."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.catalog import FRAMES, MARKUP, query
from tessera.functions.vectors import paa, symbol, total
from tessera.operators.spans import complement, of_tag, whole
from tessera.operators.windows import WINDOW8, sliding
from tessera.sources.frames import frames, markup, runs, series, symbols

PARTS, ALPHABET = 4, 4


def sax(rows: DataFrame, size: int = 8, parts: int = PARTS, n: int = ALPHABET, step: int = 1, value: str = "x") -> DataFrame:
    """series_id, start and word: symbols of the means of each window's parts, after each window is normalised."""
    w = sliding(rows, size, step, value)
    w = w.withColumn("m", total(F.col("xs")) / size)
    w = w.withColumn("sd", F.sqrt(F.aggregate("xs", F.lit(0.0), lambda a, x: a + (x - F.col("m")) * (x - F.col("m"))) / (size - 1)))
    w = w.withColumn("p", paa(F.col("xs"), size, parts))
    z = F.transform("p", lambda x: F.when(F.col("sd") > 0, (x - F.col("m")) / F.col("sd")).otherwise(F.lit(0.0)))
    return w.select("series_id", "start", F.array_join(F.transform(z, lambda v: F.chr(symbol(v, n) + 97)), "").alias("word"))


SAX = f"""{WINDOW8}, wm AS (SELECT series_id, start, xs, list_sum(xs) / 8 AS m FROM w8 WHERE len(xs) = 8), ws AS (SELECT *, sqrt(list_sum([(x - m) * (x - m) FOR x IN xs]) / 7) AS sd FROM wm),
wp AS (SELECT series_id, start, [CASE WHEN sd > 0 THEN ((xs[2 * i + 1] + xs[2 * i + 2]) / 2 - m) / sd ELSE 0 END FOR i IN range(4)] AS z FROM ws),
sx AS (SELECT series_id, start, list_reduce([chr(97 + (v >= -0.6745)::INT + (v >= 0)::INT + (v >= 0.6745)::INT) FOR v IN z], lambda a, b: a || b) AS word FROM wp)"""


@query("sax_words", f"WITH {FRAMES}, {SAX} SELECT word, count(*) AS n FROM sx GROUP BY word HAVING count(*) > 1")
def sax_words(spark, d):
    """The flagship: words that occur more than once."""
    return sax(frames(spark, d)).groupBy("word").agg(F.count("*").alias("n")).where("n > 1")


@query("sax_positions", f"WITH {FRAMES}, {SAX} SELECT series_id, start, word, count(*) OVER (PARTITION BY word) AS n FROM sx")
def sax_positions(spark, d):
    """Where each word occurs, and how often; counts are joined, so a frequent word is not gathered in one task."""
    s = sax(frames(spark, d))
    n = s.groupBy("word").agg(F.count("*").alias("n"))
    return s.join(n, "word").select("series_id", "start", "word", "n")


@query("exact_pairs", f"WITH {FRAMES}, {SAX} SELECT count(*) AS words, sum(n * (n - 1) // 2)::BIGINT AS pairs FROM (SELECT word, count(*)::BIGINT AS n FROM sx GROUP BY word HAVING count(*) > 1)")
def exact_pairs(spark, d):
    n = sax_words(spark, d)
    return n.agg(F.count("*").alias("words"), F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")).alias("pairs"))


#: A choice of columns is taken if it makes no more than this share of all pairs collide.
MOST_PAIRS = 0.02


def projected(words: DataFrame, parts: int = PARTS, columns: int = 2) -> DataFrame:
    """words with a row for each choice of columns: `round` and `key`, the letters that the round keeps."""
    keys = [F.struct(F.lit(i).alias("round"), F.concat(*[F.substring("word", c + 1, 1) for c in cols]).alias("key")) for i, cols in enumerate(combinations(range(parts), columns))]
    return words.select("*", F.inline(F.array(*keys)))


def word_counts(words: DataFrame) -> DataFrame:
    return words.groupBy("word").agg(F.count("*").alias("n"))


def guard(counts: DataFrame, parts: int = PARTS) -> DataFrame:
    """columns, pairs and share for each number of columns: of all pairs of windows, those that would collide in a round, from the counts of words alone."""
    out = None
    for columns in range(2, parts + 1):
        n = projected(counts, parts, columns).groupBy("round", "key").agg(F.sum("n").alias("n"))
        per = n.groupBy("round").agg(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")).alias("pairs"), F.sum("n").alias("k"))
        part = per.agg(F.max("pairs").alias("pairs"), F.max(F.try_divide("pairs", F.col("k") * (F.col("k") - 1) / 2)).alias("share")).withColumn("columns", F.lit(columns))
        out = part if out is None else out.unionByName(part)
    return out


def guarded_columns(counts: DataFrame, parts: int = PARTS, most: float = MOST_PAIRS) -> int:
    """The least number of columns whose worst round keeps within the limit; all of them if none does."""
    found = guard(counts, parts).where(F.col("share") <= most).agg(F.min("columns")).first()[0]
    return found or parts


PROJECTED = f"{SAX}, rd(round, i, j) AS (VALUES (0, 1, 2), (1, 1, 3), (2, 1, 4), (3, 2, 3), (4, 2, 4), (5, 3, 4)), pk AS (SELECT series_id, start, word, round, substr(word, i, 1) || substr(word, j, 1) AS key FROM sx, rd)"
GUARD = f"""WITH {FRAMES}, {SAX}, cs(columns, round, ix) AS (VALUES (2, 0, [1, 2]), (2, 1, [1, 3]), (2, 2, [1, 4]), (2, 3, [2, 3]), (2, 4, [2, 4]), (2, 5, [3, 4]), (3, 0, [1, 2, 3]), (3, 1, [1, 2, 4]), (3, 2, [1, 3, 4]), (3, 3, [2, 3, 4]), (4, 0, [1, 2, 3, 4])),
b AS (SELECT columns, round, array_to_string([substr(word, i, 1) FOR i IN ix], '') AS key, count(*)::BIGINT AS n FROM sx, cs GROUP BY ALL), t AS (SELECT columns, round, sum(n * (n - 1) // 2)::BIGINT AS pairs, sum(n * (n - 1) // 2) / (sum(n) * (sum(n) - 1) / 2) AS share FROM b GROUP BY ALL)"""


@query("collision_guard", f"{GUARD} SELECT columns::INT AS columns, max(pairs) AS pairs, round(max(share), 6) AS share, max(share) <= {MOST_PAIRS} AND columns = (SELECT min(columns) FROM (SELECT columns FROM t GROUP BY 1 HAVING max(share) <= {MOST_PAIRS})) AS used FROM t GROUP BY columns")
def collision_guard(spark, d):
    """Pairs that the worst round would make, before any is made: where they pass the limit, more columns are kept, and the first number within it is used."""
    counts = word_counts(sax(frames(spark, d)))
    used = guarded_columns(counts)
    return guard(counts).select("columns", "pairs", F.round("share", 6).alias("share"), (F.col("columns") == used).alias("used"))


def row_sums(words: DataFrame, columns: int = 2) -> DataFrame:
    """words (series_id, start, word) with `hits`: collisions of each window with all others of all series, from the counts of words."""
    p = projected(word_counts(words), columns=columns)
    n = p.groupBy("round", "key").agg(F.sum("n").alias("in_key"))
    hits = p.join(n, ["round", "key"]).groupBy("word").agg(F.sum(F.col("in_key") - 1).alias("hits"))
    return words.join(hits, "word")


@query("collision_rowsums", f"WITH {FRAMES}, {PROJECTED}, b AS (SELECT round, key, count(*) AS n FROM pk GROUP BY ALL) SELECT series_id, start, sum(n - 1)::BIGINT AS hits FROM pk JOIN b USING (round, key) GROUP BY ALL")
def collision_rowsums(spark, d):
    """Collisions of each window with all others, with no pair made."""
    return row_sums(sax(frames(spark, d))).select("series_id", "start", "hits")


@query("best_row", f"WITH {FRAMES}, {PROJECTED}, b AS (SELECT round, key, count(*) AS n FROM pk GROUP BY ALL), r AS (SELECT series_id, start, sum(n - 1)::BIGINT AS hits FROM pk JOIN b USING (round, key) GROUP BY ALL) SELECT series_id, start, hits FROM r WHERE hits >= 2 ORDER BY hits DESC, series_id, start LIMIT 1")
def best_row(spark, d):
    return collision_rowsums(spark, d).where("hits >= 2").orderBy(F.desc("hits"), "series_id", "start").limit(1)


def word_collisions(counts: DataFrame, columns: int = 2) -> DataFrame:
    """Pairs of words (word1 <= word2) with hits, the rounds in which they collide, and the windows n1 and n2 of each.

    There are as many rows as pairs of words, of which an alphabet and a length allow few, whatever the number of windows.
    """
    p = projected(counts, columns=columns)
    a, b = (p.select("round", "key", F.col("word").alias(f"word{i}"), F.col("n").alias(f"n{i}")) for i in (1, 2))
    return a.join(b, ["round", "key"]).where("word1 <= word2").groupBy("word1", "word2", "n1", "n2").agg(F.count("*").alias("hits"))


@query("collision_pairs", f"WITH {FRAMES}, {PROJECTED}, wn AS (SELECT word, count(*) AS n FROM sx GROUP BY 1), kw AS (SELECT DISTINCT word, round, key FROM pk) SELECT x.word AS word1, y.word AS word2, a.n AS n1, b.n AS n2, count(*) AS hits FROM kw x JOIN kw y ON x.round = y.round AND x.key = y.key AND x.word <= y.word JOIN wn a ON a.word = x.word JOIN wn b ON b.word = y.word GROUP BY ALL")
def collision_pairs(spark, d):
    """Collisions of all windows of all series, as pairs of words: each stands for n1 * n2 pairs of windows."""
    return word_collisions(word_counts(sax(frames(spark, d))))


def top_collision(words: DataFrame, size: int = 8, columns: int = 2) -> DataFrame:
    """One row (series1, start1, series2, start2, hits): the pair of windows with most hits that do not overlap, the first by series and start.

    A window is barred by 2 * size - 1 others at most, itself among them, so the first 2 * size of each word hold the pair.
    """
    pairs = word_collisions(word_counts(words), columns)
    order = Window.partitionBy("word").orderBy("series_id", "start")
    first = words.withColumn("k", F.row_number().over(order)).where(F.col("k") <= 2 * size)
    one = first.select(F.col("word").alias("word1"), F.struct("series_id", "start").alias("w1"))
    two = first.select(F.col("word").alias("word2"), F.struct("series_id", "start").alias("w2"))
    levels = [r["hits"] for r in pairs.select("hits").distinct().orderBy(F.desc("hits")).collect()]  # at most one a round
    best = None
    for hits in levels:
        met = pairs.where(F.col("hits") == hits).select("word1", "word2", "hits").join(one, "word1").join(two, "word2")
        met = met.where("w1 <> w2 and (w1.series_id <> w2.series_id or abs(w1.start - w2.start) >= %d)" % size)
        met = met.select("hits", F.least("w1", "w2").alias("a"), F.greatest("w1", "w2").alias("b")).groupBy("hits").agg(F.min(F.struct("a", "b")).alias("p"))
        best = met.select(F.col("p.a.series_id").alias("series1"), F.col("p.a.start").alias("start1"), F.col("p.b.series_id").alias("series2"), F.col("p.b.start").alias("start2"), "hits")
        if not best.isEmpty():
            break
    return best if best is not None else words.limit(0).select(F.col("series_id").alias("series1"), F.col("start").alias("start1"), F.col("series_id").alias("series2"), F.col("start").alias("start2"), F.lit(0).cast("long").alias("hits"))


@query("best_collision", f"WITH {FRAMES}, {PROJECTED} SELECT x.series_id AS series1, x.start AS start1, y.series_id AS series2, y.start AS start2, count(*) AS hits FROM pk x JOIN pk y ON x.round = y.round AND x.key = y.key AND (x.series_id < y.series_id OR (x.series_id = y.series_id AND x.start <= y.start - 8)) GROUP BY ALL ORDER BY hits DESC, series1, start1, series2, start2 LIMIT 1")
def best_collision(spark, d):
    """The pair with most hits that is no trivial match."""
    return top_collision(sax(frames(spark, d)))


def expected_collisions(k: Column, size: int, alphabet: int, rounds: int, differ: int) -> Column:
    """Chiu's expected collisions among k words: over 0 to `differ` differing letters, chances that a round misses them."""
    out = 0.0
    for i in range(differ + 1):
        out += (1 - i / size) ** rounds * comb(size, i) * ((alphabet - 1) / alphabet) ** i * (1 / alphabet) ** (size - i)
    return k * (k - 1) / 2 * F.lit(out)


@query("expected_collisions", f"WITH {FRAMES}, n AS (SELECT series_id, count(*)::DOUBLE AS k FROM fr GROUP BY 1) SELECT series_id, round(k * (k - 1) / 2 * list_sum([pow(1 - i / 4.0, 2) * c * pow(0.75, i) * pow(0.25, 4 - i) FOR i, c IN [1, 4, 6]]), 6) AS pairs FROM n".replace("FOR i, c IN [1, 4, 6]", "FOR i IN range(3)").replace(" * c * ", " * [1, 4, 6][i + 1] * "))
def expected(spark, d):
    n = frames(spark, d).groupBy("series_id").agg(F.count("*").cast("double").alias("k"))
    return n.select("series_id", F.round(expected_collisions(F.col("k"), 4, 4, 2, 2), 6).alias("pairs"))


def collapsed(xs: Column) -> Column:
    """An array without repeats of the element before."""
    return F.transform(F.filter(F.transform(xs, lambda x, i: F.struct(x.alias("x"), ((i == 0) | (F.get(xs, i - 1) != x)).alias("new"))), lambda r: r.new), lambda r: r.x)


def letters(rows: DataFrame, key: str = "tag") -> tuple[Column, list[str]]:
    """A letter for each symbol, from a on in the order of their names, and the names. An alphabet is small by its nature; over 10,000 symbols are an error."""
    names = sorted(r[0] for r in rows.select(key).distinct().where(F.col(key).isNotNull()).limit(10_001).collect())
    if len(names) > 10_000:
        raise ValueError("over 10000 symbols")
    if not names:
        return F.lit("a"), names
    return F.element_at(F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(chr(97 + i)))]), F.col(key)), names


LETTERS = "al AS (SELECT tag, chr((96 + row_number() OVER (ORDER BY tag))::INT) AS l FROM (SELECT DISTINCT tag FROM fr)), fl AS (SELECT series_id, t, l FROM fr JOIN al USING (tag))"
HASH = f"""{LETTERS}, w AS (SELECT series_id, t AS start, list(l) OVER o AS q FROM fl WINDOW o AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)), hc AS (SELECT series_id, start, q, list_filter(range(1, 7), lambda i: i = 1 OR q[i] <> q[i - 1]) AS p FROM w WHERE len(q) = 6),
he AS (SELECT series_id, start, array_to_string([q[i] FOR i IN p], '') AS hash, len(list_distinct(q)) AS uniq, len(p) - 1 AS trans, list_sum([ln(coalesce(p[k + 1], 7) - p[k]) FOR k IN range(1, len(p) + 1)]) AS lruns FROM hc)"""


def hashed(rows: DataFrame, size: int = 6) -> DataFrame:
    """series_id, start, hash (letters of symbols without repeats, so runs may stretch), uniq, trans and lruns, the sum of logarithms of run lengths, of each window."""
    w = sliding(rows.withColumn("l", letters(rows)[0]), size, 1, "l").withColumn("c", collapsed(F.col("xs")))
    at = F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == 0) | (F.get("xs", i) != F.get("xs", i - 1)))
    w = w.withColumn("at", at)
    runs = F.zip_with("at", F.slice("at", 2, size), lambda a, b: F.ln((F.coalesce(b, F.lit(size)) - a).cast("double")))
    lruns = F.aggregate(runs, F.lit(0.0), lambda a, x: a + x)
    return w.select("series_id", "start", F.array_join("c", "").alias("hash"), F.size(F.array_distinct("xs")).alias("uniq"), (F.size("c") - 1).alias("trans"), lruns.alias("lruns"))


ENTRIES = f"""{HASH}, hf AS (SELECT * FROM he WHERE uniq >= 2 AND trans >= 2 AND hash IN (SELECT hash FROM he WHERE uniq >= 2 AND trans >= 2 GROUP BY hash HAVING count(*) >= 5)),
sw AS (SELECT hash, series_id, min(start) AS start FROM hf GROUP BY ALL UNION ALL SELECT sw.hash, sw.series_id, (SELECT min(h.start) FROM hf h WHERE h.hash = sw.hash AND h.series_id = sw.series_id AND h.start >= sw.start + 6) FROM sw WHERE sw.start IS NOT NULL),
oc AS (SELECT hf.* FROM sw JOIN hf USING (hash, series_id, start)),
en AS (SELECT hash, n_fixed, n_dtw, uniq, trans, lruns FROM (SELECT hash, count(*) AS n_fixed, max(uniq) AS uniq, max(trans) AS trans FROM hf GROUP BY 1) JOIN (SELECT hash, count(*) AS n_dtw, sum(lruns) AS lruns FROM oc GROUP BY 1) USING (hash) WHERE n_dtw >= 3)"""
HASHED = f"WITH RECURSIVE {FRAMES}, {ENTRIES}"


def swept(h: DataFrame, size: int = 6) -> DataFrame:
    """Of the windows of each hash, in each series, those from left to right that overlap none taken before."""
    none = F.array().cast("array<struct<start:int,lruns:double>>")
    rows = h.groupBy("hash", "series_id").agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), "lruns"))).alias("s"))
    taken = F.aggregate("s", none, lambda a, x: F.when((F.size(a) == 0) | (x.start >= F.element_at(a, -1).start + size), F.concat(a, F.array(x))).otherwise(a))
    return rows.select("hash", "series_id", F.explode(taken).alias("x")).select("hash", "series_id", "x.start", "x.lruns")


def entries(h: DataFrame, size: int = 6, least: int = 5, least_dtw: int = 3) -> DataFrame:
    """hash, n_fixed (windows), n_dtw (occurrences that do not overlap), uniq, trans and lruns of hashes with two symbols and two changes at least."""
    h = h.where("uniq >= 2 and trans >= 2")
    n = h.groupBy("hash").agg(F.count("*").alias("n_fixed"), F.max("uniq").alias("uniq"), F.max("trans").alias("trans")).where(F.col("n_fixed") >= least)
    o = swept(h.join(n.select("hash"), "hash", "left_semi"), size).groupBy("hash").agg(F.count("*").alias("n_dtw"), F.sum("lruns").alias("lruns"))
    return n.join(o, "hash").where(F.col("n_dtw") >= least_dtw).select("hash", "n_fixed", "n_dtw", "uniq", "trans", "lruns")


@query("hash_entries", f"{HASHED} SELECT hash, n_fixed, n_dtw, uniq, trans FROM en")
def hash_entries(spark, d):
    return entries(hashed(frames(spark, d))).drop("lruns")


def mdl(size: int = 6, symbols_: int = 5) -> list[Column]:
    """Description lengths of an entry: frames coded by its symbols and occurrences by one more symbol; and that of its occurrences' runs."""
    plain = -F.ln("uniq") * F.col("n_dtw") * size + F.col("n_dtw") * F.ln(F.lit(symbols_ + 1.0))
    runs = -(F.col("n_dtw") * (F.col("trans") + 1) * F.ln("uniq") + F.col("lruns"))
    return [F.round(plain, 6).alias("mdl"), F.round(runs, 6).alias("mdl_rle")]


MDL = "round(-ln(uniq) * n_dtw * 6 + n_dtw * ln((SELECT count(*) FROM al) + 1), 6) AS mdl, round(-(n_dtw * (trans + 1) * ln(uniq) + lruns), 6) AS mdl_rle"


def _described(spark, d) -> DataFrame:
    rows = frames(spark, d)
    return entries(hashed(rows)).select("*", *mdl(6, len(letters(rows)[1])))


@query("hash_mdl", f"{HASHED} SELECT hash, {MDL} FROM en")
def hash_mdl(spark, d):
    return _described(spark, d).select("hash", "mdl", "mdl_rle")


#: Keys of each order of entries; a minus stands for the largest first.
ORDERS = {
    "occs": ["-n_dtw", "-n_fixed", "-trans", "-uniq", "mdl", "hash"],
    "trans": ["-trans", "-uniq", "-n_dtw", "-n_fixed", "mdl", "hash"],
    "mdl": ["mdl", "-trans", "-uniq", "-n_dtw", "-n_fixed", "hash"],
    "mdl_rle": ["mdl_rle", "-trans", "-uniq", "-n_dtw", "-n_fixed", "hash"],
    "string": ["hash", "-n_fixed", "-n_dtw", "mdl", "-trans", "-uniq"],
}


def _sorted(mode: str):
    def run(spark, d):
        keys = [F.desc(k[1:]) if k[0] == "-" else F.asc(k) for k in ORDERS[mode]]
        return _described(spark, d).orderBy(*keys).select("hash", "n_fixed", "n_dtw", "mdl", "mdl_rle")

    run.__doc__ = f"All entries in the order of {', '.join(ORDERS[mode])}."
    return run


for _mode in ORDERS:
    query(f"hash_top_by_{_mode}", f"{HASHED} SELECT hash, n_fixed, n_dtw, {MDL} FROM en")(_sorted(_mode))


#: A pattern of symbols, how far a run may stretch, and how many symbols may be others.
PATTERN, STRETCH, OTHERS = ("click", "view", "error"), 3, 1
WARPED = f"""rn AS (SELECT series_id, tag, start, stop - start AS n, list(tag) OVER o AS tags, list(stop - start) OVER o AS lens FROM mk WINDOW o AS (PARTITION BY series_id ORDER BY start ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
wo AS (SELECT series_id, start + n - k AS start, [k, lens[2], least(lens[3], 3)] AS lens, tags, (tags[1] <> 'click')::INT + (tags[2] <> 'view')::INT + (tags[3] <> 'error')::INT AS others FROM rn, range(1, 4) r(k) WHERE len(tags) = 3 AND k <= n AND lens[2] <= 3 AND (tags[1] <> 'click')::INT + (tags[2] <> 'view')::INT + (tags[3] <> 'error')::INT <= 1),
wq AS (SELECT series_id, start, list_sum(lens)::INT AS len, others, lens, array_to_string([repeat(l, lens[i]::INT) FOR l, i IN tags], '') AS s FROM (SELECT wo.* EXCLUDE (tags), [a.l, b.l, c.l] AS tags FROM wo JOIN al a ON a.tag = wo.tags[1] JOIN al b ON b.tag = wo.tags[2] JOIN al c ON c.tag = wo.tags[3]))"""


def warped(rows: DataFrame, pattern: tuple[str, ...] = PATTERN, stretch: int = STRETCH, others: int = OTHERS) -> DataFrame:
    """series_id, start, len, others, lens and s: places where the pattern's symbols follow one another, each held for 1 to `stretch` frames, with at most `others` of them replaced.

    An occurrence may begin inside a run; runs between its ends are taken whole. s has the letters of its frames.
    """
    m, letter = len(pattern), letters(rows)[0]
    order = Window.partitionBy("series_id").orderBy("start").rowsBetween(0, m - 1)
    r = runs(rows).withColumn("n", (F.col("stop") - F.col("start")).cast("int"))
    r = r.select("series_id", "start", "n", F.collect_list(F.struct("tag", letter.alias("l"), "n")).over(order).alias("q")).where(F.size("q") == m)
    wrong = sum(((F.get("q", F.lit(i))["tag"] != p).cast("int") for i, p in enumerate(pattern)), F.lit(0))
    r = r.withColumn("others", wrong).where(F.col("others") <= others)
    for i in range(1, m - 1):
        r = r.where(F.get("q", F.lit(i))["n"] <= stretch)
    r = r.withColumn("k", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(stretch)))))
    lens = F.transform("q", lambda x, i: F.when(i == 0, F.col("k")).otherwise(F.least(x["n"], F.lit(stretch))))
    r = r.withColumn("lens", lens).withColumn("s", F.array_join(F.zip_with("q", "lens", lambda x, n: F.repeat(x["l"], n)), ""))
    return r.select("series_id", (F.col("start") + F.col("n") - F.col("k")).cast("int").alias("start"), F.aggregate("lens", F.lit(0), lambda a, x: a + x).alias("len"), "others", "lens", "s")


@query("warped_occurrences", f"WITH {MARKUP}, {LETTERS}, {WARPED} SELECT series_id, start::INT AS start, len, others FROM wq")
def warped_occurrences(spark, d):
    """Places where a pattern of symbols occurs with runs stretched and one symbol replaced."""
    return warped(frames(spark, d)).select("series_id", "start", "len", "others")


AVERAGE = "av AS (SELECT repeat((SELECT l FROM al WHERE tag = 'click'), round(avg(lens[1]))::INT) || repeat((SELECT l FROM al WHERE tag = 'view'), round(avg(lens[2]))::INT) || repeat((SELECT l FROM al WHERE tag = 'error'), round(avg(lens[3]))::INT) AS a FROM wq), ed AS (SELECT series_id, start::INT AS start, len, levenshtein(s, a) AS dist FROM wq, av)"


def scored(rows: DataFrame, pattern: tuple[str, ...] = PATTERN) -> DataFrame:
    """Warped occurrences with dist, the edit distance of their letters to the average string: each symbol of the pattern held for its mean run."""
    found = warped(rows, pattern)
    letter = dict(zip(names := letters(rows)[1], map(chr, range(97, 97 + len(names)))))
    means = found.agg(*[F.round(F.avg(F.get("lens", F.lit(i)))).cast("int").alias(f"m{i}") for i in range(len(pattern))])  # one row
    average = F.concat(*[F.repeat(F.lit(letter.get(p, "?")), F.col(f"m{i}")) for i, p in enumerate(pattern)])
    met = found.join(F.broadcast(means.select(average.alias("average"))))
    return met.select("series_id", "start", "len", F.levenshtein("s", "average").cast("long").alias("dist"))


@query("edit_distance_search", f"WITH {MARKUP}, {LETTERS}, {WARPED}, {AVERAGE} SELECT series_id, start, len, dist FROM ed")
def edit_distance_search(spark, d):
    return scored(frames(spark, d))


AFFIX = f"WITH {MARKUP}, {LETTERS}, {WARPED}, o AS (SELECT series_id, start, len FROM wq)"


@query("affix_counts", f"{AFFIX} SELECT 'before' AS side, f.tag, count(*) AS n FROM o JOIN fr f ON f.series_id = o.series_id AND f.t = o.start - 1 GROUP BY ALL UNION ALL SELECT 'after', f.tag, count(*) FROM o JOIN fr f ON f.series_id = o.series_id AND f.t = o.start + o.len GROUP BY ALL")
def affix_counts(spark, d):
    """Symbols just before and after each occurrence."""
    rows = frames(spark, d)
    o = warped_occurrences(spark, d)
    at = o.select("series_id", F.lit("before").alias("side"), (F.col("start") - 1).alias("t")).union(o.select("series_id", F.lit("after"), F.col("start") + F.col("len")))
    return rows.join(at, ["series_id", "t"]).groupBy("side", "tag").agg(F.count("*").alias("n"))


@query("gap_join", f"WITH {MARKUP} SELECT a.tag AS tag1, b.tag AS tag2, b.start - (a.stop - 1) AS gap, count(*) AS n FROM mk a JOIN mk b ON a.series_id = b.series_id AND b.start - (a.stop - 1) > 0 AND b.start - (a.stop - 1) <= 2 GROUP BY ALL")
def gap_join(spark, d):
    """Labels that begin one or two frames after another's last: an equi-join on series and start, not a range join."""
    m = markup(spark, d)
    a = m.select("series_id", F.col("tag").alias("tag1"), F.col("stop").alias("stop1"), F.explode(F.array(F.lit(1), F.lit(2))).alias("gap"))
    a = a.withColumn("start", F.col("stop1") - 1 + F.col("gap"))
    b = m.select("series_id", "start", F.col("tag").alias("tag2"))
    return a.join(b, ["series_id", "start"]).groupBy("tag1", "tag2", "gap").agg(F.count("*").alias("n"))


SUBS = "s AS (SELECT series_id, t, list(tag) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS q FROM fr), sb AS (SELECT series_id, t, n, array_to_string(q[1:n], ',') AS sub FROM s, range(1, 6) r(n) WHERE len(q) >= n)"


def substrings(rows: DataFrame, longest: int = 5) -> DataFrame:
    """series_id, t, n and sub: every substring of up to `longest` symbols."""
    ahead = Window.partitionBy("series_id").orderBy("t").rowsBetween(0, longest - 1)
    w = rows.select("series_id", "t", F.collect_list("tag").over(ahead).alias("q"))
    w = w.withColumn("n", F.explode(F.sequence(F.lit(1), F.size("q"))))
    return w.select("series_id", "t", "n", F.array_join(F.slice("q", F.lit(1), F.col("n")), ",").alias("sub"))


@query("substring_counts", f"WITH {FRAMES}, {SUBS} SELECT sub, n::INT AS n, count(*) AS k FROM sb GROUP BY ALL HAVING count(*) >= 2")
def substring_counts(spark, d):
    return substrings(frames(spark, d)).groupBy("sub", "n").agg(F.count("*").alias("k")).where("k >= 2")


@query("count_dl", f"WITH {FRAMES}, {SUBS}, c AS (SELECT sub, n::BIGINT AS n, count(*) AS k FROM sb GROUP BY ALL HAVING count(*) >= 2), z AS (SELECT count(*) AS total FROM fr) SELECT sub, n + k + (total - n * k) AS dl FROM c, z")
def count_dl(spark, d):
    """Substrings by the length of a description that names them once: shortest first."""
    rows = frames(spark, d)
    c = substring_counts(spark, d).join(F.broadcast(rows.agg(F.count("*").alias("total"))))
    dl = (F.col("n") + F.col("k") + (F.col("total") - F.col("n") * F.col("k"))).alias("dl")
    return c.select("sub", dl, "k", "n").orderBy("dl", F.desc("k"), "n", "sub").select("sub", "dl")


@query("prefix_trie", f"WITH {FRAMES}, {SUBS} SELECT sub, n::INT AS n, count(*) AS k, count(DISTINCT series_id) AS n_series FROM sb WHERE n >= 2 AND len(list_distinct(string_split(sub, ','))) >= 2 GROUP BY ALL HAVING count(*) >= 20")
def prefix_trie(spark, d):
    """Nodes of a trie of subsequences: those with two symbols at least that occur twenty times."""
    s = substrings(frames(spark, d)).where((F.col("n") >= 2) & (F.size(F.array_distinct(F.split("sub", ","))) >= 2))
    return s.groupBy("sub", "n").agg(F.count("*").alias("k"), F.countDistinct("series_id").alias("n_series")).where("k >= 20")


FREE = "cl AS (SELECT series_id, start AS a, stop - 1 AS b FROM mk WHERE tag = 'click'), en AS (SELECT series_id, a, b FROM cl UNION ALL SELECT series_id, max(t) + 1, max(t) + 1 FROM fr GROUP BY 1), fs AS (SELECT series_id, coalesce(max(b) OVER (PARTITION BY series_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 0) AS a, a - 1 AS b FROM en)"


@query("segment_mdl", f"WITH {MARKUP}, {FREE} SELECT round(2 * (SELECT sum(ln(b - a + 1)) FROM fs WHERE a <= b) + (SELECT count(*) FROM cl) * ln((SELECT count(*) FROM fr)), 5) AS dl")
def segment_mdl(spark, d):
    """Twice the logarithms of the lengths of the segments that a motif's occurrences leave, and a place in the whole for each occurrence."""
    rows = frames(spark, d)
    taken = of_tag(runs(rows), "click")
    free = complement(taken, whole(rows)).agg(F.sum(F.ln((F.col("b") - F.col("a") + 1).cast("double"))).alias("l"))
    counts = taken.agg(F.count("*").alias("m")).join(rows.agg(F.count("*").alias("total")))
    return free.join(counts).select(F.round(2 * F.coalesce("l", F.lit(0.0)) + F.col("m") * F.ln("total"), 5).alias("dl"))  # one row each


@query("name_index", "SELECT DISTINCT source, regexp_extract(source, '^.*(\\d+).*$', 1) AS idx FROM documents")
def name_index(spark, d):
    """The last digit of a name: the greedy prefix takes all before it."""
    return spark.read.parquet(f"{d}/documents.parquet").select("source", F.regexp_extract("source", "^.*(\\d+).*$", 1).alias("idx")).distinct()


AUGMENTED = """a AS (SELECT m.series_id, start, stop - start AS len, total FROM mk m JOIN (SELECT series_id, count(*) AS total FROM fr GROUP BY 1) USING (series_id)),
b AS (SELECT series_id, start, len, total, 'own' AS kind FROM a UNION ALL SELECT series_id, start + floor(len / 4 + 0.5)::BIGINT, CASE WHEN (len // 2) % 2 = 0 THEN len // 2 + 1 ELSE len // 2 END, total, 'half' FROM a UNION ALL SELECT series_id, start - floor(len / 4 + 0.5)::BIGINT, floor(len * 1.5)::BIGINT, total, 'more' FROM a
UNION ALL SELECT series_id, start + floor(len / 8 + 0.5)::BIGINT, floor(len * 0.75 + 0.5)::BIGINT, total, 'half' FROM a UNION ALL SELECT series_id, start - floor(len / 8 + 0.5)::BIGINT, floor(len * 1.25)::BIGINT, total, 'more' FROM a)"""


@query("augment_lengths", f"WITH {MARKUP}, {AUGMENTED} SELECT DISTINCT series_id, start, len FROM b WHERE kind = 'own' OR (kind = 'half' AND len > 2) OR (kind = 'more' AND start >= 0 AND start + len <= total)")
def augment_lengths(spark, d):
    """Occurrences at other lengths about their middle: half (made odd) and three quarters if over two frames, five quarters and one and a half where these fit."""
    total_ = frames(spark, d).groupBy("series_id").agg(F.count("*").alias("total"))
    m = markup(spark, d).join(total_, "series_id").select("series_id", "start", (F.col("stop") - F.col("start")).alias("len"), "total")
    n, to = F.col("len"), lambda x: F.floor(x).cast("long")
    half = to(n / 2) + F.when(to(n / 2) % 2 == 0, 1).otherwise(0)
    sizes = [(F.lit(0), n, "own"), (to(n / 4 + 0.5), half, "half"), (-to(n / 4 + 0.5), to(n * 1.5), "more"), (to(n / 8 + 0.5), to(n * 0.75 + 0.5), "half"), (-to(n / 8 + 0.5), to(n * 1.25), "more")]
    rows = [F.struct((F.col("start") + by).alias("start"), size.cast("long").alias("len"), F.lit(kind).alias("kind")) for by, size, kind in sizes]
    out = m.select("series_id", "total", F.inline(F.array(*rows)))
    return out.where("kind = 'own' or (kind = 'half' and len > 2) or (kind = 'more' and start >= 0 and start + len <= total)").select("series_id", "start", "len").distinct()


def _dim_sql(dim: int, value: str) -> str:
    both = SAX.replace("x) OVER o AS xs", f"{value}) OVER o AS xs")
    for name in ("w8", "wm", "ws", "wp", "sx"):
        both = both.replace(f"{name} AS", f"{name}{dim} AS").replace(f"FROM {name} ", f"FROM {name}{dim} ").replace(f"FROM {name})", f"FROM {name}{dim})")
    return both


@query("dim_collision_rowsums", f"WITH {FRAMES}, {_dim_sql(0, 'x')}, {_dim_sql(1, 'h')}, l AS (SELECT 0 AS dim, series_id, start, word FROM sx0 UNION ALL SELECT 1, series_id, start, word FROM sx1), rd(round, i, j) AS (VALUES (0, 1, 2), (1, 1, 3), (2, 1, 4), (3, 2, 3), (4, 2, 4), (5, 3, 4)), pk AS (SELECT dim, series_id, start, round, substr(word, i, 1) || substr(word, j, 1) AS key FROM l, rd), b AS (SELECT dim, round, key, count(*) AS n FROM pk GROUP BY ALL) SELECT dim, series_id, start, sum(n - 1)::BIGINT AS hits FROM pk JOIN b USING (dim, round, key) GROUP BY ALL")
def dim_collision_rowsums(spark, d):
    """Collisions of each window, dimension by dimension."""
    rows = frames(spark, d)
    words = sax(rows).withColumn("dim", F.lit(0)).unionByName(sax(rows, value="h").withColumn("dim", F.lit(1)))
    p = projected(words.groupBy("dim", "word").agg(F.count("*").alias("n")))
    n = p.groupBy("dim", "round", "key").agg(F.sum("n").alias("in_key"))
    hits = p.join(n, ["dim", "round", "key"]).groupBy("dim", "word").agg(F.sum(F.col("in_key") - 1).alias("hits"))
    return words.join(hits, ["dim", "word"]).select("dim", "series_id", "start", "hits")


@query("right_maximal", f"WITH {FRAMES}, {SUBS}, c AS (SELECT sub, n::INT AS n, count(*) AS k FROM sb GROUP BY ALL HAVING count(*) >= 2) SELECT sub, n, k FROM c WHERE n < 5 AND NOT EXISTS (SELECT 1 FROM c e WHERE e.n = c.n + 1 AND e.k = c.k AND regexp_replace(e.sub, ',[^,]*$', '') = c.sub)")
def right_maximal(spark, d):
    """Repeated substrings that no longer one with as many occurrences begins with."""
    c = substring_counts(spark, d)
    longer = c.where("n > 1").select(F.regexp_replace("sub", ",[^,]*$", "").alias("p"), F.col("k").alias("pk"))
    return c.where("n < 5").join(longer, (F.col("sub") == F.col("p")) & (F.col("k") == F.col("pk")), "left_anti")


@query("labels_to_motifs", f"WITH {MARKUP} SELECT dense_rank() OVER (ORDER BY tag) - 1 AS motif_id, series_id, start, stop - start AS len FROM mk")
def labels_to_motifs(spark, d):
    """Each class of labels as a motif."""
    m = symbols(markup(spark, d))
    return m.select(F.col("sym").cast("long").alias("motif_id"), "series_id", "start", (F.col("stop") - F.col("start")).alias("len"))


def motifs_to_labels(motifs: DataFrame) -> DataFrame:
    """Motifs as classes of labels to train on: series_id, tag, start, stop."""
    return motifs.select("series_id", F.concat(F.lit("motif"), F.col("motif_id").cast("string")).alias("tag"), "start", (F.col("start") + F.col("len")).alias("stop"))


@query("motifs_as_classes", f"WITH {MARKUP} SELECT series_id, 'motif' || (dense_rank() OVER (ORDER BY tag) - 1) AS tag, start, stop FROM mk")
def motifs_as_classes(spark, d):
    return motifs_to_labels(labels_to_motifs(spark, d))
