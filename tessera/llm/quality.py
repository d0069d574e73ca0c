"""Quality rules: repetition and symbol counts, and the distance of a document's histograms from its language's.

Everything is DataFrame functions. Histograms of character classes and of common words are compared by the
Jensen-Shannon distance (base 2, so 0 to 1) to a reference for the language: the mean histogram of its documents.

Nulls and odd rows: a null text has no words and fails the base rule; a null or unknown language has no common
words, so only characters are compared; documents under `min_words` are never judged by distance. Repeated rows
get equal verdicts, an empty table gives an empty one, and other columns of the input pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.base import cut, fresh, small, table

#: Words that are common in any text of the language.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "with"],
    "de": ["der", "die", "und", "den", "von", "das", "mit", "des", "ist", "im", "dem", "nicht"],
    "fr": ["de", "la", "le", "les", "et", "des", "en", "un", "une", "que", "dans", "est"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por"],
}
BLANK = "\\x20\\x09-\\x0D"
SYMBOLS = "[#*$%&|<>]"

MIN_WORDS = 50
MAX_CLASS_DISTANCE = 0.32
MAX_WORD_DISTANCE = 0.75


def _with_shares(df: DataFrame, name: str, counts: Column) -> DataFrame:
    """Counts and their sum are columns of their own, or else each element would compute them again."""
    df = df.withColumn(f"{name}_n", counts)
    df = df.withColumn(f"{name}_t", F.greatest(F.aggregate(f"{name}_n", F.lit(0.0), lambda a, x: a + x), F.lit(1.0)))
    return df.withColumn(name, F.transform(f"{name}_n", lambda x: x / F.col(f"{name}_t")))


def _distance(p: Column, q: Column) -> Column:
    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def _words(whole: Column) -> Column:
    for c in "\t\n\x0b\f\r":  # one separator, so that split() needs no regular expression
        whole = F.replace(whole, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(whole, " "), "")


def _profile(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """docs with p_words, an array, p_classes and p_common, which are histograms as shares.

    Classes: lower-case ASCII letters, blanks, capitals, digits, symbols, other ASCII, and the rest.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("p_words", _words(whole)).withColumn("p_length", F.length(whole))
    out = out.withColumn("p_n", F.size("p_words")).withColumn("p_chars", F.length(F.array_join("p_words", "")))
    out = out.withColumn("p_rest", F.regexp_replace(whole, f"[a-z{BLANK}]+", ""))
    out = out.withColumn("p_symbols", F.regexp_count("p_rest", F.lit(SYMBOLS)).cast("long"))
    rare = [F.regexp_count("p_rest", F.lit(c)) for c in ("[A-Z]", "[0-9]", "[^\\x00-\\x7F]")]
    out = out.withColumn("p_rare", F.array(*rare, "p_symbols"))
    rest = F.length("p_rest") - F.aggregate("p_rare", F.lit(0).cast("long"), lambda a, x: a + x)
    counts = F.concat(F.array(F.col("p_chars") - F.length("p_rest"), F.col("p_length") - F.col("p_chars"), rest), F.col("p_rare"))
    out = _with_shares(out, "p_classes", F.transform(counts, lambda x: x.cast("double")))
    listed = F.create_map(*[x for k, v in COMMON.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    out = out.withColumn("p_listed", F.coalesce(F.element_at(listed, F.col(lang)), F.array().cast("array<string>")))
    every = sorted({w for v in COMMON.values() for w in v})
    out = out.withColumn("p_found", F.concat(F.lit(" "), F.array_join(F.filter("p_words", lambda w: w.isin(every)), "  "), F.lit(" ")))
    spaced = F.transform("p_listed", lambda c: F.concat(F.lit(" "), c, F.lit(" ")))
    found = F.transform(spaced, lambda c: ((F.length("p_found") - F.length(F.replace("p_found", c, F.lit("")))) / F.length(c)).cast("double"))
    out = out.withColumn("p_hits", found)
    other = F.col("p_n") - F.aggregate("p_hits", F.lit(0.0), lambda a, x: a + x)
    return _with_shares(out, "p_common", F.concat("p_hits", F.array(other)))


def _references(profiles: DataFrame, lang: str, min_words: int) -> DataFrame:
    """One row a language: the mean histograms of its documents of `min_words` or more. Counts are combined before the shuffle."""
    n_common = max(map(len, COMMON.values())) + 1
    means = [F.avg(F.get("p_classes", F.lit(i))).alias(f"c{i}") for i in range(7)]
    means += [F.avg(F.get("p_common", F.lit(i))).alias(f"w{i}") for i in range(n_common)]
    out = profiles.where(F.col("p_n") >= min_words).groupBy(F.col(lang).alias("r_lang")).agg(*means)
    return out.select("r_lang", F.array(*[f"c{i}" for i in range(7)]).alias("r_classes"), F.array_compact(F.array(*[f"w{i}" for i in range(n_common)])).alias("r_common"))


def _repetition(docs: DataFrame, text: str) -> DataFrame:
    """docs, which have p_words, with n_dup_lines and n_repeat_words."""
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("p_lines", F.filter(F.split(whole, "\n"), lambda x: x.rlike(f"[^{BLANK}]")))
    out = out.withColumn("n_dup_lines", (F.size("p_lines") - F.size(F.array_distinct("p_lines"))).cast("long"))
    def doubled(gram: str, step: int) -> Column:
        return F.zip_with(gram, F.slice(gram, step + 1, F.greatest(F.col("p_n") - step, F.lit(0))), lambda a, b: F.xxhash64(a, b))

    def whole_windows(gram: str, size: int) -> Column:
        return F.slice(gram, 1, F.greatest(F.col("p_n") - (size - 1), F.lit(0)))

    # Windows of 2, 4 and then 8 words are hashed from their halves; a text in which none of 4 is repeated has none of 8.
    out = out.withColumn("p_two", doubled("p_words", 1)).withColumn("p_four", doubled("p_two", 2)).withColumn("p_four", whole_windows("p_four", 4))
    some = F.size(F.array_distinct("p_four")) < F.size("p_four")
    out = out.withColumn("p_gram", F.when(some, doubled("p_four", 4))).withColumn("p_gram", whole_windows("p_gram", 8))
    repeated = F.size(F.array_distinct("p_gram")) < F.size("p_gram")
    ranked = F.sort_array(F.transform("p_gram", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    out = out.withColumn("p_ranked", F.when(repeated, ranked))
    twins = F.zip_with("p_ranked", F.slice("p_ranked", 2, F.greatest(F.size("p_ranked") - 1, F.lit(0))), lambda a, b: F.when(a.g == b.g, F.array(a.i, b.i)))
    out = out.withColumn("p_at", F.sort_array(F.array_distinct(F.flatten(F.array_compact(twins)))))
    following = F.slice("p_at", 2, F.greatest(F.size("p_at") - 1, F.lit(0)))
    covered = F.zip_with("p_at", following, lambda a, b: F.when(b.isNull(), 8).otherwise(F.least(b - a, F.lit(8))))
    return out.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))


def _verdict(measured: DataFrame, refs: DataFrame, min_words: int, max_class_distance: float, max_word_distance: float) -> DataFrame:
    """measured with `quality`, a struct of all counts, distances and verdicts."""
    out = measured.join(refs, F.col("p_lang").eqNullSafe(F.col("r_lang")), "left")
    long_enough = F.col("p_n") >= min_words
    out = out.withColumn("class_distance", F.when(long_enough & F.col("r_classes").isNotNull(), _distance(F.col("p_classes"), F.col("r_classes"))))
    out = out.withColumn("word_distance", F.when(long_enough & (F.size("p_common") > 1), _distance(F.col("p_common"), F.col("r_common"))))
    n = F.col("p_n").cast("long")
    failed = (n < 20) | (100 * F.col("n_repeat_words") > 30 * n)
    far = (F.coalesce("class_distance", F.lit(0.0)) > max_class_distance) | (F.coalesce("word_distance", F.lit(0.0)) > max_word_distance)
    parts = [n.alias("n_words"), F.col("p_chars").cast("long").alias("word_chars"), F.col("p_symbols").alias("n_symbols"), "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", failed.alias("base_failed"), (~failed & ~far).alias("kept")]
    return out.withColumn("quality", F.struct(*parts))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", carry: bool = True, min_words: int = MIN_WORDS, max_class_distance: float = MAX_CLASS_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE, out: str = "quality") -> DataFrame:
    """docs with a struct column `out`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance,
    word_distance (null where not judged), base_failed and kept. Columns of docs named like ours are kept as they are, but for one named `out`, which is replaced.

    Rows are checkpointed with their measures, from which references and verdicts are then taken, so each text is gone
    through once, and is never shuffled. carry=False leaves out the texts.
    """
    columns = [c for c in docs.columns if c.lower() != out.lower() and (carry or c != text)]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("p_row"), F.col(text).alias("p_text"), F.col(lang).alias("p_lang"))
    measured = _repetition(_profile(own, "p_text", "p_lang"), "p_text").select("p_row", "p_lang", "p_n", "p_chars", "p_symbols", "p_classes", "p_common", "n_dup_lines", "n_repeat_words")
    measured = cut(measured)
    refs = small(cut(_references(measured, "p_lang", min_words)))
    judged = _verdict(measured, refs, min_words, max_class_distance, max_word_distance)
    return judged.select(*[F.col("p_row").getField(c).alias(c) for c in columns], F.col("quality").alias(out))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = judge(table(spark, sf_dir, "documents"), carry=False)
    return q.select("doc_id", "quality.n_words", "quality.word_chars", "quality.n_symbols", "quality.n_dup_lines", "quality.n_repeat_words", "quality.base_failed", "quality.kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep."""
    out = fresh(docs, "quality")
    return judge(docs, out=out).where(f"{out}.kept").select(*[f"`{c}`" for c in docs.columns])


_LISTED = ", ".join(f"('{k}', [{', '.join(repr(w) for w in v)}])" for k, v in COMMON.items())
#: DuckDB SQL for op6_quality.
ORACLE = f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{BLANK}]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win FROM d, range(1, len(w) - 6) r(i)),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS k FROM x),
h AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM g, range(i, i + 8) r(p) WHERE k > 1 GROUP BY doc_id),
m AS (SELECT doc_id, lang, w, len(w)::BIGINT AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) AS total, len(regexp_extract_all(t, '{SYMBOLS}')) AS n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^{BLANK}]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^{BLANK}]')))) AS n_dup_lines,
    len(regexp_extract_all(t, '[a-z]')) AS low, len(regexp_extract_all(t, '[A-Z]')) AS up, len(regexp_extract_all(t, '[0-9]')) AS dig, len(regexp_extract_all(t, '[^\\x00-\\x7F]')) AS far FROM d),
l(lang, listed) AS (VALUES {_LISTED}),
b AS (SELECT doc_id, lang, n_words, 'c' AS kind, unnest([1, 2, 3, 4, 5, 6, 7]) AS bin, unnest([low, total - word_chars, up, dig, n_symbols, far, word_chars - low - up - dig - n_symbols - far]) / greatest(total, 1) AS share FROM m
    UNION ALL SELECT doc_id, m.lang, n_words, 'w', k, CASE WHEN k < 13 THEN len(list_filter(w, lambda v: v = listed[k])) ELSE n_words - len(list_filter(w, lambda v: list_contains(listed, v))) END / greatest(n_words, 1) FROM m JOIN l ON m.lang = l.lang, range(1, 14) r(k)),
f AS (SELECT lang, kind, bin, avg(share) AS q FROM b WHERE n_words >= {MIN_WORDS} GROUP BY ALL),
j AS (SELECT doc_id, b.kind, sqrt(greatest(sum(CASE WHEN share > 0 THEN share * log2(share / ((share + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((share + q) / 2)) ELSE 0 END) / 2, 0)) AS js
    FROM b JOIN f ON b.kind = f.kind AND b.bin = f.bin AND b.lang IS NOT DISTINCT FROM f.lang WHERE n_words >= {MIN_WORDS} GROUP BY ALL),
a AS (SELECT DISTINCT doc_id FROM j WHERE (kind = 'c' AND js > {MAX_CLASS_DISTANCE}) OR (kind = 'w' AND js > {MAX_WORD_DISTANCE})),
o AS (SELECT m.doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, a.doc_id IS NOT NULL AS odd FROM m LEFT JOIN h ON m.doc_id = h.doc_id LEFT JOIN a ON m.doc_id = a.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT odd AS kept FROM o
"""
