"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items, run once over each text.

Texts are lower-cased and cut to words, joined by single blanks; a window is found as a string between blanks, so the
automaton sees whole words only. Offsets are mapped back to the original text for the spans that are returned.

The items are broadcast, and each Python worker builds the automaton once. Its size is checked: items are dealt by a
hash into slices of about `SLICE_BYTES` of text, each an automaton of its own. The driver collects one slice at a time.
Windows overlap, so an automaton takes about 360 MB for 1 MB of items (measured), 180 MB for a slice. Of several slices
a worker has one automaton at a time: it holds about `HELD_BYTES` of texts, goes over them slice by slice, and joins
the hits per document. So its memory is the same for any number of slices, of which each is one more pass over the texts
in hand. Items of over a slice stay whole.

Nulls and odd rows: null texts and items have no words; an item without item_id marks words but is not listed; equal
item_ids count once. Repeated rows get equal results, empty tables give no rows or no hits, and other columns pass
through.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.base import fresh, table
from tessera.llm.words import chunks

WINDOW = 10
SLICE_BYTES, HELD_BYTES = 1 << 19, 64 << 20
#: Maps bytes of text: capitals to small letters, all other ASCII but letters and digits to blanks.
PLAIN = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
HIT = "struct<n_words:long,n_hit:long,items:array<string>,spans:array<struct<start:int,end:int>>>"


def plain_words(text: str | None) -> list[bytes]:
    return text.encode().translate(PLAIN).split() if text else []


def windows(items: list[tuple[str | None, str | None]], size: int = WINDOW) -> dict[str, set[str]]:
    """Each window of the items, between blanks, with the ids of the items that have it."""
    found: dict[str, set[str]] = {}
    for item_id, text in items:
        words = plain_words(text)
        for i in range(max(1, len(words) - size + 1) if words else 0):
            ids = found.setdefault(f" {b' '.join(words[i : i + size]).decode()} ", set())
            if item_id is not None:
                ids.add(item_id)
    return found


class Scanner:
    def __init__(self, found: dict[str, set[str]]):
        self.automaton = ahocorasick.Automaton()
        for window, ids in found.items():
            self.automaton.add_word(window, (len(window), window.count(" ") - 1, tuple(ids)))
        if found:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> tuple[int, int, list[str], list[tuple[int, int]]]:
        """Words, hit words, items, and the spans of hit words as offsets of characters."""
        words = plain_words(text)
        if not words or not len(self.automaton):
            return len(words), 0, [], []
        line = f" {b' '.join(words).decode()} "
        if not (hits := list(self.automaton.iter(line))):
            return len(words), 0, [], []
        hit, items, at, n = np.zeros(len(words) + 1, np.int8), set(), 0, 0
        for end, (length, size, ids) in sorted((end + 1 - length, (length, size, ids)) for end, (length, size, ids) in hits):
            n += line.count(" ", at, end)  # blanks before a place are words before it
            at = end
            hit[n : n + size] = 1
            items.update(ids)
        bounds = np.flatnonzero(np.diff(hit, prepend=0)).reshape(-1, 2)
        places = [m.span() for m in WORD.finditer(text)]
        return len(words), int(hit.sum()), sorted(items), [(places[a][0], places[b - 1][1]) for a, b in bounds.tolist()]


def _slices(benchmark: DataFrame) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items, a slice at a time."""
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // SLICE_BYTES) or 1
    dealt = rows.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for i in range(n):
        yield [(r[0], r[1]) for r in dealt.where(F.col("slice") == i).select("item_id", "text").collect()]


_built: dict[str, Scanner] = {}


def _scanner(name: str, items: list[tuple[str | None, str | None]], size: int) -> Scanner:
    """The scanner of a slice, the only one that a worker keeps."""
    if name not in _built:
        _built.clear()
        _built[name] = Scanner(windows(items, size))
    return _built[name]


def _joined(x: tuple, y: tuple, whole: str) -> tuple:
    """The hits of two automata as one: spans are joined where they overlap, and hit words counted again in them."""
    spans = sorted([*x[3], *y[3]])
    joined = [spans[0]]
    for s, e in spans[1:]:
        if s <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(e, joined[-1][1]))
        else:
            joined.append((s, e))
    return x[0], sum(len(WORD.findall(whole[s:e])) for s, e in joined), sorted({*x[2], *y[2]}), joined


def _held(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[list[pa.RecordBatch]]:
    """Chunks of batches, together about `size` bytes of text."""
    kept: list[pa.RecordBatch] = []
    for batch in chunks(batches, text=text):
        kept.append(batch)
        if sum(b.nbytes for b in kept) >= size:
            yield kept
            kept = []
    if kept:
        yield kept


def mark(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text: str = "text", out: str = "benchmark_hits") -> DataFrame:
    """docs with a struct column `out`: n_words, n_hit, items and spans, which has the places of hit words in the text."""
    before = docs.drop(out)
    schema = before.withColumn(out, F.lit(None).cast(HIT)).schema
    kind = to_arrow_schema(schema).field(out).type
    slices = [(str(uuid.uuid4()), docs.sparkSession.sparkContext.broadcast(items)) for items in _slices(benchmark)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches, text, HELD_BYTES if len(slices) > 1 else 1):
            texts = [batch.column(text).to_pylist() for batch in held]
            found: list[list[tuple]] = []
            for name, shared in slices:
                scan = _scanner(name, shared.value, size)
                new = [[scan(t) for t in own] for own in texts]
                found = [[_joined(x, y, t) if y[3] else x for x, y, t in zip(*rows)] for rows in zip(found, new, texts)] if found else new
            for batch, own in zip(held, found):
                rows = [{"n_words": n, "n_hit": k, "items": ids, "spans": [{"start": a, "end": b} for a, b in spans]} for n, k, ids, spans in own]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in batch.schema.names], pa.array(rows, kind)], [*batch.schema.names, out])

    return before.mapInArrow(each, schema)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = mark(docs, table(spark, sf_dir, "benchmark"))
    h = "benchmark_hits"
    return hits.select("doc_id", f"{h}.n_words", f"{h}.n_hit", F.size(f"{h}.items").cast("long").alias("n_items"), F.sha2(F.array_join(f"{h}.items", ","), 256).alias("items_sha256"), (F.col(f"{h}.n_hit") > 0).alias("contaminated"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no window of the benchmark occurs."""
    out = fresh(docs, "benchmark_hits")
    return mark(docs, table(spark, sf_dir, "benchmark"), out=out).where(f"{out}.n_hit = 0").select(*[f"`{c}`" for c in docs.columns])


#: DuckDB SQL for op9_decontaminate.
ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win FROM b, range(1, greatest(len(w) - 9, 1) + 1) r(i) WHERE len(w) > 0),
z AS (SELECT DISTINCT n FROM v),
x AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM d, z, range(1, len(w) - n + 2) r(i)),
m AS (SELECT x.doc_id, x.i, x.n, v.item_id FROM x JOIN v ON x.n = v.n AND x.win = v.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, range(i, i + n) r(p) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
