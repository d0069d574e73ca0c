"""Substring dedup by seed and extend: passages of `WINDOW` words or more that a document with a smaller id has are cut.

Of every window's seeds (sequences of `SEED_WORDS` words) the one with the least hash is its anchor, so equal windows
have equal anchors at equal places, and about two of eleven seeds are anchors. Documents meet on anchors; from each
the match is extended both ways by comparing prints of the windows around it, word by word, and windows that match
overlap into maximal repeats.

Documents are worked on in chunks. A window that a smaller document in the same chunk has too is settled there, and
only anchors with an unsettled window are sent, so a passage in a third of all documents sends a row for each chunk,
not for each document. A task holds a bounded number of rows, and of an anchor with more the different windows about it.

Prints are 40 bits beside the anchor's 64. A place is a word's number, below the mark of its text: 24 bits of a hash.
Nulls and odd rows: a null text has no words; a row without a doc_id keeps all its words and counts for no other; rows
that share a doc_id are never compared with each other, and each loses its own repeated words, told from the others'
by the mark. Empty texts and tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.base import table
from tessera.llm.words import chunks, grams, mix, split

WINDOW = 13
SEED_WORDS = 4
CHUNK = 4 << 20
PRINT = 5
ROW = "anchor long, doc_id long, at long, prints binary"
#: A place has its text's mark above so many bits.
PLACE_BITS, MARK_BITS = 39, 24


def _spans(doc: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, sorted by document and place, as doc, first and last word of each run that they cover; last is exclusive."""
    if not len(doc):
        return doc, at, at
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + size) | (at[1:] < at[:-1])])
    ends = np.append(np.flatnonzero(new)[1:], len(doc)) - 1
    return doc[new], at[new], at[ends] + size


def _rows(anchor: np.ndarray, doc: np.ndarray, at: np.ndarray, prints: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum(counts * PRINT)]).astype(np.int32)
    data = np.ascontiguousarray(prints.view(np.uint8).reshape(-1, 8)[:, :PRINT])
    binary = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(doc), pa.array(at.astype(np.int64)), binary], ["anchor", "doc_id", "at", "prints"])


def _anchors(batches: Iterator[pa.RecordBatch], size: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows of anchors: where their first window starts, and prints of the windows; and without prints, settled spans, `anchor` being their last word."""
    for batch in chunks(batches, CHUNK):
        known = batch.column("doc_id").is_valid()
        batch = batch.filter(known)
        words = split(batch.column("text"))
        n = len(words.starts) - size + 1
        if n <= 0:
            continue
        hashes = words.hashes()
        seeds, wide = grams(hashes, seed), grams(hashes, size)
        place = np.lib.stride_tricks.sliding_window_view(seeds, size - seed + 1)[:n].argmin(1) + np.arange(n)
        window = np.flatnonzero(words.text[:n] == words.text[size - 1 :])
        if not len(window):
            continue
        wide, place, text = wide[window], place[window], words.text[window]
        doc = batch.column("doc_id").to_numpy()[text]
        at = window - words.first[text] + (batch.column("mark").to_numpy()[text] << PLACE_BITS)
        order = np.lexsort((doc, wide))
        new = np.concatenate([[True], wide[order][1:] != wide[order][:-1]])
        least = doc[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        settled = np.zeros(len(window), bool)
        settled[order] = doc[order] > least
        runs = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
        counts = np.diff(np.append(runs, len(window)))
        open_runs = ~np.logical_and.reduceat(settled, runs)
        yield _rows(seeds[place[runs[open_runs]]], doc[runs[open_runs]], at[runs[open_runs]], wide[np.repeat(open_runs, counts)], counts[open_runs])
        if settled.any():
            s_doc, first, last = _spans(doc[settled], at[settled], size)
            yield _rows(last.astype(np.uint64), s_doc, first, np.zeros(0, np.uint64), np.zeros(len(first), np.int64))


def _extend(batches: Iterator[pa.RecordBatch], size: int, held: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Spans of words that a smaller document has; rows come sorted by anchor and document.

    About `held` rows are held. Of an anchor with more, what goes on from one part of its rows to the next is each
    different window about it with the smallest document that has it.
    """
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def matched(rows: pa.Table, before: tuple[np.ndarray, np.ndarray]) -> tuple[pa.RecordBatch, tuple[np.ndarray, np.ndarray]]:
        prints = rows.column("prints").combine_chunks()
        prints = prints.chunk(0) if isinstance(prints, pa.ChunkedArray) else prints
        offsets = np.frombuffer(prints.buffers()[1], np.int32)[prints.offset : prints.offset + len(prints) + 1]
        counts = np.diff(offsets) // PRINT
        anchor, doc, at = (rows.column(c).to_numpy() for c in ("anchor", "doc_id", "at"))
        done = counts == 0
        total = int(counts.sum())
        raw = np.zeros((total, 8), np.uint8)
        if total:
            raw[:, :PRINT] = np.frombuffer(prints.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, PRINT)
        known = len(before[0])
        key = np.concatenate([before[0], mix(np.repeat(anchor.view(np.uint64), counts) ^ mix(raw.view(np.uint64).ravel()))])
        docs = np.concatenate([before[1], np.repeat(doc, counts)])
        places = np.repeat(at, counts) + np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        order = np.lexsort((docs, key))
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, bool)
        least = docs[order][np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        hit = np.sort(order[docs[order] > least])
        hit = hit[hit >= known]
        hit = hit[np.lexsort((places[hit - known], docs[hit]))]
        out = _spans(docs[hit], places[hit - known].astype(np.int64), size)
        parts = [np.concatenate([a, b]) for a, b in zip(out, (doc[done], at[done].astype(np.int64), anchor[done]))]
        first = order[new]
        return pa.RecordBatch.from_arrays([pa.array(parts[0]), pa.array(parts[1].astype(np.int64)), pa.array(parts[2].astype(np.int64))], ["doc_id", "start", "stop"]), (key[first], docs[first])

    kept: list[pa.RecordBatch] = []
    before = none
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        if sum(x.num_rows for x in kept) < held:
            continue
        rows = pa.Table.from_batches(kept)
        anchor = rows.column("anchor").to_numpy()
        if cut := int(np.searchsorted(anchor, anchor[-1])):
            yield matched(rows.slice(0, cut), before)[0]
            before, kept = none, rows.slice(cut).to_batches()
        else:  # all rows held are of one anchor
            found, before = matched(rows, before)
            kept = []
            yield found
    if kept:
        yield matched(pa.Table.from_batches(kept), before)[0]


def mark(text: str) -> Column:
    return F.pmod(F.xxhash64(F.col(text).cast("string")), F.lit(1 << MARK_BITS))


def repeats(docs: DataFrame, size: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """doc_id, mark (of the row's text), start and stop, in words: spans of words that a document with a smaller id has; they may overlap."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), mark("text").alias("mark"))
    rows = own.mapInArrow(lambda x: _anchors(x, size, seed), ROW)
    rows = rows.withColumn("deal", F.when(F.octet_length("prints") > 0, F.col("anchor")).otherwise(F.xxhash64("doc_id", "at")))
    rows = rows.repartition("deal").drop("deal").sortWithinPartitions("anchor", "doc_id")
    found = rows.mapInArrow(lambda x: _extend(x, size), "doc_id long, start long, stop long")
    word = lambda c: F.col(c).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int").alias(c)
    return found.select("doc_id", F.shiftright("start", PLACE_BITS).alias("mark"), word("start"), word("stop"))


def cut_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (the words left, joined by single blanks) and removed, the spans of words cut."""
    spans = repeats(docs, size).groupBy(F.col("doc_id").alias("s_id"), F.col("mark").alias("s_mark")).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows without a doc_id have no spans; a number of their own deals them to all tasks, and -1 is no mark
    own = own.select("doc_id", "text", F.coalesce("doc_id", F.monotonically_increasing_id()).alias("k_id"), F.when(F.col("doc_id").isNull(), -1).otherwise(mark("text")).alias("k_mark"))
    joined = own.join(spans, (F.col("k_id") == F.col("s_id")) & (F.col("k_mark") == F.col("s_mark")), "left").select("doc_id", "text", "spans")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for batch in chunks(batches):
            n_words, n_removed, kept, removed = [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                words = text.encode().split() if text else []
                n_words.append(len(words))
                left, cuts, at = [], [], 0
                for s in spans or ():
                    if s["stop"] > at:
                        start = max(at, s["start"])
                        left += words[at:start]
                        if cuts and cuts[-1]["stop"] == start:
                            cuts[-1]["stop"] = s["stop"]
                        else:
                            cuts.append({"start": start, "stop": s["stop"]})
                        at = s["stop"]
                left += words[at:]
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
                removed.append(cuts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept), pa.array(removed, kind)], ["doc_id", "n_words", "n_removed", "kept_text", "removed"])

    return joined.mapInArrow(each, "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:int,stop:int>>")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = cut_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: DuckDB SQL for op4_substrings.
ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM d, range(1, len(w) - 11) r(i)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS least FROM x),
h AS (SELECT DISTINCT doc_id, p FROM m, range(i, i + 13) r(p) WHERE doc_id > least),
q AS (SELECT doc_id, p, w[p] AS word FROM d, range(1, len(w) + 1) r(p)),
k AS (SELECT q.doc_id, q.p, q.word, h.p IS NOT NULL AS gone FROM q LEFT JOIN h ON h.doc_id = q.doc_id AND h.p = q.p),
s AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM k GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)
"""
