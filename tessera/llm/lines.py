"""Line dedup: equal lines, and lines within a small edit distance, are kept once, where they first occur.

A segment-partition edit join. A line is cut into `LIMIT + 1` segments; of two lines within `LIMIT` edits one has a
segment that occurs unchanged in the other, at a place that lengths and segment number bound. So each line sends the
hashes of its segments (by number and length: the index) and of those of its substrings that could match segments of
lines as long or a little shorter (the probes). Lines that meet are first held against each other by letter counts
modulo four, then by banded bit-parallel edit distance, a batch of pairs at a time. Near lines form classes by
connected components, and a class keeps its first line by (doc_id, line number).

Lines that share a segment, a place and a length (those of a template) meet in one task up to `PART_ROWS`. Beyond that
the task passes their rows on; they are dealt to parts, and every two parts meet in a task of their own.

Only hashes, ids and counts go through the index's shuffle; the strings of candidates are joined to them afterwards.
Lines of under `MIN_CHARS` characters match only if equal. Lines without a word are neither counted nor dropped.

Nulls and odd rows: a null or empty text has no lines; a null doc_id comes first in order, and rows that share a
doc_id are ordered by line number alone (of repeated rows all keep the first occurrence). Empty tables give empty
results. Only named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.base import cut, small, table
from tessera.llm.graph import components
from tessera.llm.tree import whole_groups
from tessera.llm.words import Prefix, chunks, mix

LIMIT = 2
MIN_CHARS = 12
PAIRS_AT_ONCE = 1 << 20
#: Lines of one key that one task compares; more are dealt out as pairs of parts of so many.
PART_ROWS = 4096


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line and id, its hash; a document without lines has one row of nulls."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x, i: F.struct(i.alias("line_no"), x.alias("line"))), lambda r: r.line.rlike("[^\\x20\\x09-\\x0D]"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode_outer(lines).alias("r"))
    return rows.select("doc_id", "r.line_no", "r.line", _id(F.col("r.line")).alias("id"))


def _id(line: Column) -> Column:
    return F.when(line.isNotNull(), F.xxhash64(line))


def _segments(length: np.ndarray, limit: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Start and length of each of limit + 1 segments of lines of these lengths: even, the longer ones last."""
    n = limit + 1
    base, longer = length // n, length % n
    out, at = [], np.zeros_like(length)
    for i in range(n):
        size = base + (i >= n - longer)
        out.append((at, size))
        at = at + size
    return out


def keys(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, limit: int = LIMIT) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """For lines in an array of code points: keys, the lines that send them, and whether they are of the index as well."""
    prefix = Prefix(mix(points.astype(np.uint64) + np.uint64(1)))
    every = np.arange(len(starts))
    for shorter in range(limit + 1):
        own = lengths - shorter
        for i, (at, size) in enumerate(_segments(own, limit)):
            low = np.maximum(at - i, at + shorter - (limit - i))
            high = np.minimum(at + i, at + shorter + (limit - i))
            for shift in range(-limit, limit + 1):
                place = at + shift
                ok = (place >= low) & (place <= high) & (place >= 0) & (place + size <= lengths)
                if not ok.any():
                    continue
                who = every[ok]
                begin = starts[who] + place[ok]
                key = mix(prefix.of(begin, begin + size[ok]) + own[ok].astype(np.uint64) * np.uint64(8) + np.uint64(i))
                yield key, who, not shorter and not shift


def _sketch(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sixteen counts of letters modulo four in 32 bits."""
    bucket = (mix(points.astype(np.uint64)) >> np.uint64(60)).astype(np.int64)
    line = np.repeat(np.arange(len(starts)), lengths)
    inside = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    counts = np.bincount(line * 16 + bucket[inside], minlength=16 * len(starts)).reshape(-1, 16) & 3
    return (counts.astype(np.uint32) << (2 * np.arange(16, dtype=np.uint32))).sum(1, dtype=np.uint32)


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least sum of differences of two sketches' counts; an edit makes it at most 2."""
    total = np.zeros(len(a), np.uint32)
    for i in range(16):
        d = ((a >> np.uint32(2 * i)) - (b >> np.uint32(2 * i))) & np.uint32(3)
        total += np.minimum(d, 4 - d)
    return total


def _index(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, text="line"):
        ids = batch.column("id").to_numpy()
        first = np.unique(ids, return_index=True)[1]
        lines = batch.column("line").take(pa.array(first)).to_pylist()
        lengths = np.fromiter(map(len, lines), np.int64, len(lines))
        points = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
        starts, ids = np.cumsum(lengths) - lengths, ids[first]
        sketch = _sketch(points, starts, lengths).view(np.int32)
        for key, who, index in keys(points, starts, lengths, limit):
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[who]), pa.array(sketch[who]), pa.array(np.full(len(who), index))], ["key", "id", "sketch", "is_index"])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line of a chunk once."""
    for batch in chunks(batches, text="line"):
        first = np.unique(batch.column("id").to_numpy(), return_index=True)[1]
        yield batch.take(pa.array(np.sort(first)))


def _near_in_groups(group: np.ndarray, ids: np.ndarray, sketch: np.ndarray, index: np.ndarray, own: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ids of the same group, of which one is of the index, whose sketches are near; two rows of parts with the same number, other than -1, are left out. Rows come sorted by group."""
    at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    size = np.diff(at)
    of = np.repeat(np.arange(len(size)), size)
    left = np.flatnonzero(index & (size[of] > 1))
    sizes = size[of[left]]
    ends = np.cumsum(sizes)
    done = 0
    while done < len(left):
        until = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS_AT_ONCE)))
        n = sizes[done:until]
        a = np.repeat(left[done:until], n)
        b = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + at[of[a]]
        ok = (ids[a] != ids[b]) & ((own[a] != own[b]) | (own[a] < 0))
        a, b = a[ok], b[ok]
        ok = _far(sketch[a], sketch[b]) <= 2 * limit
        low, high = np.minimum(ids[a[ok]], ids[b[ok]]), np.maximum(ids[a[ok]], ids[b[ok]])
        if len(low):
            both = np.unique(np.stack([low, high]), axis=1)
            yield both[0], both[1]
        done = until


#: Kinds of rows that a meeting gives: a pair of ids, or a key and an id that is met later, which is of the index or is not.
PAIR, LATER, LATER_INDEX = 0, 1, 2
MET = "a long, b long, sketch int, kind int"


def _meet(batches: Iterator[pa.RecordBatch], limit: int, most: int, held: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Pairs of ids that meet on a key and whose sketches are near; rows come sorted by key. The rows of keys with over `most` different lines are passed on, and not held."""

    def out(a, b, sketch, kind) -> pa.RecordBatch:
        full = lambda v, t: pa.array(np.broadcast_to(np.asarray(v, t), len(a)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), full(sketch, np.int32), full(kind, np.int32)], ["a", "b", "sketch", "kind"])

    def once(rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        key, ids, _, index = rows
        order = np.lexsort((~index, ids, key))  # a line that many chunks send meets others once
        new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (ids[order][1:] != ids[order][:-1])])
        return tuple(x[order[new]] for x in rows)

    def later(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return out(rows[0], rows[1], rows[2].view(np.int32), np.where(rows[3], LATER_INDEX, LATER))

    def pairs(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        rows = once(rows)
        at = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1], [True]]))
        hot = np.repeat(np.diff(at) > most, np.diff(at))
        if hot.any():
            yield later(tuple(x[hot] for x in rows))
            rows = tuple(x[~hot] for x in rows)
        key, ids, sketch, index = rows
        for a, b in _near_in_groups(key, ids, sketch, index, np.full(len(key), -1), limit):
            yield out(a, b, 0, PAIR)

    kept: list[tuple[np.ndarray, ...]] = []
    hot = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "id", "sketch", "is_index"))
        rows = (rows[0], rows[1], rows[2].view(np.uint32), rows[3].astype(bool))
        if hot is not None and rows[0][0] == hot:
            n = int(np.searchsorted(rows[0], hot, "right"))
            yield later(once(tuple(x[:n] for x in rows)))
            rows = tuple(x[n:] for x in rows)
            if not len(rows[0]):
                continue
        kept.append(rows)
        if sum(len(x[0]) for x in kept) < held:
            continue
        rows = tuple(np.concatenate(x) for x in zip(*kept))
        if last := int(np.searchsorted(rows[0], rows[0][-1])):
            yield from pairs(tuple(x[:last] for x in rows))
            kept = [tuple(x[last:] for x in rows)]
        else:  # all rows held are of one key
            kept = [once(rows)]
            if len(kept[0][0]) > most:
                hot = rows[0][-1]
                yield later(kept.pop())
    if kept:
        yield from pairs(tuple(np.concatenate(x) for x in zip(*kept)))


def _meet_parts(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Pairs of ids of two parts of a key, or of one; rows come sorted by key, i and j."""
    for table in whole_groups(batches, ("key", "i", "j")):
        group, ids, sketch, own = (table.column(c).to_numpy() for c in ("group", "id", "sketch", "own"))
        own = np.where(table.column("i").to_numpy() == table.column("j").to_numpy(), -1, own)
        index = table.column("is_index").to_numpy(zero_copy_only=False).astype(bool)
        for a, b in _near_in_groups(group, ids, sketch.view(np.uint32), index, own, limit):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _later_pairs(late: DataFrame, limit: int) -> DataFrame:
    """Pairs a, b of the rows of hot keys: each key's lines are dealt to parts of about PART_ROWS, and every two parts meet in a task."""
    rows = late.groupBy(F.col("a").alias("key"), F.col("b").alias("id")).agg(F.first("sketch").alias("sketch"), F.max(F.col("kind") == LATER_INDEX).alias("is_index"))
    rows = cut(rows)
    n = small(cut(rows.groupBy("key").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("n"))))
    dealt = rows.join(n, "key").withColumn("own", F.pmod(F.hash("id"), "n")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "sketch", "is_index")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(lambda x: _meet_parts(x, limit), "a long, b long")


def within(a: list[str], b: list[str], limit: int = LIMIT) -> np.ndarray:
    """Which pairs of strings are within `limit` edits: banded bit-parallel edit distance, one column of all pairs at a time.

    Bit k of a word stands for the cell `limit - k` above the main diagonal's in the column at hand; the score is
    followed along the diagonal on which the last cell lies.
    """
    swap = [len(x) > len(y) for x, y in zip(a, b)]
    rows, cols = [y if s else x for x, y, s in zip(a, b, swap)], [x if s else y for x, y, s in zip(a, b, swap)]
    m, n = (np.fromiter(map(len, x), np.int64, len(x)) for x in (rows, cols))
    ok = n - m <= limit
    pad = limit + 1
    width = int(n.max(initial=0)) + 2 * pad

    def grid(strings: list[str], fill: int) -> np.ndarray:
        out = np.full((width, len(strings)), fill, np.uint32)
        for i, s in enumerate(strings):
            out[pad : pad + len(s), i] = np.frombuffer(s.encode("utf-32-le"), np.uint32)
        return out

    p, t = grid(rows, 0xFFFFFFFE), grid(cols, 0xFFFFFFFF)
    full = np.uint32((1 << (2 * limit + 1)) - 1)
    vp = np.full(len(a), (int(full) << limit) & int(full), np.uint32)
    vn = np.zeros(len(a), np.uint32)
    score, diagonal = n - m, np.maximum(limit - (n - m), 0).astype(np.uint32)
    for j in range(1, int(n.max(initial=0)) + 1):
        eq = np.zeros(len(a), np.uint32)
        for k in range(2 * limit + 1):
            at = pad + j - limit + k - 1
            if 0 <= at < width:
                eq |= (p[at] == t[pad + j - 1]).astype(np.uint32) << np.uint32(k)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        vp = (hn | ~((d0 >> np.uint32(1)) | hp)) & full
        vn = (d0 >> np.uint32(1)) & hp
        score = score + ((j > n - m) & (j <= n) & ((d0 >> diagonal) & np.uint32(1) == 0))
    return ok & (score <= limit)


def _verify(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("a_line").to_pylist(), batch.column("b_line").to_pylist()
        order = sorted(range(len(a)), key=lambda i: len(a[i]))
        near, at = [], 0
        while at < len(order):
            until = at + 1
            while until < len(order) and (until - at) * (len(a[order[until]]) + 8) < 2_000_000:
                until += 1
            own = np.array(order[at:until])
            near.append(own[within([a[i] for i in own], [b[i] for i in own], limit)])
            at = until
        found = pa.array(np.concatenate(near) if near else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(c).take(found) for c in ("a", "b")], ["a", "b"])


def near_lines(lines: DataFrame, limit: int = LIMIT, min_chars: int = MIN_CHARS) -> DataFrame:
    """a and b, ids of different lines within `limit` edits. lines: id and line, as line_rows gives them."""
    long = lines.where(F.length("line") >= min_chars).select("id", "line")
    sent = long.mapInArrow(lambda x: _index(x, limit), "key long, id long, sketch int, is_index boolean")
    sent = sent.repartition("key").sortWithinPartitions("key")
    most = PART_ROWS
    met = cut(sent.mapInArrow(lambda x: _meet(x, limit, most), MET))
    pairs, late = met.where(F.col("kind") == PAIR).select("a", "b"), met.where(F.col("kind") != PAIR)
    if not late.isEmpty():
        pairs = pairs.union(_later_pairs(late, limit))
    pairs = cut(pairs.distinct())
    wanted = pairs.select(F.col("a").alias("w")).union(pairs.select("b")).distinct()
    strings = cut(long.mapInArrow(_once, "id long, line string").join(wanted, F.col("id") == F.col("w")).groupBy("id").agg(F.any_value("line").alias("line")))
    both = pairs.join(strings.select(F.col("id").alias("a"), F.col("line").alias("a_line")), "a").join(strings.select(F.col("id").alias("b"), F.col("line").alias("b_line")), "b")
    return both.select("a", "b", "a_line", "b_line").mapInArrow(lambda x: _verify(x, limit), "a long, b long")


def dedup_lines(docs: DataFrame, limit: int = LIMIT, min_chars: int = MIN_CHARS) -> DataFrame:
    """Each line of docs but for its text: doc_id, line_no, chars, copy_of and near_of.

    copy_of is the (doc_id, line_no) of the first equal line, near_of that of the first line of its class; a line
    stays if near_of is itself. A document without lines has one row of nulls.
    """
    rows = line_rows(docs)
    roots = components(cut(near_lines(rows.where("line is not null"), limit, min_chars)))
    own = rows.select("doc_id", "line_no", F.length("line").alias("chars"), "id")
    first = own.where("id is not null").groupBy("id").agg(F.min(F.struct("doc_id", "line_no")).alias("copy_of"))
    first = cut(first.join(roots, F.col("id") == F.col("node"), "left").select("id", "copy_of", F.coalesce("root", "id").alias("root")))
    least = first.groupBy("root").agg(F.min("copy_of").alias("near_of"))
    named = first.join(least, "root").select(F.col("id").alias("n_id"), "copy_of", "near_of")
    return own.join(named, F.col("id") == F.col("n_id"), "left").select("doc_id", "line_no", "chars", "copy_of", "near_of")


def drop_lines(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """docs with `text` without the lines that occur before, or near before; rows that share a doc_id lose the same lines. Other columns pass through, whatever their names."""
    here = F.struct("doc_id", "line_no")
    gone = dedup_lines(docs, limit).where(here != F.col("near_of")).groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    row = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = row.join(gone.withColumnRenamed("doc_id", "g_id"), F.col("doc_id").eqNullSafe(F.col("g_id")), "left")
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i))
    return joined.select(*[F.array_join(left, "\n").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, those equal to an earlier one, those near one (and not equal), characters kept, and the documents in which its near lines first occur."""
    rows = dedup_lines(table(spark, sf_dir, "documents"))
    here = F.struct("doc_id", "line_no")
    copy = here != F.col("copy_of")
    near = ~copy & (here != F.col("near_of"))
    n = lambda c: F.count(F.when(c, True))
    return rows.groupBy("doc_id").agg(F.count("line_no").alias("n_lines"), n(copy).alias("n_copies"), n(near).alias("n_near"), F.coalesce(F.sum(F.when(~copy & ~near, F.col("chars"))), F.lit(0)).cast("long").alias("kept_chars"), F.sort_array(F.collect_set(F.when(near, F.col("near_of.doc_id")))).alias("near_docs"))
