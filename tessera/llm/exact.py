"""Exact dedup against an index of the past: a minimal perfect hash over distinct digests, with their winners in its slots.

A text's digest is the SHA-256 of its UTF-8 bytes with A-Z in lower case. The index is a table: digests are dealt to
shards by hash, and a shard has a row for each batch of documents that it has taken in. Such a row holds a minimal
perfect hash of its digests (levels of bits; a digest's slot is the rank of the one bit that it alone sets) and, by
slot, the full digest, the winner's locator (doc_id and row) and how many rows have the digest. The hash gives a slot
to digests that it has never seen, so a lookup counts only where all 32 bytes agree.

A batch is first grouped by digest, which combines in the tasks, so copies are not sent. In each shard the groups are
looked up: members update their slot, the others are hashed by themselves and become a new row of the shard. At last
each document looks up its own winner. Digests of more rows than one in `HOT_PARTS` of all (and `HOT_ROWS`), which are
`HOT_PARTS` at most, are looked up in an index that every task has; so no group of copies meets in one task.

Nulls and odd rows: a null text is an empty one. Rows without a doc_id are documents like others, with the least id;
if no row of a group has one, keep_id is null. Of rows that share the largest doc_id one stays; which one is not
defined. An empty table gives an empty one. Other columns pass through, but for one named as our output, which is
replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tessera.llm.base import cut, table
from tessera.llm.words import LOWER, mix

#: Rows of a batch for each shard of a new index; bits of a level for each digest that is left.
SHARD_ROWS, GAMMA = 2048, 2
HOT_ROWS, HOT_PARTS = 256, 10_000
INDEX = "shard long, n int, levels array<int>, bits binary, digests binary, ids array<long>, rows array<long>, sizes array<long>"


class PerfectHash:
    """Digests, as rows of four 64-bit words, to the slots 0 to n - 1, each its own."""

    def __init__(self, levels: list[int], bits: np.ndarray):
        self.levels, self.bits, self.rank = levels, bits, np.cumsum(bits) - bits

    @staticmethod
    def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
        a, b = words[:, 2 * level % 4], words[:, (2 * level + 1) % 4]
        return (mix(a ^ mix(b + np.uint64(level))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, words: np.ndarray) -> PerfectHash:
        """Digests, all different. On each level those that have a bit to themselves set it; the others go on."""
        levels, bits, left = [], [], words
        while len(left):
            size = GAMMA * len(left)
            at = cls._place(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(size)
            bits.append(alone)
            left = left[~alone[at]]
        return cls(levels, np.concatenate(bits) if bits else np.zeros(0, bool))

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of each digest; of one that was not hashed any slot or -1."""
        out, left, base = np.full(len(words), -1), np.arange(len(words)), 0
        for level, size in enumerate(self.levels):
            at = base + self._place(words[left], level, size)
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left, base = left[~hit], base + size
        return out


def _bytes(column: pa.Array) -> np.ndarray:
    """Digests as rows of 32 bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


class Slots:
    """A row of the index."""

    def __init__(self, shard: int, hashed: PerfectHash, digests: np.ndarray, ids: list, rows: list, sizes: list):
        self.shard, self.hashed, self.digests, self.ids, self.rows, self.sizes = shard, hashed, digests, ids, rows, sizes

    @classmethod
    def of(cls, shard: int, digests: np.ndarray, ids: list, rows: list, sizes: list) -> Slots:
        words = digests.view(np.uint64)
        hashed = PerfectHash.of(words)
        order = np.empty(len(digests), int)
        order[hashed.slots(words)] = np.arange(len(digests))
        return cls(shard, hashed, digests[order], *[[x[i] for i in order] for x in (ids, rows, sizes)])

    @classmethod
    def read(cls, r: dict) -> Slots:
        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=sum(r["levels"])).astype(bool)
        return cls(r["shard"], PerfectHash(r["levels"], bits), np.frombuffer(r["digests"], np.uint8).reshape(-1, 32), r["ids"], r["rows"], r["sizes"])

    def row(self) -> dict:
        return {"shard": self.shard, "n": len(self.ids), "levels": self.hashed.levels, "bits": np.packbits(self.hashed.bits).tobytes(), "digests": self.digests.tobytes(), "ids": self.ids, "rows": self.rows, "sizes": self.sizes}

    def find(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest that is a member by all its bytes, else -1."""
        at = self.hashed.slots(digests.view(np.uint64))
        known = np.flatnonzero(at >= 0)
        out = np.full(len(digests), -1)
        same = known[(self.digests[at[known]] == digests[known]).all(1)]
        out[same] = at[same]
        return out


def found(slots: list[Slots], digests: np.ndarray) -> tuple[list, list, list]:
    """id, row and size of the winner of each digest, None where no row of the index has it."""
    out = [[None] * len(digests) for _ in range(3)]
    for s in slots:
        at = s.find(digests)
        for i in np.flatnonzero(at >= 0).tolist():
            out[0][i], out[1][i], out[2][i] = s.ids[at[i]], s.rows[at[i]], s.sizes[at[i]]
    return tuple(out)


INDEX_ARROW = pa.schema([("shard", pa.int64()), ("n", pa.int32()), ("levels", pa.list_(pa.int32())), ("bits", pa.binary()), ("digests", pa.binary()), *[(c, pa.list_(pa.int64())) for c in ("ids", "rows", "sizes")]])


def absorb(index: DataFrame, groups: DataFrame) -> DataFrame:
    """The index with a batch: groups (shard, digest, id, row, size) update the slots of their digest or get slots of their own."""

    def each(old: pa.Table, new: pa.Table) -> pa.Table:
        slots = [Slots.read(r) for r in old.to_pylist()]
        if new.num_rows:
            digests, left = _bytes(new.column("digest")), np.ones(new.num_rows, bool)
            ids, rows, sizes = (new.column(c).to_pylist() for c in ("id", "row", "size"))
            for s in slots:
                at = s.find(digests)
                for i in np.flatnonzero(at >= 0).tolist():
                    k = at[i]
                    if ids[i] is not None and (s.ids[k] is None or (ids[i], rows[i]) > (s.ids[k], s.rows[k])) or ids[i] is s.ids[k] is None and rows[i] > s.rows[k]:
                        s.ids[k], s.rows[k] = ids[i], rows[i]
                    s.sizes[k] += sizes[i]
                left &= at < 0
            if left.any():
                pick = np.flatnonzero(left).tolist()
                slots.append(Slots.of(new.column("shard")[0].as_py(), digests[left], *[[x[i] for i in pick] for x in (ids, rows, sizes)]))
        return pa.Table.from_pylist([s.row() for s in slots], INDEX_ARROW)

    return cut(index.groupBy("shard").cogroup(groups.groupBy("shard")).applyInArrow(each, INDEX))


def digested(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """s_row (a struct of columns), id, digest and row, a number of its own; checkpointed, so that the numbers stay."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("s_row"), F.col("doc_id").cast("long").alias("id"), F.col(text).cast("string").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [hashlib.sha256((t or "").encode().translate(LOWER)).digest() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("s_row"), batch.column("id"), pa.array(digests, pa.binary())], ["s_row", "id", "digest"])

    kind = StructType([own.schema["s_row"], own.schema["id"], StructField("digest", BinaryType())])
    return cut(own.mapInArrow(each, kind).withColumn("row", F.monotonically_increasing_id()))


def _dealt(rows: DataFrame, shards: int) -> DataFrame:
    return rows.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))


def grouped(rows: DataFrame, shards: int) -> DataFrame:
    """A batch's groups: each digest with its winner and how many rows have it."""
    best = F.max(F.struct("id", "row")).alias("best")
    return _dealt(rows.groupBy("digest").agg(best, F.count("*").alias("size")), shards).select("shard", "digest", "best.id", "best.row", "size")


def empty_index(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], INDEX)


def dedup(docs: DataFrame, text: str = "text", carry: bool = True, out: str = "exact", index: DataFrame | None = None, shards: int = 0) -> DataFrame:
    """docs with a struct column `out`: keep_id, group_size, kept and text_sha256. carry=False leaves out the texts.

    `index`, with the number of its shards, is what earlier documents have left; without one, the documents up to the
    middle of the range of ids are the past of the others.
    """
    columns = [c for c in docs.columns if c.lower() != out.lower() and (carry or c != text)]
    rows = digested(docs, columns, text)
    sizes = rows.agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).first()
    n = sizes["n"]
    if index is None:
        index, shards = empty_index(docs.sparkSession), -(-n // SHARD_ROWS) or 1
        if sizes["low"] is not None:
            middle = F.col("id") <= (sizes["low"] + sizes["high"]) // 2
            index = absorb(index, grouped(rows.where(middle), shards))
            index = absorb(index, grouped(rows.where(~F.coalesce(middle, F.lit(False))), shards))
        else:
            index = absorb(index, grouped(rows, shards))
    else:
        index = absorb(index, grouped(rows, shards))
    return winners(rows, index, shards, n).select(*[F.col("s_row").getField(c).alias(c) for c in columns], F.struct("keep_id", "group_size", ((F.col("row") == F.col("keep_row")) & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")).alias(out))


def winners(rows: DataFrame, index: DataFrame, shards: int, n: int) -> DataFrame:
    """rows with keep_id, keep_row and group_size by lookups in an index that holds their digests."""
    common = rows.groupBy("digest").count().where(F.col("count") > max(HOT_ROWS, n // HOT_PARTS)).select("digest")
    hot = [bytes(r["digest"]) for r in common.collect()]  # at most HOT_PARTS
    names = rows.columns
    schema = StructType([*rows.schema.fields, *StructType.fromDDL("keep_id long, keep_row long, group_size long").fields])

    def with_found(columns: dict, slots: list[Slots], digests: np.ndarray) -> dict:
        ids, own, sizes = found(slots, digests)
        return columns | {"keep_id": pa.array(ids, pa.int64()), "keep_row": pa.array(own, pa.int64()), "group_size": pa.array(sizes, pa.int64())}

    def of_shard(old: pa.Table, new: pa.Table) -> pa.Table:
        columns = {c: new.column(c) for c in names}
        return pa.table(with_found(columns, [Slots.read(r) for r in old.to_pylist()] if new.num_rows else [], _bytes(new.column("digest"))))

    rows = _dealt(rows, shards)
    if not hot:
        return index.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(of_shard, schema)
    top = rows.sparkSession.createDataFrame([(bytearray(h),) for h in hot], "digest binary")
    asked = _dealt(top, shards).select(F.struct("digest").alias("s"), "digest", "shard")
    own = StructType([*StructType.fromDDL("digest binary, keep_id long, keep_row long, group_size long").fields])

    def of_top(old: pa.Table, new: pa.Table) -> pa.Table:
        return pa.table(with_found({"digest": new.column("digest")}, [Slots.read(r) for r in old.to_pylist()] if new.num_rows else [], _bytes(new.column("digest"))))

    got = index.join(F.broadcast(asked.select("shard").distinct()), "shard", "left_semi").groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(of_top, own).collect()
    held = Slots.of(0, _bytes(pa.array([bytes(r["digest"]) for r in got], pa.binary())), *[[r[c] for r in got] for c in ("keep_id", "keep_row", "group_size")])
    shared = rows.sparkSession.sparkContext.broadcast(held)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c) for c in names}
            yield pa.RecordBatch.from_pydict(with_found(columns, [shared.value], _bytes(batch.column("digest"))))

    met = rows.select(*names).mapInArrow(known, schema)
    rest = _dealt(met.where("group_size is null").select(*names), shards)
    return met.where("group_size is not null").unionByName(index.groupBy("shard").cogroup(rest.groupBy("shard")).applyInArrow(of_shard, schema))


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=False)
    return done.select("doc_id", "exact.keep_id", "exact.group_size", "exact.kept", "exact.text_sha256")


#: DuckDB SQL for op12_exact.
ORACLE = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256 FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
