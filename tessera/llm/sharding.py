"""Sharding by Karmarkar-Karp differencing: equal texts stay together, and shards come out near equal in bytes.

Equal texts (by a 64-bit hash; should two meet, they just stay together) are one group, whose bytes are summed. Groups are dealt to blocks of about
`BLOCK_GROUPS`; in each, the partial partitions with the largest spread are combined again and again, oppositely
ordered, until one is left. A block's result is itself a partial partition, so blocks are combined in the same way,
`BLOCK_GROUPS` at a time, until there is one; each level adds a permutation to every part's shard.

Nulls and odd rows: a null text is an empty one, of one byte; rows without a doc_id are rows like others. Repeated
rows get slots of their own. An empty table gives an empty one. A group of more than a shard's share stays whole.
Other columns pass through, but for one named as our output, which is replaced.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.base import cut, fresh, small, table

SHARDS = 8
BLOCK_GROUPS = 2000
#: Rows of a shard that are numbered in one group; a shard has as many such slices as its share of all rows asks for.
SLICE_ROWS = 8192


def differencing(tuples: list[list[int]]) -> list[list[int]]:
    """For each of some tuples of sizes, the part into which each of its places goes, so that the parts' sums are near equal."""
    k = len(tuples[0])
    heap = []
    for n, sizes in enumerate(tuples):
        order = sorted(range(k), key=lambda p: -sizes[p])
        heap.append((min(sizes) - max(sizes), n, [sizes[p] for p in order], [[(n, p)] for p in order]))
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        (_, _, a, pa), (_, _, b, pb) = heapq.heappop(heap), heapq.heappop(heap)
        sums = [x + y for x, y in zip(a, reversed(b))]
        held = [(x, y) if len(x) >= len(y) else (y, x) for x, y in zip(pa, reversed(pb))]
        for x, y in held:
            x.extend(y)
        order = sorted(range(k), key=lambda p: -sums[p])
        low = sums[order[-1]]
        count += 1
        heapq.heappush(heap, (low - sums[order[0]], count, [sums[p] - low for p in order], [held[p][0] for p in order]))
    out = [[0] * k for _ in tuples]
    for part, members in enumerate(heap[0][3]):
        for n, p in members:
            out[n][p] = part
    return out


def _combine(parts: DataFrame, blocks: int, shards: int) -> DataFrame:
    """parts (id, sizes: an array) dealt to blocks; for each, its block and `goes`, the block's part for each of its own."""

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")
        sizes = [list(map(int, x)) for x in rows["sizes"]]
        goes = differencing(sizes)
        sums = [0] * shards
        for own, to in zip(sizes, goes):
            for size, part in zip(own, to):
                sums[part] += size
        return pd.DataFrame({"id": rows["id"], "block": rows["block"], "goes": goes, "sums": [sums] * len(rows)})

    dealt = parts.withColumn("block", F.pmod(F.xxhash64("id", F.lit(blocks)), F.lit(blocks)))
    return cut(dealt.groupBy("block").applyInPandas(each, "id long, block long, goes array<int>, sums array<long>"))


def assign(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """groups (id, size), ids distinct, with the shard of each."""
    sizes = F.concat(F.array(F.col("size").cast("long")), F.array_repeat(F.lit(0).cast("long"), shards - 1))
    parts, n = groups.select("id", sizes.alias("sizes")), groups.count()
    levels = []
    while True:
        blocks = -(-n // BLOCK_GROUPS) or 1
        levels.append(_combine(parts, blocks, shards))
        if blocks == 1:
            break
        parts = levels[-1].groupBy(F.col("block").alias("id")).agg(F.first("sums").alias("sizes"))
        n = blocks
    goes = levels.pop().select(F.col("id").alias("block"), F.col("goes").alias("to"))
    while levels:  # from the last level down, the final shard of each part of a block
        below = levels.pop().join(small(goes), "block")
        goes = below.select(F.col("id").alias("block"), F.transform("goes", lambda p: F.get("to", p)).alias("to"))
    return goes.select(F.col("block").alias("id"), F.get("to", F.lit(0)).alias("shard"))


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text", carry: bool = True, out: str = "sharded") -> DataFrame:
    """docs with a struct column `out`: size, text_crc32, shard and slot. carry=False leaves out the texts."""
    columns = [c for c in docs.columns if c != out and (carry or c != text)]
    whole = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("s_row"), "doc_id", (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("crc"), F.xxhash64(whole).alias("id"))
    if not carry:
        own = cut(own)
    shard_of = assign(cut(own.groupBy("id").agg(F.sum("size").alias("size"))), shards)
    slices = -(-own.count() // (shards * SLICE_ROWS)) or 1
    slice_ = F.pmod(F.xxhash64("doc_id", "id"), F.lit(slices))
    placed = own.join(shard_of, "id").withColumn("slice", slice_)
    if carry:
        counts = own.select("doc_id", "id").join(shard_of, "id")
        counts = counts.withColumn("slice", slice_)
    else:
        placed = counts = cut(placed)
    filled = counts.groupBy("shard", "slice").count()
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    filled = cut(filled.select(F.col("shard").alias("f_shard"), F.col("slice").alias("f_slice"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before")))
    within = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("doc_id", "crc", "id"))
    placed = placed.withColumn("within", within).join(small(filled), (F.col("shard") == F.col("f_shard")) & (F.col("slice") == F.col("f_slice")))
    slot = (F.col("before") + F.col("within") - 1).cast("long")
    return placed.select(*[F.col("s_row").getField(c).alias(c) for c in columns], F.struct("size", F.col("crc").alias("text_crc32"), "shard", slot.alias("slot")).alias(out))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """A folder of Parquet files for each shard, rows in the order of their slots within each file."""
    done = shard(docs, shards)
    done = done.select(*[c for c in done.columns if c != "sharded"], "sharded.shard", "sharded.slot")
    done.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = shard(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=False)
    return done.select("doc_id", "sharded.size", "sharded.text_crc32", F.lit("bytes").alias("law"), "sharded.shard", "sharded.slot", F.lit(None).cast("int").alias("grown_shard"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot; columns of these names that they had before are replaced."""
    out = fresh(docs, "sharded")
    own = [f"`{c}`" for c in docs.columns if c.lower() not in ("shard", "slot")]
    return shard(docs, out=out).select(*own, f"{out}.shard", f"{out}.slot")
