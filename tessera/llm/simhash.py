"""SimHash near-duplicates: fingerprints linked at a few differing bits, found by a Gray-order hierarchical index.

Fingerprints are cut into `BLOCKS` blocks of bits; two that differ in at most `limit` bits agree on all but `limit`
blocks, so each choice of BLOCKS - limit blocks is a key that deals them to tasks. A task sorts its rows by key and
Gray rank and builds one tree over them: runs of rows share masked bit patterns in the upper nodes, and pairs of nodes
of different keys, or whose shared patterns already differ too much, are pruned as a whole. Each key yields a
spanning forest only, never its pairs.

Nulls and odd rows: a null text is an empty one, with fingerprint zero, linked like any other; rows without a
doc_id are linked but name no component (a component of such rows alone has a null id). Copies share a fingerprint
and meet in one row before any join. An empty table gives an empty result. Only named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.base import cut, small, table
from tessera.llm.graph import Forest, components
from tessera.llm.jaccard import near_copies
from tessera.llm.tree import gray_order, gray_rank, near_pairs, whole_groups
from tessera.llm.words import chunks

BLOCKS = 6
LIMIT = 4
SHINGLE = 4
SEED = 42
#: Rows of one key that one task compares; more are dealt out as pairs of parts of so many rows.
PART_ROWS = 4096
#: The ids of rows that go are broadcast up to so many, eight bytes each.
LISTED_ROWS = 1_000_000


def fingerprint(words: list[bytes], k: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half of the hashes of the shingles."""
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    stops = (ends[min(k, len(words)) - 1 :] - 1).tolist()
    starts = [0, *ends[: len(stops) - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops)], ">u8")
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        votes += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id and `print`, the fingerprint as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = [fingerprint(x.encode().lower().split(), k) if x else 0 for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each, "doc_id long, print long")


def forest(prints: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """For each of some distinct prints, which are sorted by Gray rank, the position of its tree's first."""
    trees = Forest(len(prints))
    for a, b in near_pairs(prints[:, None], np.zeros(len(prints), np.int64), limit):
        trees.link(a, b)
    return trees.root


def _key_links(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key, i and j; the links of each such group, as stars around the smallest print, so that keys agree on them."""
    for table in whole_groups(batches, ("key", "i", "j")):
        prints, group = table.column("print").to_numpy(), table.column("group").to_numpy()
        alike = np.lexsort((prints, group))
        prints, group = prints[alike], group[alike]  # the smallest print of a tree is then its first
        words = np.ascontiguousarray(prints).view(np.uint64)[:, None]
        order, trees = gray_order(words, group), Forest(len(prints))
        for a, b in near_pairs(words[order], group[order], limit):
            trees.link(order[a], order[b])
        held = trees.root != np.arange(len(prints))
        yield pa.RecordBatch.from_arrays([pa.array(prints[held]), pa.array(prints[trees.root[held]])], ["a", "b"])


def linked(prints: DataFrame, limit: int = LIMIT, blocks: int = BLOCKS) -> DataFrame:
    """`node` and `root` for every print, a column of distinct longs, that has another one within `limit` bits."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    bits = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    masks = [sum(bits[i] for i in chosen) for chosen in combinations(range(blocks), blocks - limit)]
    masks = F.array(*[F.lit(m - 2**64 if m >= 2**63 else m).cast("long") for m in masks])
    keys = F.transform(masks, lambda m: F.xxhash64(m, F.col("print").bitwiseAND(m)))
    rows = prints.select("print", F.explode(keys).alias("key"))
    hot = rows.groupBy("key").count().where(F.col("count") > PART_ROWS).select("key", F.ceil(F.col("count") / PART_ROWS).cast("int").alias("n"))
    dealt = rows.join(small(cut(hot)), "key", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("own", F.pmod(F.hash("print"), "n"))
    dealt = dealt.select("key", "print", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "print")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return components(dealt.mapInArrow(lambda x: _key_links(x, limit), "a long, b long"))


def near_duplicates(docs: DataFrame, limit: int = LIMIT, k: int = SHINGLE, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, print and component_id, the smallest doc_id that links lead to, for every row of docs."""
    prints = cut(fingerprints(docs, k))
    distinct = prints.groupBy("print").agg(F.min("doc_id").alias("first"))
    roots = cut(linked(cut(distinct.select("print")), limit, blocks))
    named = distinct.join(roots, F.col("print") == F.col("node"), "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    named = cut(named)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(named.join(least, "root").select("print", "component_id"), "print").select("doc_id", "print", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: that with its smallest doc_id. Of repeated rows one stays; rows without a doc_id stay if no other such row has their text.

    Links are of 0.8 or more in the Jaccard similarity of five-word shingles, by `jaccard.near_copies`: prints of 64
    bits cannot tell 0.8 from 0.7, so its prints have 256, and what the tree finds is held against the shingles.
    Texts are not shuffled while the rows that go, or are there twice, can be broadcast.
    """
    own, hashed = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))
    found = cut(near_copies(docs))
    per_id = found.where("doc_id is not null").groupBy("doc_id", "component_id").count().groupBy("doc_id").agg(F.sum("count").alias("n"), F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("first"))
    per_id = cut(per_id.where("n > 1 or first = 0").select("doc_id", (F.col("first") == 1).alias("twice")))
    gone, twice = (small(x.select(F.col("doc_id").alias("id")), LISTED_ROWS) for x in (per_id, per_id.where("twice")))
    once = docs.where(own.isNotNull()).join(gone, own == gone["id"], "left_anti")
    lost, again = docs.where(own.isNull()), docs.where(own.isNotNull()).join(twice, own == twice["id"], "left_semi")
    plain = [F.col(f"`{c}`").cast("string") if "map<" in kind or "variant" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes]
    rows = lost.union(again).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), own.alias("id"), hashed.alias("hash"), F.struct(*plain).alias("place"))
    rows = rows.groupBy("id", "hash").agg(F.min_by("row", "place").alias("row"))
    return once.union(rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))
