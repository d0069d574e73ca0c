"""Near copies by the Jaccard similarity of five-word shingles, found by SimHash prints in a Gray-order tree.

Prints of 64 bits cannot hold 0.8 and more apart from 0.7, and longer ones have no selective keys of whole blocks at
so many differing bits. So texts are dealt by other keys: `ROWS` least values of the shingles under as many orders, of
`BANDS` such bands. A pair of similarity s shares none with a chance of (1 - s**ROWS)**BANDS: 1.3e-7 at 0.8, and less
above. Texts that keys lead to are a family. A task has whole families; it sorts their 256-bit prints by Gray rank,
finds pairs within `LIMIT` bits by the tree, and holds each against the whole sets of shingles unless its ends are in
one component already: a pair below 0.8 is never linked. A pair at 0.8 differs in 39 bits, 80 is seven deviations off
(48 bits and five deviations for the smallest sets, of four and five shingles). What leaves the task is a spanning
forest, never the pairs.

A family over `FAMILY` texts or `SHINGLES` shingles is not held by one task. Each member of a key is first measured
against the key's centre, which meets most others; those that are near it are in one component then. For keys in which
several components are left, all texts but those of the largest are compared with all texts of the key, in pairs of
parts. So a group of near copies around one text costs its length, and a group in which all are a little below 0.8 to
each other its square.

Nulls and odd rows: texts of fewer than five words are one shingle; null and empty texts have none and are alike.
Equal sets (by 64-bit hash) meet in one row before any join. Rows without a doc_id are linked but name no component.
An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import cut, small
from tessera.llm.graph import components
from tessera.llm.tree import gray_order, near_pairs, whole_groups
from tessera.llm.words import Prefix, chunks, grams, mix, split

SHINGLE = 5
BANDS, ROWS = 40, 5
#: Of 256 bits, so many may differ in a pair that is measured.
LIMIT = 80
#: What one task holds of a family, in texts and in shingles.
FAMILY, SHINGLES = 2048, 1 << 22
#: Hashes of the texts whose sets are wanted are broadcast up to so many, eight bytes each.
LISTED_ROWS = 1_000_000
#: A centre of more pairs has its set copied to a part for each so many.
PART_PAIRS = 256
_ORDERS = np.random.default_rng(20_240_608).integers(1, 2**63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WORDS = np.random.default_rng(20_240_609).integers(1, 2**63, 4, np.uint64) * np.uint64(2) + np.uint64(1)
NEAR = "9 * shared >= 4 * (na + nb)"


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different runs of k words of each text, sorted, and where each text's begin; one more at the end."""
    w = split(column, lower=True)
    hashes = w.hashes()
    runs = grams(hashes, k)
    inside = w.text[: len(runs)] == w.text[k - 1 :]
    n = np.diff(w.first)
    short = np.flatnonzero((n > 0) & (n < k))
    values = np.concatenate([runs[inside], Prefix(hashes).of(w.first[short], w.first[short + 1])])
    text = np.concatenate([w.text[: len(runs)][inside], short])
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[fresh], np.searchsorted(text[fresh], np.arange(len(column) + 1))


def _prints(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each set, zero for an empty one, and the numbers of those that are not empty."""
    n = np.diff(first)
    some = np.flatnonzero(n)
    out = np.zeros(len(n), np.uint64)
    if len(some):
        out[some] = mix(np.add.reduceat(mix(values), first[some]) + n[some].astype(np.uint64))
    return out, some


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values.view(np.int64)))


def sketches(texts: DataFrame) -> DataFrame:
    """doc_id and hash of each row of `texts`, with the print and size of its set and the keys of its bands."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            values, first = shingle_sets(batch.column("text"))
            prints, some = _prints(values, first)
            n = np.diff(first)
            keys = np.zeros((len(some), BANDS), np.uint64)
            for b in range(BANDS if len(some) else 0):
                key = np.full(len(some), b, np.uint64)
                for order in _ORDERS[b]:
                    key = mix(key * _STEP + np.minimum.reduceat(values * order, first[some]))
                keys[:, b] = key
            made = [pa.array(prints.view(np.int64)), pa.array(n, pa.int64()), _lists(keys.ravel(), np.where(n > 0, BANDS, 0))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), *made], ["doc_id", "hash", "print", "n", "keys"])

    return texts.mapInArrow(each, "doc_id long, hash long, print long, n long, keys array<long>")


def sets(texts: DataFrame) -> DataFrame:
    """print and shingles, the set, for each row of `texts`."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            values, first = shingle_sets(batch.column("text"))
            prints = _prints(values, first)[0]
            yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), _lists(values, np.diff(first))], ["print", "shingles"])

    return texts.select("text").mapInArrow(each, "print long, shingles array<long>")


def measured(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """pairs (a, b) with the sizes of both sets and of what they share. A frequent `a` is dealt out in parts."""
    pairs = cut(pairs)
    hot = pairs.groupBy("a").count().where(F.col("count") > PART_PAIRS).select("a", F.ceil(F.col("count") / PART_PAIRS).cast("int").alias("parts"))
    hot = small(cut(hot))
    parts = F.coalesce("parts", F.lit(1))
    dealt = pairs.join(hot, "a", "left").select("a", "b", F.pmod(F.hash("b"), parts).alias("part"))
    few = lambda side: held.join(small(cut(pairs.select(F.col(side).alias("print")).distinct())), "print", "left_semi")
    ends = few("a").select(F.col("print").alias("a"), F.col("shingles").alias("x")).join(hot, "a", "left")
    ends = ends.select("a", "x", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    both = dealt.join(few("b").select(F.col("print").alias("b"), F.col("shingles").alias("y")), "b").join(ends, ["a", "part"])
    return cut(both.select("a", "b", F.size("x").alias("na"), F.size("y").alias("nb"), F.size(F.array_intersect("x", "y")).alias("shared")))


def wide_prints(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SimHash prints of 256 bits, as four words, of sets that are not empty: set `i` is values[first[i] : first[i + 1]]."""
    votes = np.zeros((len(first) - 1, 256), np.int32)
    for at in range(0, len(values), 1 << 15):
        until = min(at + (1 << 15), len(values))
        bits = np.unpackbits(mix(values[at:until, None] * _WORDS).view(np.uint8).reshape(-1, 32), axis=1)
        low, high = np.searchsorted(first, at, "right") - 1, np.searchsorted(first, until)
        votes[low:high] += np.add.reduceat(bits, np.maximum(first[low:high], at) - at, axis=0, dtype=np.int32)
    return np.packbits(2 * votes > np.diff(first)[:, None], axis=1).view(np.uint64)


def _spanning(values: np.ndarray, first: np.ndarray, group: np.ndarray, label: np.ndarray, asked: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links a, b of 0.8 or more between sets of the same group that are not in one component yet.

    label: equal for sets of one component, to begin with and as links are found. Of each pair, one is asked for.
    """
    order = gray_order(prints := wide_prints(values, first), group)
    size, rank = np.diff(first), np.unique(values, return_inverse=True)[1]
    own = np.zeros(rank.max() + 1, bool)
    for a, b in near_pairs(prints[order], group[order], LIMIT):
        a, b = order[a], order[b]
        some = (asked[a] | asked[b]) & (label[a] != label[b]) & (5 * np.minimum(size[a], size[b]) >= 4 * np.maximum(size[a], size[b]))
        a, b = a[some], b[some]
        often = np.bincount(np.concatenate([a, b]), minlength=len(size))
        swap = often[a] < often[b]  # stars of the ends that have most pairs come first: most others join them
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        by = np.lexsort((b, a, -often[a]))
        a, b = a[by], b[by]
        for star in np.split(np.arange(len(a)), np.flatnonzero(np.diff(a)) + 1) if len(a) else ():
            x, others = a[star[0]], b[star]
            others = others[label[others] != label[x]]
            if not len(others):
                continue
            own[mine := rank[first[x] : first[x + 1]]] = True
            n = size[others]
            places = np.arange(n.sum()) + np.repeat(first[others] - (np.cumsum(n) - n), n)
            shared = np.add.reduceat(own[rank[places]], np.cumsum(n) - n, dtype=np.int64)
            own[mine] = False
            for y in others[9 * shared >= 4 * (n + size[x])].tolist():
                if label[x] != label[y]:
                    label[label == label[y]] = label[x]
                    yield x, y


def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows come sorted by `keys`: whole groups with their sets, as values and where each begins, the groups' numbers, and labels by group and root."""
    for table in whole_groups(batches, keys):
        table = table.combine_chunks()
        lists = table.column("shingles").chunk(0)
        first = np.asarray(lists.offsets).astype(np.int64)
        values, first = np.asarray(lists.values).view(np.uint64)[first[0] : first[-1]], first - first[0]
        group = table.column("group").to_numpy()
        label = np.unique(np.stack([group, table.column("root").to_numpy()]), axis=1, return_inverse=True)[1].ravel()
        yield table, values, first, group, label


def _family_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """print and first, the smallest one of its component, for whole families."""
    for table, values, first, group, label in _grouped(batches, ("family",)):
        for _ in _spanning(values, first, group, label, np.ones(len(group), bool)):
            pass
        least = np.full(label.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, label, own := table.column("first").to_numpy())
        changed = least[label] < own
        yield pa.RecordBatch.from_arrays([pa.array(table.column("print").to_numpy()[changed]), pa.array(least[label][changed])], ["print", "first"])


def _key_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links a, b of the texts of each part of a key; of a pair, one is asked for."""
    for table, values, first, group, label in _grouped(batches, ("key", "i", "j")):
        prints = table.column("print").to_numpy()
        ends = list(_spanning(values, first, group, label, table.column("asked").to_numpy(zero_copy_only=False).astype(bool)))
        a, b = np.array(ends, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(prints[a]), pa.array(prints[b])], ["a", "b"])


def _within_keys(held: DataFrame, met: DataFrame) -> DataFrame:
    """Links a, b that span the components of each key's texts, for families that no task holds. met: key, print, n."""
    weight = met.join(met.groupBy("key").agg(F.count("*").alias("members")), "key").groupBy("print").agg(F.sum("members").alias("weight"))
    met = cut(met.join(weight, "print"))
    centre = met.groupBy("key").agg(F.max(F.struct("weight", "print")).getField("print").alias("centre"))
    stars = met.join(centre, "key").where("print <> centre").select(F.col("centre").alias("a"), F.col("print").alias("b")).distinct()
    near = cut(measured(stars, held).where(NEAR).select("a", "b"))
    roots = cut(components(near))
    met = cut(met.join(roots, F.col("print") == F.col("node"), "left").select("key", "print", "n", F.coalesce("root", "print").alias("root")))
    by_root = met.groupBy("key", "root").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles"))
    by_key = by_root.groupBy("key").agg(F.max(F.struct("texts", "root")).alias("most"), F.sum("texts").alias("texts"), F.sum("shingles").alias("shingles")).where("texts > most.texts")
    parts = lambda texts, shingles: F.greatest(F.ceil(texts / (FAMILY / 4)), F.ceil(shingles / (SHINGLES / 4)), F.lit(1)).cast("int")
    part = F.col("texts") - F.col("most.texts")
    by_key = cut(by_key.select("key", F.col("most.root").alias("main"), parts(F.col("texts"), F.col("shingles")).alias("all_parts"), parts(part, F.col("shingles") * part / F.col("texts")).alias("far_parts")))
    dealt = met.join(small(by_key), "key").withColumn("far", F.col("root") != F.col("main"))
    every = dealt.select("key", "print", "root", F.pmod(F.hash("print"), "all_parts").alias("i"), F.explode(F.sequence(F.lit(0), F.col("far_parts") - 1)).alias("j"), F.lit(False).alias("asked"))
    asked = dealt.where("far").select("key", "print", "root", F.explode(F.sequence(F.lit(0), F.col("all_parts") - 1)).alias("i"), F.pmod(F.hash("print"), "far_parts").alias("j"), F.lit(True).alias("asked"))
    dealt = every.union(asked).groupBy("key", "i", "j", "print", "root").agg(F.max("asked").alias("asked"))
    rows = dealt.join(held, "print").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return near.union(rows.mapInArrow(_key_links, "a long, b long"))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id and component_id, the smallest doc_id that links of 0.8 or more lead to, for every row of docs."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    rows = cut(sketches(texts))
    none = F.lit(2**63 - 1)  # stands for no doc_id
    nodes = rows.groupBy("print").agg(F.coalesce(F.min("doc_id"), none).alias("first"), F.min("hash").alias("hash"), F.min("n").alias("n"), F.first("keys").alias("keys"))
    nodes = cut(nodes)
    met = nodes.select("print", "n", F.explode("keys").alias("key"))
    keys = met.groupBy("key").agg(F.count("*").alias("members"), F.min("print").alias("least")).where("members > 1")
    met = cut(met.join(keys, "key").select("key", "print", "n", "least"))
    family = components(met.where("print <> least").select(F.col("least").alias("a"), F.col("print").alias("b")))
    family = cut(nodes.join(family, F.col("print") == F.col("node")).select("print", "n", "hash", "first", F.col("root").alias("family")))
    sizes = family.groupBy("family").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles"))
    wide = cut(sizes.where((F.col("texts") > FAMILY) | (F.col("shingles") > SHINGLES)).select("family"))
    wanted = small(family.select("hash"), LISTED_ROWS)
    held = sets(texts.join(wanted, "hash", "left_semi")).groupBy("print").agg(F.first("shingles").alias("shingles"))
    ids = nodes.select("print", "first")
    if wide.isEmpty():
        part = family
    else:
        held, wide = cut(held), small(wide)
        part = family.join(wide, "family", "left_anti")
        large = family.join(wide, "family", "left_semi").select("print", "first")
        roots = cut(components(_within_keys(held, met.join(large.select("print"), "print", "left_semi").select("key", "print", "n"))))
        named = roots.join(large, F.col("node") == F.col("print")).select("print", "first", "root")
        least = named.groupBy("root").agg(F.min("first").alias("least"))
        ids = ids.union(named.join(least, "root").select("print", "least"))
    part = part.select("family", "print", F.col("print").alias("root"), "first")
    part = part.join(held, "print").repartition("family").sortWithinPartitions("family")
    ids = ids.union(part.mapInArrow(_family_ids, "print long, first long")).groupBy("print").agg(F.min("first").alias("first"))
    return rows.select("doc_id", "print").join(ids, "print").select("doc_id", F.nullif("first", none).alias("component_id"))
