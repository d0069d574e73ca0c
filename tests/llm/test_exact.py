"""Exact dedup: the perfect hash by itself, and the operator against brute force."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import exact
from tessera.llm.exact import PerfectHash, Slots


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def digests(n, seed=0):
    return np.frombuffer(b"".join(hashlib.sha256(f"{seed} {i}".encode()).digest() for i in range(n)), np.uint8).reshape(-1, 32)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 500, 5000])
def test_perfect_hash(n):
    """Every digest has a slot of its own among as many as there are digests; others are told apart by their bytes."""
    own, other = digests(n), digests(3000, 1)
    hashed = PerfectHash.of(own.view(np.uint64))
    assert sorted(hashed.slots(own.view(np.uint64)).tolist()) == list(range(n))
    slots = Slots.read(Slots.of(0, own, list(range(n)), [7 * i for i in range(n)], [1] * n).row())
    at = slots.find(own)
    assert [slots.ids[i] for i in at] == list(range(n)) and [slots.rows[i] for i in at] == [7 * i for i in range(n)]
    assert (slots.find(other) == -1).all()
    if n > 100:
        assert (hashed.slots(other.view(np.uint64)) >= 0).any()  # strangers get slots too; only the bytes tell
        twin = own[:50].copy()
        twin[:, 31] ^= 1
        assert (slots.find(twin) == -1).all()


def test_digests_that_share_words():
    """Digests that differ in one of four words only are separated all the same."""
    own = np.zeros((200, 32), np.uint8)
    own[:, 25] = np.arange(200)
    assert sorted(PerfectHash.of(own.view(np.uint64)).slots(own.view(np.uint64)).tolist()) == list(range(200))


def check(got, rows):
    groups = collections.defaultdict(list)
    for i, text in rows:
        groups[lower(text)].append(i)
    seen = collections.Counter()
    for r in got:
        text = r.text
        ids = groups[lower(text)]
        best = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size) == (best, len(ids)) and r.text_sha256 == hashlib.sha256(lower(text).encode()).hexdigest()
        assert not r.kept or r.doc_id == best
        seen[lower(text)] += r.kept
    assert len(got) == len(rows) and set(seen.values()) == {1} and len(seen) == len(groups)


@pytest.mark.parametrize("hot", [256, 3])
def test_dedup(spark, rows, docs, none, monkeypatch, hot):
    """Copies in upper case, nulls, repeated rows and ids, clashing columns; with common digests in the broadcast index and without."""
    monkeypatch.setattr(exact, "HOT_ROWS", hot)
    monkeypatch.setattr(exact, "SHARD_ROWS", 16)
    more = spark.createDataFrame([(1000, rows[3][1].upper(), "en", "s", 1), (-5, "ÀÉ", "en", "s", 1), (-6, "àé", "en", "s", 1), (None, "lone", "en", "s", 1)], docs.schema)
    own = docs.union(more).withColumns({c: F.lit("own") for c in ("digest", "row", "id", "shard", "exact", "keep_id", "s_row")}).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    done = exact.dedup(own.repartition(5))
    assert done.columns == [c for c in own.columns if c != "exact"] + ["exact"]
    got = done.select("doc_id", "text", "digest", "shard", "m", "exact.*").toDF("doc_id", "text", "own", "own2", "m", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert {(r.own, r.own2) for r in got} == {("own", "own")} and all(r.m == {"k": 1} for r in got)
    check(got, [(r.doc_id, r.text) for r in own.collect()])
    assert exact.dedup(none).count() == 0
    check(exact.dedup(spark.createDataFrame([(None, "a"), (None, "A"), (None, None)], "doc_id long, text string")).select("doc_id", "text", "exact.*").collect(), [(None, "a"), (None, "A"), (None, None)])


def test_past_of_several_batches(spark, rows):
    """An index that has taken in three batches, one after another, knows the winners of all; members and others alike."""
    parts = [spark.createDataFrame([r[:2] for r in rows[k::3]], "doc_id long, text string") for k in range(3)]
    index = exact.empty_index(spark)
    for n, part in enumerate(parts):
        own = exact.digested(part, ["doc_id", "text"]).withColumn("row", F.col("row") + n * 1_000_000)
        index = exact.absorb(index, exact.grouped(own, 4))
    held = [Slots.read(r.asDict()) for r in index.collect()]
    assert len({(s.shard, i) for i, s in enumerate(held)}) > 4  # shards have rows of several batches
    want = collections.defaultdict(list)
    for i, text, *_ in rows:
        want[hashlib.sha256(lower(text).encode()).digest()].append(i)
    got = {bytes(d): (i, n) for s in held for d, i, n in zip(s.digests, s.ids, s.sizes)}
    assert sum(len(s.ids) for s in held) == len(got)
    assert got == {d: (max((i for i in x if i is not None), default=None), len(x)) for d, x in want.items()}
    again = exact.dedup(parts[0], index=index, shards=4)
    assert all(not r.exact.kept or r.exact.keep_id == r.doc_id for r in again.collect())
