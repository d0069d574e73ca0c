"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax, beside unigram counts.

The model gives each token the probability of its class, from the two tokens before it, times that of the token in
its class. A class is the end of a text, one of the most frequent words, or all other words that share a hash of
their last two bytes. Class scores are sums of weights of hashed features: the word before (n-gram), the one before
that alone (skip) and both together, each in a table of 2**BITS rows. Each task trains on its share of the training
texts by mini-batches of gradient updates; the tasks' weights are averaged row by row, by how often each was updated,
in a grouping. Texts are scored in sparse numpy batches. Within a class, tokens have add-one unigram probabilities.

Counts: each chunk of text sends a row for each different token, which a grouping sums. The tokens that most documents
have, `LISTED` at most, are sent back with their counts, and their logarithms are added where the text is. All others
are in few documents: they are sent as postings (documents and frequencies) to where their counts are known, and sums
of logarithms go back to the documents. Ends are counted by row. So no token's postings gather over a bounded share.
Nothing else that grows with the corpus passes the driver: it sees class totals, the listed tokens, and the averaged
weights, 3 * 2**BITS + 1 rows of CLASSES numbers.

Training rows are dealt by a hash of their doc_id and text to shards of about `SHARD_TOKENS`, each in a stated order,
in `ROUNDS` parts; every part begins with the weights averaged after the last. So scores do not depend on how rows lay.

Tokens are told apart by 64-bit hashes. Nulls and odd rows: a null text is an empty one, which has its end token; a
null doc_id counts as the text ''. Rows that share a doc_id are scored each by itself; other columns than doc_id and
text are not returned. An empty table gives an empty one; a corpus with no training row scores by its add-one terms
alone.

What is left out: within a class, tokens have unigram probabilities, so context tells words of one class apart by
nothing but their counts, and adds log2(CLASSES) = 5 bits a token at most. A second softmax over the words of a class
would double the time of training and scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.base import cut, partitions, small, table
from tessera.llm.words import Words, chunks, mix, split

BITS = 13
FREQUENT = 11
SHAPES = 20
CLASSES = 1 + FREQUENT + SHAPES
CHUNK = 6 << 20
TRAIN_CHUNK = 1 << 20
BATCH = 8192
RATE = 2.0
END = np.uint64(0x1F83D9ABFB41BD6B)
BEGIN = np.uint64(0x5BE0CD19137E2179)
NO_ID = -(2**63)
FOLDS, HELD = 7, 2
#: At most so many tokens are listed: those in more than a LISTED-th of all pairs of a document and its token.
LISTED = 1 << 18
SHARD_TOKENS, SHARDS_AT_MOST = 1 << 19, 8192
ROUNDS = 2


@dataclass
class Tokens:
    """The tokens of a chunk, each text's words and then its end: hashes, shapes, each one's text, and where texts begin."""

    hash: np.ndarray
    shape: np.ndarray
    text: np.ndarray
    starts: np.ndarray


def tokens(words: Words) -> Tokens:
    n, texts = len(words.starts), len(words.first) - 1
    at, ends = np.arange(n) + words.text, words.first[1:] + np.arange(texts)
    hashes, shape, text = np.full(n + texts, END), np.full(n + texts, SHAPES, np.int8), np.zeros(n + texts, np.int64)
    if n:
        hashes[at] = words.hashes()
        last, before = words.data[words.ends - 1].astype(np.uint64), words.data[np.maximum(words.ends - 2, 0)].astype(np.uint64)
        before[words.ends - words.starts < 2] = 0
        shape[at] = mix(last * np.uint64(256) + before) % np.uint64(SHAPES)
    text[at], text[ends] = words.text, np.arange(texts)
    return Tokens(hashes, shape, text, words.first[:-1] + np.arange(texts))


@dataclass
class Listed:
    """The tokens that most documents have, sorted by hash, and log10(c + 1) of each; -1 where c is zero."""

    token: np.ndarray
    log_count: np.ndarray

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens are listed, and the logarithms of those that are."""
        if not len(self.token):
            return np.zeros(len(hashes), bool), np.zeros(0)
        at = np.minimum(np.searchsorted(self.token, hashes), len(self.token) - 1)
        same = self.token[at] == hashes
        return same, self.log_count[at[same]]


def _by_document(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, shape, text and frequency of each token of each text, without ends, sorted by hash and text."""
    words = np.flatnonzero(t.shape != SHAPES)
    order = words[np.lexsort((t.text[words], t.hash[words]))]
    h, d = t.hash[order], t.text[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])) if len(h) else np.zeros(0, np.int64)
    return h[new], t.shape[order][new], d[new], np.diff(np.append(new, len(h)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each token of a chunk: how often training texts have it, and how many texts do."""
    for batch in chunks(batches, CHUNK):
        h, shape, d, times = _by_document(tokens(split(batch.column("text"), lower=True)))
        if len(h):
            times = np.where(batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)[d], 0, times)
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(shape[at].astype(np.int32)), pa.array(np.add.reduceat(times, at)), pa.array(np.diff(np.append(at, len(h))))], ["token", "shape", "n", "texts"])


def _postings(batches: Iterator[pa.RecordBatch], listed: Listed) -> Iterator[pa.RecordBatch]:
    """A row for each token of a chunk that is not listed: how often training texts have it, and its postings: low halves of keys, then frequencies."""
    for batch in chunks(batches, CHUNK):
        h, _, d, times = _by_document(tokens(split(batch.column("text"), lower=True)))
        rare = ~listed.of(h)[0]
        h, d, times = h[rare], d[rare], times[rare]
        if not len(h):
            continue
        parts = -(-times // 255)  # a frequency is one byte; larger ones take several postings
        who = np.repeat(np.arange(len(h)), parts)
        last = np.cumsum(parts) - 1
        freq = np.full(len(who), 255, np.int64)
        freq[last] = times - 255 * (parts - 1)
        held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        h, doc, count = h[who], batch.column("key").to_numpy()[d[who]], np.where(held[d[who]], 0, freq)
        high, low = doc >> 32, (doc & 0xFFFFFFFF).astype(np.uint32)
        if (high != high[0]).any():
            order = np.lexsort((high, h))
            h, count, high, low, freq = (x[order] for x in (h, count, high, low, freq))
        at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (high[1:] != high[:-1])]))
        sizes = np.diff(np.append(at, len(h)))
        ends = np.cumsum(sizes)
        data = np.empty(5 * len(h), np.uint8)
        inside = np.arange(len(h)) - np.repeat(ends - sizes, sizes)
        base = 5 * np.repeat(ends - sizes, sizes)
        for k in range(4):
            data[base + 4 * inside + k] = (low >> np.uint32(8 * k)).astype(np.uint8)
        data[base + 4 * np.repeat(sizes, sizes) + inside] = freq
        offsets = np.concatenate([[0], 5 * ends]).astype(np.int32)
        binary = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(np.add.reduceat(count, at)), pa.array(high[at]), binary], ["token", "n", "high", "postings"])


ENTRY = np.dtype([("key", np.int64), ("x", np.float64), ("known", np.int32)])


def _added(entries: np.ndarray) -> np.ndarray:
    """One entry a key: sums of log10(c + 1) and of known tokens."""
    keys, inverse = np.unique(entries["key"], return_inverse=True)
    out = np.zeros(len(keys), ENTRY)
    out["key"] = keys
    for name in ("x", "known"):
        out[name] = np.bincount(inverse, entries[name], len(keys))
    return out


def _sums(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by token. Out: for each block of keys the entries of those met here, packed."""
    waiting: list[tuple[np.ndarray, ...]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        entries = np.zeros(sum(len(x[0]) for x in waiting), ENTRY)
        for name, parts in zip(ENTRY.names, zip(*waiting)):
            entries[name] = np.concatenate(parts)
        waiting.clear()
        entries = _added(entries)
        block = (mix(entries["key"].copy().view(np.uint64)) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        at = np.flatnonzero(np.diff(block[order], prepend=-1))
        yield pa.RecordBatch.from_arrays([pa.array(block[order][at]), pa.array([x.tobytes() for x in np.split(entries[order], at[1:])], pa.binary())], ["block", "packed"])

    def settle(part: pa.Table) -> None:
        token, n, high = (part.column(c).to_numpy() for c in ("token", "n", "high"))
        binary = part.column("postings").combine_chunks()
        binary = binary.chunk(0) if isinstance(binary, pa.ChunkedArray) else binary
        offsets = np.frombuffer(binary.buffers()[1], np.int32)[binary.offset : binary.offset + len(binary) + 1].astype(np.int64)
        data = np.frombuffer(binary.buffers()[2], np.uint8)
        at = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        c = np.repeat(np.add.reduceat(n, at), np.diff(np.append(at, len(token))))
        sizes = np.diff(offsets) // 5
        inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        base = np.repeat(offsets[:-1], sizes)
        low = sum(data[base + 4 * inside + k].astype(np.int64) << (8 * k) for k in range(4))
        freq = data[base + 4 * np.repeat(sizes, sizes) + inside].astype(np.float64)
        c = np.repeat(c, sizes)
        waiting.append(((np.repeat(high, sizes) << 32) | low, freq * np.log10(c + 1.0), freq * (c > 0)))

    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        token = batch.column("token").to_numpy()
        if token[0] != token[-1] and sum(x.num_rows for x in kept) >= 100_000:
            last = int(np.searchsorted(token, token[-1]))
            settle(pa.Table.from_batches([*kept[:-1], batch.slice(0, last)]))
            kept = [batch.slice(last)]
            if sum(len(x[0]) for x in waiting) >= 3_000_000:
                yield from flush()
    if kept:
        settle(pa.Table.from_batches(kept))
    if waiting:
        yield from flush()


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of each key of this task's blocks, added."""
    held: list[np.ndarray] = []
    for batch in batches:
        held += [np.frombuffer(x, ENTRY) for x in batch.column("packed").to_pylist()]
        if sum(map(len, held)) > 2_000_000:
            held = [_added(np.concatenate(held))]
    if held:
        e = _added(np.concatenate(held))
        yield pa.RecordBatch.from_arrays([pa.array(e["key"].copy()), pa.array(e["x"].copy()), pa.array(e["known"].astype(np.int64))], ["key", "x", "known"])


@dataclass
class Classes:
    """Frequent tokens, sorted by hash, with their classes and counts; and for each shape the logarithm of its total."""

    token: np.ndarray
    number: np.ndarray
    log_count: np.ndarray
    log_total: np.ndarray

    def of(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Each token's class, and what is taken from its log10(c + 1) to give its log10 probability in its class."""
        out = np.where(t.shape == SHAPES, 0, 1 + FREQUENT + t.shape.astype(np.int64))
        minus = self.log_total[t.shape]
        if len(self.token):
            at = np.minimum(np.searchsorted(self.token, t.hash), len(self.token) - 1)
            same = self.token[at] == t.hash
            out[same], minus[same] = self.number[at[same]], self.log_count[at[same]]
        return out, minus


def _features(t: Tokens) -> np.ndarray:
    """Rows of the weight table for each token: of the word before, of the one before that, and of both."""
    one, two = np.empty_like(t.hash), np.empty_like(t.hash)
    one[1:], two[2:] = t.hash[:-1], t.hash[:-2]
    two[:2] = BEGIN
    one[t.starts] = two[t.starts] = BEGIN
    second = t.starts[t.starts + 1 < len(t.hash)] + 1
    second = second[t.text[second] == t.text[second - 1]]
    two[second] = BEGIN
    rows = [mix(one), mix(two + np.uint64(1)), mix(one * np.uint64(3) + mix(two))]
    return np.stack([(x >> np.uint64(64 - BITS)).astype(np.int64) + (i << BITS) for i, x in enumerate(rows)])


def _log_softmax(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    scores = weights[features[0]]
    for f in features[1:]:
        scores += weights[f]
    scores += weights[-1]
    scores -= scores.max(1, keepdims=True)
    scores -= np.log(np.exp(scores).sum(1, keepdims=True))
    return scores


def _train(batches: Iterator[pa.RecordBatch], classes: Classes, begin: np.ndarray, seen: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each shard, whose rows come together: weights after one pass of gradient updates over its texts, from `begin`, times their updates, and the updates. seen: updates before."""
    weights, updates, shard = begin.copy(), np.zeros(len(begin), np.int64), None

    def done() -> pa.RecordBatch:
        rows = np.flatnonzero(updates)
        return pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(updates[rows]), *[pa.array((weights[rows, c] * updates[rows]).astype(np.float32)) for c in range(CLASSES)]], ["row", "n", *[f"w{c}" for c in range(CLASSES)]])

    def learn(texts: pa.Array) -> None:
        t = tokens(split(texts, lower=True))
        features, (target, _) = _features(t), classes.of(t)
        for at in range(0, len(target), BATCH):
            f, y = features[:, at : at + BATCH], target[at : at + BATCH]
            slope = np.exp(_log_softmax(weights, f))
            slope[np.arange(len(y)), y] -= 1
            for rows in f:
                order = np.argsort(rows)
                own = rows[order]
                new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                step = np.add.reduceat(slope[order], new)
                own, n = own[new], np.diff(np.append(new, len(order)))
                updates[own] += n
                weights[own] -= (RATE / np.sqrt(n * (seen[own] + updates[own])))[:, None].astype(np.float32) * step
            updates[-1] += len(y)
            weights[-1] -= RATE / np.sqrt(len(y) * (seen[-1] + updates[-1])) * slope.sum(0)

    for batch in chunks(batches, TRAIN_CHUNK):
        shards = batch.column("shard").to_numpy()
        ends = [*(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for at, until in zip([0, *ends], ends):
            if shards[at] != shard:
                if shard is not None:
                    yield done()
                    weights[:], updates[:] = begin, 0
                shard = shards[at]
            learn(batch.column("text").slice(at, until - at))
    if shard is not None:
        yield done()


def _score(batches: Iterator[pa.RecordBatch], classes: Classes, weights: np.ndarray, listed: Listed) -> Iterator[pa.RecordBatch]:
    """Each row's share of the model's classes, and the sums of log10(c + 1) and of known tokens over listed ones."""
    for batch in chunks(batches, TRAIN_CHUNK):
        t = tokens(split(batch.column("text"), lower=True))
        features, (target, minus) = _features(t), classes.of(t)
        value = np.empty(len(target))
        for at in range(0, len(target), BATCH):
            y = target[at : at + BATCH]
            value[at : at + BATCH] = _log_softmax(weights, features[:, at : at + BATCH])[np.arange(len(y)), y]
        value = value / np.log(10) - minus
        n = np.diff(np.append(t.starts, len(target)))
        same, logs = listed.of(t.hash)
        x = np.bincount(t.text[same], np.maximum(logs, 0), len(n)).astype(float)
        known = np.bincount(t.text[same], logs >= 0, len(n)).astype(np.int64)
        made = [pa.array(n), pa.array(np.add.reduceat(value, t.starts)), pa.array(x), pa.array(known)]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "key", "copies", "held_out")], *made], ["doc_id", "key", "copies", "held_out", "n_tokens", "part", "x", "known"])


def _keyed(rows: DataFrame) -> DataFrame:
    """rows (id, hash) with `key`, which only rows of equal id and hash share, and `copies`, how many do.

    A key is the id where all its rows have one text; the others get numbers beyond all ids.
    """
    ids = cut(rows.groupBy("id", "hash").agg(F.count("*").alias("copies")))
    many = ids.groupBy("id").agg(F.count("*").alias("texts")).where("texts > 1")
    odd = ids.join(many, "id", "left").where("texts > 1 or copies > 1")
    odd = cut(odd.select(F.col("id").alias("o_id"), F.col("hash").alias("o_hash"), F.col("copies").alias("o_copies"), (F.col("texts") > 1).alias("many"), F.monotonically_increasing_id().alias("number")))
    if odd.isEmpty():
        return rows.select("*", F.col("id").alias("key"), F.lit(1).cast("long").alias("copies"))
    ends = ids.where(F.col("id") != NO_ID).agg(F.min("id").alias("least"), F.max("id").alias("most")).first()
    least, most, room = ends["least"] or 0, ends["most"] or 0, 1 << 54
    if most + room < 2**63:
        first = most + 1
    elif least - room > NO_ID:
        first = NO_ID + 1
    else:
        raise ValueError("doc_ids leave no room for keys of rows that share a doc_id")
    odd = odd.select("o_id", "o_hash", "o_copies", F.when(F.col("many"), F.lit(first) + F.col("number")).otherwise(F.col("o_id")).alias("o_key"))
    met = rows.join(small(odd), (F.col("id") == F.col("o_id")) & (F.col("hash") == F.col("o_hash")), "left")
    return met.select(*rows.columns, F.coalesce("o_key", "id").alias("key"), F.coalesce("o_copies", F.lit(1)).alias("copies"))


def score_texts(docs: DataFrame, folds: int = FOLDS, held: int = HELD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, for each row of docs.

    The model learns from rows whose doc_id's crc32 leaves another remainder than `held` by `folds`.
    """
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"), (fold == held).alias("held_out")))

    counts = own.select("text", "held_out").mapInArrow(_counts, "token long, shape int, n long, texts long")
    counts = cut(counts.groupBy("token").agg(F.first("shape").alias("shape"), F.sum("n").alias("n"), F.sum("texts").alias("texts")))
    ends = own.where("not held_out").count()
    shapes = {r["shape"]: (r["n"], r["seen"]) for r in counts.groupBy("shape").agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("seen")).collect()}
    shapes[SHAPES] = (ends, int(ends > 0))
    train, vocabulary = (sum(x[i] for x in shapes.values()) for i in (0, 1))
    top = counts.where("n > 0").orderBy(F.desc("n"), "token").limit(FREQUENT).collect()
    totals = np.array([sum(shapes.get(s, (0, 0))) for s in range(SHAPES + 1)], float)
    for r in top:
        totals[r["shape"]] -= r["n"] + 1
    log_total = np.log10(totals + 1)
    log_total[SHAPES] = np.log10(ends + 1.0)  # an end is alone in its class
    order = sorted(range(len(top)), key=lambda i: top[i]["token"] % 2**64)
    classes = Classes(np.array([top[i]["token"] % 2**64 for i in order], np.uint64), np.array([1 + i for i in order], np.int64), np.log10([top[i]["n"] + 1.0 for i in order]), log_total)

    pairs = counts.agg(F.sum("texts")).first()[0] or 0
    common = counts.where(F.col("texts") > pairs / LISTED).select("token", "n").toPandas()
    token, n = common["token"].to_numpy(np.int64).view(np.uint64), common["n"].to_numpy(np.float64)
    by = np.argsort(token)
    listed = send(Listed(token[by], np.where(n > 0, np.log10(n + 1.0), -1.0)[by]))
    rows = own.select("key", "text", "held_out").mapInArrow(lambda x: _postings(x, listed.value), "token long, n long, high long, postings binary")
    blocks = partitions(own)
    found = rows.repartition("token").sortWithinPartitions("token").mapInArrow(lambda x: _sums(x, blocks), "block long, packed binary")
    found = cut(found.repartition("block").mapInArrow(_documents, "key long, x double, known long"))

    weights, seen = np.zeros((3 * 2**BITS + 1, CLASSES), np.float32), np.zeros(3 * 2**BITS + 1, np.int64)
    shards = min(SHARDS_AT_MOST, -(-train // (ROUNDS * SHARD_TOKENS)) or 1)
    for i in range(ROUNDS):
        begin = send((classes, weights, seen))
        part = own.where(~F.col("held_out") & (F.pmod(F.xxhash64("hash", "id"), F.lit(ROUNDS)) == i))
        part = part.select(F.pmod(F.xxhash64("id", "hash"), F.lit(shards)).alias("shard"), "id", "hash", "text")
        part = part.repartition("shard").sortWithinPartitions("shard", "id", "hash").select("shard", "text")
        trained = part.mapInArrow(lambda x, begin=begin: _train(x, *begin.value), "row int, n long, " + ", ".join(f"w{c} float" for c in range(CLASSES)))
        mean = trained.groupBy("row").agg(F.sum("n").alias("n"), *[F.sum(f"w{c}").alias(f"w{c}") for c in range(CLASSES)])
        weights, seen = weights.copy(), seen.copy()
        for r in mean.collect():
            weights[r[0]] = np.array(r[2:]) / r[1]
            seen[r[0]] += -(-r[1] // shards)
    shared = send((classes, weights))

    parts = own.select("doc_id", "key", "copies", "held_out", "text").mapInArrow(lambda x: _score(x, *shared.value, listed.value), "doc_id long, key long, copies long, held_out boolean, n_tokens long, part double, x double, known long")
    sums = found.select(F.col("key").alias("s_key"), F.col("x").alias("s_x"), F.col("known").alias("s_known"))
    done = parts.join(sums, F.col("key") == F.col("s_key"), "left")
    x = F.col("x") + F.lit(float(log_total[SHAPES])) + F.coalesce(F.col("s_x") / F.col("copies"), F.lit(0.0))
    known = F.col("known") + int(ends > 0) + F.coalesce(F.floor(F.col("s_known") / F.col("copies")), F.lit(0))
    out_of = F.lit(float(np.log10(train + vocabulary + 1)))
    return done.select("doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(int(train)).cast("long").alias("train_tokens"), (x - F.col("n_tokens") * out_of).alias("base_score"), (x + F.col("part")).alias("score"))


def op10_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
