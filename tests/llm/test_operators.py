"""Operators against brute force on a small table with every odd row, on an empty table, and with clashing columns."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import decontaminate, graph, licenses, lines, maxent, mixing, quality, sharding, simhash, substrings, urls

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def split(text):
    return WORD.findall(text or "")


def clash(df, *names):
    return df.withColumns({n: F.lit("own") for n in names})


def key(r):
    return tuple((x is None, x) for x in r)


def multiset(rows):
    return sorted(map(tuple, rows), key=key)


# 1 mixing


def test_mixing(spark, docs, rows, none):
    got = mixing.mix(clash(docs, "m_size", "target", "m_row")).select("doc_id", "source", "target", "mixed.*").toDF("doc_id", "source", "own", "size", "source_size", "target", "copies").collect()
    assert len(got) == len(rows) and {r.own for r in got} == {"own"}
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(split(r[1]))
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] < level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and r.copies <= 2
        taken[r.source] += r.size * r.copies
    biggest = {s: max(len(split(r[1])) for r in rows if r[3] == s) for s in sizes}
    assert all(abs(taken[s] - target[s]) <= biggest[s] for s in sizes)
    assert multiset(got) == multiset(mixing.mix(clash(docs.repartition(7), "m_size", "target", "m_row")).select("doc_id", "source", "target", "mixed.*").collect())
    assert mixing.mix(none).count() == 0


def test_mixing_inclusion(spark):
    """Over many sources of equal make, documents are taken as often as their chances say, and certain ones always."""
    sizes, n = [1, 2, 3, 5, 8, 13, 21, 34, 55, 400] * 3, 240
    made = [(s * 1000 + i, " ".join(["w"] * k), f"{s:05d}") for s in range(n) for i, k in enumerate(sizes)]
    got = mixing.mix(spark.createDataFrame(made, "doc_id long, text string, source string"), share=0.5, weights=(1,)).collect()
    left, sure = 0.5 * sum(sizes), []
    while True:
        rest = [k for k in sizes if k not in sure]
        scale = (left - sum(k for k in sizes if k in sure)) / sum(k * math.floor(1024 * k**0.5) for k in rest)
        if scale * math.floor(1024 * max(rest) ** 0.5) < 1:
            break
        sure.append(max(rest))
    taken = collections.Counter()
    for r in got:
        assert r.mixed.target == pytest.approx(left) and r.mixed.copies <= 1
        taken[r.mixed.size] += r.mixed.copies
    for k in set(sizes):
        p, m = 1.0 if k in sure else scale * math.floor(1024 * k**0.5), 3 * n
        assert abs(taken[k] / m - p) <= 5 * math.sqrt(p * (1 - p) / m) + 0.03, (k, taken[k] / m, p)


def test_mixing_oracle(spark, data):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    got = mixing.op1_mixing(spark, data)
    assert multiset(got.collect()) == multiset(c.execute(f"SELECT {', '.join(got.columns)} FROM ({mixing.ORACLE})").fetchall())


# 2 licences


def test_licenses(spark, docs, none):
    made = [(1, "Foo. Under the MIT License: yes; under\nthe mit license. cc-by-nc!"), (2, "// SPDX-License-Identifier: (MIT OR GPL-2.0) AND Apache-2.0 WITH LLVM-exception\nApache License, Version 2.0"), (3, None), (4, "SPDX-License-Identifier: MIT OR\n"), (5, "undER the mit licenses")]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 1, 10, ["cc-by-nc", "mit"])
    assert got[2].labels == ["apache-2", "apache-2.0 with llvm-exception", "gpl-2.0", "mit"] and got[2].permissive and got[2].base_labels == ["apache-2"]
    assert got[3].n_words == got[3].n_base == 0 and got[3].first_word is None and got[3].score == 0
    assert got[4].labels == ["mit"] and got[5].n_base == 0
    assert all(0 <= x.score <= 1 for x in got.values())
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(none).count() == 0
    assert licenses.postfix("mit or (gpl and bsd) with x") == ["mit", "gpl", "bsd", "and", "x", "with", "or"]
    assert licenses.postfix("and mit") is None and licenses.postfix("(mit") is None


# 3 urls


def test_urls(spark):
    made = ["http://Example.com/en/x?q", "https://a.www.EXAMPLE.com/en/", "http://example.com", "http://com/", "http://xcom/", "http://b.net/es/1#f", "http://net/fr", "http://x.net/fr/", None, "nothing", "://", "http://a..com/", "x://example.com?/en/", "http://example.com./en/", "http://exa-mple.com/en/"] * 2
    pages = spark.createDataFrame([(i if i else None, u, "own") for i, u in enumerate(made)], "page_id long, url string, u_key string")
    rules = spark.createDataFrame([*urls.RULES, (None, "/", "block"), ("com", "/", "allow")], "host string, path string, verdict string")
    got = urls.filter_urls(pages, rules, slices=3).collect()
    assert len(got) == len(made) and {r.u_key for r in got} == {"own"}
    for r in got:
        rest = r.url.split("://", 1)[1] if r.url and "://" in r.url else ""
        host = lower(re.match("[^/?#]*", rest)[0])
        path = re.match("[^?#]*", rest[len(host) :])[0]
        fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, "allow")
        assert tuple(r.judged) == (host, path, rule, verdict)
    assert urls.filter_urls(pages.limit(0), rules).count() == 0
    mapped = urls.filter_urls(pages.withColumn("m", F.create_map(F.lit("k"), F.lit(1))), rules).collect()
    assert multiset(r.judged for r in mapped) == multiset(r.judged for r in got) and all(r.m == {"k": 1} for r in mapped)
    assert {r.judged.rule for r in urls.filter_urls(pages, rules.limit(0)).collect()} == {None}


# 4 substrings


def test_substrings(docs, rows, none):
    first = {}
    for d, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = split(text)
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    want = []
    for d, text, *_ in rows:
        w = split(text)
        hit = [False] * len(w)
        for i in range(len(w) - 12):
            if d is not None and first[tuple(w[i : i + 13])] < d:
                hit[i : i + 13] = [True] * 13
        want.append((d, len(w), sum(hit), " ".join(x for x, h in zip(w, hit) if not h)))
    got = substrings.cut_repeats(clash(docs, "anchor", "spans")).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert multiset(got) == multiset(want) and sum(w[2] for w in want) > 500
    assert substrings.cut_repeats(none).count() == 0


def test_extend_in_parts():
    """Anchors with many more rows than are held give the same spans, however rows are cut to batches."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    n = 900
    anchor = np.sort(np.where(rng.random(n) < 0.6, 5, rng.integers(0, 30, n))).astype(np.int64)
    doc = rng.integers(0, 40, n)
    order = np.lexsort((doc, anchor))
    anchor, doc = anchor[order], doc[order].astype(np.int64)
    at = rng.integers(0, 1000, n).astype(np.int32)
    prints = [rng.integers(0, 3, k).astype(np.uint8).repeat(5).tobytes() for k in rng.integers(1, 4, n)]
    least = {}
    for a, d, p in zip(anchor, doc, prints):
        for i in range(0, len(p), 5):
            least[a, p[i : i + 5]] = min(d, least.get((a, p[i : i + 5]), d))
    want = {(int(d), int(t) + i // 5 + k) for a, d, t, p in zip(anchor, doc, at, prints) for i in range(0, len(p), 5) if d > least[a, p[i : i + 5]] for k in range(13)}
    for step, held in ((1000, 50_000), (50, 60), (7, 20)):
        batches = [pa.RecordBatch.from_arrays([pa.array(anchor[i : i + step]), pa.array(doc[i : i + step]), pa.array(at[i : i + step]), pa.array(prints[i : i + step], pa.binary())], ["anchor", "doc_id", "at", "prints"]) for i in range(0, n, step)]
        got = pa.Table.from_batches(list(substrings._extend(iter(batches), 13, held))).to_pylist()
        assert {(r["doc_id"], k) for r in got for k in range(r["start"], r["stop"])} == want and want


# 5 lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    rng = np.random.default_rng(1)
    a = ["".join(rng.choice(list("abé"), rng.integers(0, 15))) for _ in range(1500)]
    b = []
    for s in a:
        s = list(s)
        for _ in range(rng.integers(0, 5)):
            at, do = int(rng.integers(0, len(s) + 1)), rng.integers(0, 3)
            s[at : at + (do > 0)] = [] if do == 1 else ["b"]
        b.append("".join(s))
    assert lines.within(a, b).tolist() == [distance(x, y) <= 2 for x, y in zip(a, b)]


def test_lines(spark, none):
    rng = np.random.default_rng(2)
    base = ["".join(rng.choice(list("abcdefgh "), rng.integers(12, 60))).replace("  ", "ab") for _ in range(40)]
    made = []
    for d in range(30):
        own = []
        for _ in range(6):
            s = list(base[rng.integers(0, 40)])
            for _ in range(rng.integers(0, 4)):
                s[rng.integers(0, len(s))] = "z"
            own.append("".join(s))
        made.append((d, "\n".join([*own, "short", " "])))
    made += [(40, None), (41, ""), (42, made[3][1]), (42, made[3][1]), (None, made[4][1])]
    df = clash(spark.createDataFrame(made, "doc_id long, text string"), "id", "line")
    all_lines = [(-1 if d is None else d, i, x) for d, t in made for i, x in enumerate((t or "").split("\n")) if split(x)]
    first = {}
    for d, i, x in sorted(all_lines):
        first.setdefault(x, (d, i))
    root = {x: x for x in first}
    find = lambda x: x if root[x] == x else find(root[x])
    for x in first:
        for y in first:
            if x < y and min(len(x), len(y)) >= 12 and distance(x, y) <= 2:
                root[find(x)] = find(y)
    least = {}
    for x in first:
        least[find(x)] = min(least.get(find(x), first[x]), first[x])
    want = sorted(((d, i), first[x], least[find(x)]) for d, i, x in all_lines)
    fix = lambda s: (-1 if s[0] is None else s[0], s[1])
    got = lines.dedup_lines(df).where("line_no is not null").collect()
    assert sorted((fix((r.doc_id, r.line_no)), fix(r.copy_of), fix(r.near_of)) for r in got) == want
    assert any(c != n for _, c, n in want)
    assert lines.dedup_lines(none).count() == 0
    dropped = lines.drop_lines(clash(df, "lines_gone", "gone", "row", "g_id")).collect()
    assert len(dropped) == len(made) and {r.gone for r in dropped} == {"own"}


def test_hot_segments(spark, monkeypatch):
    """Lines of a template, over the size of a part, and all of their pairs within two edits are found."""
    monkeypatch.setattr(lines, "PART_ROWS", 16)
    rng = np.random.default_rng(11)
    made = sorted({"template line with number " + "".join(rng.choice(list("01"), 9)) for _ in range(160)})
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(made)], "id long, line string")
    got = {(r.a, r.b) for r in lines.near_lines(rows).collect()}
    want = {(i, j) for j in range(len(made)) for i in range(j) if distance(made[i], made[j]) <= 2}
    assert got == want and len(want) > 500


def test_meeting_passes_hot_keys_on():
    """A key that fills more than what is held goes on row by row, and its neighbours are compared."""
    import pyarrow as pa

    rng = np.random.default_rng(12)
    key = np.sort(np.concatenate([np.full(500, 7), rng.integers(0, 60, 300)]))
    ids = rng.permutation(800).astype(np.int64)
    sketch, index = rng.integers(0, 4, 800).astype(np.int32), rng.random(800) < 0.5
    batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + 40]) for x in (key, ids, sketch, index)], ["key", "id", "sketch", "is_index"]) for i in range(0, 800, 40)]
    got = pa.Table.from_batches(list(lines._meet(iter(batches), 2, 50, 100))).to_pylist()
    later = {(r["a"], r["b"], r["kind"] == lines.LATER_INDEX) for r in got if r["kind"] != lines.PAIR}
    n = collections.Counter(key.tolist())
    assert later == {(k, i, x) for k, i, x in zip(key.tolist(), ids.tolist(), index.tolist()) if n[k] > 50}
    pairs = {(r["a"], r["b"]) for r in got if r["kind"] == lines.PAIR}
    near = lambda i, j: lines._far(sketch[i : i + 1].view(np.uint32), sketch[j : j + 1].view(np.uint32))[0] <= 4
    assert pairs == {tuple(sorted((int(ids[i]), int(ids[j])))) for i in range(800) for j in range(i) if key[i] == key[j] and n[key[i]] <= 50 and (index[i] or index[j]) and near(i, j)}


# 6 quality


def test_quality(docs, rows, none):
    got = multiset(quality.judge(clash(docs, "p_words", "kept"), carry=False).select("doc_id", "quality.n_words", "quality.word_chars", "quality.n_symbols", "quality.n_dup_lines", "quality.n_repeat_words", "quality.base_failed").collect())
    want = []
    for d, text, *_ in rows:
        w = split(text)
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n, hit = collections.Counter(grams), [False] * len(w)
        for i, g in enumerate(grams):
            if n[g] > 1:
                hit[i : i + 8] = [True] * 8
        own = [x for x in (text or "").split("\n") if split(x)]
        want.append((d, len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(own) - len(set(own)), sum(hit), len(w) < 20 or 100 * sum(hit) > 30 * len(w)))
    assert got == multiset(want)
    assert quality.judge(none).count() == 0
    assert multiset(quality.stage(None, docs, "").select("doc_id").collect()) == multiset([(r.doc_id,) for r in quality.judge(docs).where("quality.kept").collect()])


def test_quality_rejects_noise(spark):
    clean = [(i, " ".join(["the words of a text and its sentences"] * 1 + [f"{chr(97 + (i + k) % 26)}word{'abcdefghij'[k % 10]}" for k in range(60)]), "en") for i in range(60)]
    noise = [(100, " ".join(f"x%{k}$$##**" for k in range(80)), "en")]
    got = {r.doc_id: r.quality.kept for r in quality.judge(spark.createDataFrame(clean + noise, "doc_id long, text string, lang string")).collect()}
    assert not got[100] and all(got[i] for i in range(60))


# 7 simhash


def fingerprint(text, k=4):
    w = split(lower(text))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs, rows, none):
    prints = [fingerprint(r[1]) for r in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(prints):
            for j, y in enumerate(prints):
                if (x ^ y).bit_count() <= 4 and label[j] < label[i]:
                    label[i], changed = label[j], True
    named = {}
    for r, l in zip(rows, label):
        if r[0] is not None:
            named[l] = min(named.get(l, r[0]), r[0])
    want = [(r[0], p, named.get(l)) for r, p, l in zip(rows, prints, label)]
    got = simhash.near_duplicates(clash(docs, "print", "root")).collect()
    assert multiset((r.doc_id, r["print"] % 2**64, r.component_id) for r in got) == multiset(want)
    assert simhash.near_duplicates(none).count() == 0
    far = [0, 0xFF, 0xFFFF << 40, 0xFFFF << 40 | 0xFF << 56, 1 << 62, 0x1FF << 20]
    wide = simhash.linked(spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in far], "print long"), 8, 11)
    assert {r.node % 2**64 for r in wide.collect()} == set(far[:5])
    kept = simhash.stage(None, docs, "").collect()
    assert len({(r.doc_id, r.text) for r in kept}) == len(kept) and docs.columns == kept[0].__fields__
    assert sum(r.doc_id is None for r in kept) == 2 and [r.doc_id for r in kept].count(81) == 1


def test_forest():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60, np.uint64)
    near = [base[:20] ^ (np.uint64(1) << rng.integers(0, 64, 20, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 20, np.uint64)) for _ in range(20)]
    x = np.unique(np.concatenate([base, *near]))
    x = x[np.argsort(simhash.gray_rank(x))]
    close = np.bitwise_count(x[:, None] ^ x) <= 4
    label = np.arange(len(x))
    while not np.array_equal(new := np.array([label[c].min() for c in close]), label):
        label = new
    assert np.array_equal(label, simhash.forest(x))


def test_hot_keys(spark, monkeypatch):
    """Keys of more rows than a part are compared in pairs of parts, and nothing is lost."""
    monkeypatch.setattr(simhash, "PART_ROWS", 32)
    x = sorted({(1 << i) | (1 << j) for i in range(14) for j in range(14)})
    got = simhash.linked(spark.createDataFrame([(v,) for v in x], "print long"))
    assert {(r.node, r.root) for r in got.collect()} == {(v, min(x)) for v in x}


def test_components(spark):
    rng = np.random.default_rng(4)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 440)] + [(None, 5), (7, 7)]
    root = {}
    find = lambda v: v if root.setdefault(v, v) == v else find(root[v])
    for a, b in e:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = graph.components(spark.createDataFrame(e, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {v: find(v) for v in list(root)} and len(got) == len(root)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 8 sharding


def test_sharding(docs, rows, none, monkeypatch, spark):
    monkeypatch.setattr(sharding, "BLOCK_GROUPS", 10)
    got = sharding.shard(clash(docs, "size", "shard", "id"), carry=False).select("doc_id", "shard", "sharded.*").toDF("doc_id", "own", "size", "crc", "shard", "slot").collect()
    assert {r.own for r in got} == {"own"}
    assert multiset((r.doc_id, r.size, r.crc) for r in got) == multiset((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    where = collections.defaultdict(set)
    slots = collections.defaultdict(list)
    for r in got:
        where[r.crc].add(r.shard)
        slots[r.shard].append(r.slot)
    sums = collections.Counter()
    for r in got:
        sums[r.shard] += r.size
    second, biggest = sorted(sum(r.size for r in got if r.crc == c) for c in where)[-2:]
    assert max(sums.values()) <= max(biggest, sum(sums.values()) / 8) + second
    assert dict(sharding.shard(docs).select("sharded.*").dtypes) == {"size": "bigint", "text_crc32": "bigint", "shard": "int", "slot": "bigint"}
    assert all(len(s) == 1 for s in where.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(none).count() == 0
    assert multiset(sharding.stage(spark, docs, "").select("doc_id", "text").collect()) == multiset((r[0], r[1]) for r in rows)


def test_differencing_is_near_equal():
    rng = np.random.default_rng(0)
    sizes = rng.lognormal(7, 1, 4000).astype(int).tolist()
    sums = [0] * 8
    for s, to in zip(sizes, sharding.differencing([[s] + [0] * 7 for s in sizes])):
        sums[to[0]] += s
    assert max(sums) - min(sums) <= 10


def test_write_shards(docs, tmp_path, spark):
    sharding.write_shards(docs, f"{tmp_path}/out", 3)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == docs.count() and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2}


# 9 decontamination


def plain(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))


@pytest.mark.parametrize("limit", [16 << 20, 200])
def test_decontaminate(spark, docs, rows, none, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", limit)
    w = [plain(r[1]) for r in rows]
    items = [(1, " ".join(w[2][5:30])), (10, " ".join(w[3][:12]) + " tail end of it"), (2, "one two"), (3, None), (4, ""), (5, "--"), (None, " ".join(w[8][3:14])), (1, " ".join(w[9][20:31])), (6, "not in any of these texts at all so no hit"), (7, "ONE")]
    bench = clash(spark.createDataFrame(items, "item_id long, text string"), "slice")
    windows = collections.defaultdict(set)
    for i, text in items:
        v = plain(text)
        for k in range(max(1, len(v) - 9) if v else 0):
            windows[tuple(v[k : k + 10])] |= {str(i)} - {"None"}
    want = []
    for r, v in zip(rows, w):
        hit, ids = [False] * len(v), set()
        for size in {len(x) for x in windows}:
            for k in range(len(v) - size + 1):
                if (g := tuple(v[k : k + size])) in windows:
                    hit[k : k + size] = [True] * size
                    ids |= windows[g]
        want.append((r[0], len(v), sum(hit), ",".join(sorted(ids))))
    h = decontaminate.mark(clash(docs, "items"), bench)
    got = h.select("doc_id", "benchmark_hits.n_words", "benchmark_hits.n_hit", F.array_join("benchmark_hits.items", ",").alias("items")).collect()
    assert multiset(got) == multiset(want) and sum(x[2] > 0 for x in want) > 5
    for r in h.collect():
        assert sum(len(plain(r.text[s.start : s.end])) for s in r.benchmark_hits.spans) == r.benchmark_hits.n_hit
    assert decontaminate.mark(none, bench).count() == 0
    assert decontaminate.mark(docs, bench.limit(0)).where("benchmark_hits.n_hit > 0").count() == 0


# 10 language model


def test_maxent_base(docs, rows, none):
    train, texts = collections.Counter(), []
    for r in rows:
        held = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2
        t = [*split(lower(r[1])), None]
        texts.append((r[0], held, t))
        if not held:
            train.update(t)
    n, v = sum(train.values()), len(train)
    base = lambda t: sum(math.log10((train[x] + 1) / (n + v + 1)) for x in t)
    want = [(d, h, len(t), sum(train[x] > 0 for x in t), n, round(base(t), 6)) for d, h, t in texts]
    got = maxent.score_texts(clash(docs, "token", "part", "held_out")).collect()
    assert multiset((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == multiset(want)
    assert all(math.isfinite(r.score) and (r.score < 0 or r.doc_id is None) for r in got)
    assert maxent.score_texts(none).count() == 0


@pytest.mark.parametrize("listed", [1 << 18, 8, 1])
def test_maxent_rows_and_partitions(spark, monkeypatch, listed):
    """Rows that share a doc_id have their own sums, whether their tokens are listed or not, and scores do not depend on partitions."""
    monkeypatch.setattr(maxent, "LISTED", listed)
    monkeypatch.setattr(maxent, "SHARD_TOKENS", 40)
    made = [(1, "the cat sat on the mat"), (1, "zebra"), (1, "zebra"), (2, "the cat"), (2, "the cat"), (None, "cat"), (None, "dog"), (3, "a b " * 300), (2**62, "the"), (-5, "cat sat"), (0, "Q"), (0, None)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    train = collections.Counter(x for d, t in made if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2 for x in [*lower(t).split(), None])
    want = [(d, sum(train[x] > 0 for x in [*lower(t).split(), None]), round(sum(math.log10((train[x] + 1) / (sum(train.values()) + len(train) + 1)) for x in [*lower(t).split(), None]), 6)) for d, t in made]
    one, many = (maxent.score_texts(docs.repartition(n)).collect() for n in (1, 7))
    assert multiset((r.doc_id, r.n_known, round(r.base_score, 6)) for r in one) == multiset(want)
    assert multiset((r.doc_id, r.n_tokens, round(r.score, 4)) for r in one) == multiset((r.doc_id, r.n_tokens, round(r.score, 4)) for r in many)


def test_maxent_beats_counts(spark):
    """Where words come in two kinds that do not mix, held-out texts are likelier under the model."""
    rng = np.random.default_rng(3)
    made = []
    for d in range(400):
        end, stems = ("ing", "abcde") if d % 2 else ("oso", "fghij")
        made.append((d, " ".join("".join(rng.choice(list(stems), 3)) + end for _ in range(60))))
    got = maxent.score_texts(spark.createDataFrame(made, "doc_id long, text string")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1] * 0.95


def test_maxent_is_a_distribution():
    """The chances of all known tokens and of an unknown one of each shape, in one context, sum to one."""
    rng = np.random.default_rng(0)
    weights = rng.normal(size=(3 * 2**maxent.BITS + 1, maxent.CLASSES)).astype(np.float32)
    f = rng.integers(0, len(weights), (3, 5))
    assert np.allclose(np.exp(maxent._log_softmax(weights, f)).sum(1), 1, atol=1e-5)


# stages: columns of any name and kind


@pytest.mark.parametrize("stage", [quality.stage, simhash.stage, decontaminate.stage, mixing.stage, sharding.stage])
def test_stage_with_clashing_and_map_columns(spark, data, docs, none, stage):
    own = clash(docs, "quality", "mixed", "shard", "slot", "simhash_first_id", "benchmark_hits", "id", "hash", "print", "row", "place").withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    out = stage(spark, own, data)
    rows = out.collect()
    assert rows and all(r["m"] == {"k": 1} for r in rows)
    if stage is sharding.stage:
        assert sorted(out.columns) == sorted(own.columns) and {r.shard for r in rows} <= set(range(8))
    else:
        assert out.columns == own.columns and {r.quality for r in rows} == {r.mixed for r in rows} == {r.shard for r in rows} == {"own"}
    assert stage(spark, none, data).count() == 0
