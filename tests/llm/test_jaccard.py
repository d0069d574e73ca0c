"""The pipeline's near copies against brute-force Jaccard similarity of five-word shingles."""

import random

import numpy as np
import pytest

from tessera.llm import jaccard, simhash, tree


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def components(texts):
    sets, label, pairs = [shingles(t) for t in texts], list(range(len(texts))), []
    for i, a in enumerate(sets):
        for j in range(i):
            if similarity(a, sets[j]) >= 0.8:
                pairs.append((j, i))
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label, pairs


def texts(seed, groups):
    """Groups of texts, each a base and copies with some words changed: similarities on both sides of 0.8."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(80, 300))]
        out.append(" ".join(base))
        for _ in range(3):
            copy, changes = list(base), rng.randint(1, max(2, len(base) // 35))
            for at in rng.sample(range(len(base)), changes):
                copy[at] = word()
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("family", [jaccard.FAMILY, 1])
def test_recall_and_false_drops(spark, monkeypatch, family):
    monkeypatch.setattr(jaccard, "PART_PAIRS", 2)
    monkeypatch.setattr(jaccard, "FAMILY", family)
    made = [*texts(3, 150), "one two", "one  TWO", "one three", None, "", "a b c d e", "A b c d e"]
    label, pairs = components(made)
    middle = [p for p in pairs if similarity(shingles(made[p[0]]), shingles(made[p[1]])) < 0.9]
    assert len(middle) > 50
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_copies(docs).collect()}
    old = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, 8, 5, 11).collect()}
    for name, x in (("jaccard", got), ("simhash", old)):
        recall = [sum(x[i] == x[j] for i, j in p) for p in (pairs, middle)]
        false = sum(x[i] != i and label[i] == i for i in x)
        print(f"{name}: pairs {recall[0]} of {len(pairs)}, of those below 0.9 {recall[1]} of {len(middle)}, false drops {false}")
    assert [got[i] for i in range(len(made))] == label
    assert sorted(r.doc_id for r in simhash.stage(None, docs, "").collect()) == sorted(set(label))


@pytest.mark.parametrize("family", [jaccard.FAMILY, 8])
def test_members_far_from_their_centre(spark, monkeypatch, family):
    """A chain of texts: neighbours are near, ends are not, and pairs that miss a band's centre are measured too."""
    monkeypatch.setattr(jaccard, "FAMILY", family)
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    made = [" ".join(words[i : i + 200]) for i in range(0, 200, 7)] + [" ".join(words[i : i + 200] + ["tail"] * i) for i in range(0, 60, 9)]
    label, _ = components(made)
    got = {r.doc_id: r.component_id for r in jaccard.near_copies(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(made))] == label


def test_stage_on_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    label, _ = components([t for _, t in rows])
    assert sorted(r.doc_id for r in simhash.stage(None, docs, "").collect()) == [rows[i][0] for i in sorted(set(label))]


def test_wide_prints_keep_near_sets():
    """Sets at a similarity of just over 0.8, also the smallest ones, differ in fewer bits than the limit."""
    rng = np.random.default_rng(3)
    worst = 0
    for size, common in [(4, 4), (5, 5), (9, 8), (10, 9), (20, 18), (100, 89), (1000, 889)] * 20:
        both = rng.integers(0, 2**63, common, np.uint64)
        own = [rng.integers(0, 2**63, n, np.uint64) for n in (size - common, (1 if size == common else size - common))]
        a, b = (np.concatenate([both, x]) for x in own)
        prints = jaccard.wide_prints(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        worst = max(worst, int(np.bitwise_count(prints[0] ^ prints[1]).sum()))
    assert worst <= jaccard.LIMIT - 5


def test_near_pairs_of_groups():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, (30, 4), np.uint64)
    prints = base[rng.integers(0, 30, 700)] ^ (np.uint64(1) << rng.integers(0, 64, (700, 4), np.uint64))
    group = np.sort(rng.integers(0, 40, 700))
    order = tree.gray_order(prints, group)
    assert np.array_equal(group[order], group)
    prints = prints[order]
    near = (np.bitwise_count(prints[:, None] ^ prints).sum(2) <= 8) & (group[:, None] == group) & (np.arange(700)[:, None] < np.arange(700))
    assert {(int(a), int(b)) for x, y in tree.near_pairs(prints, group, 8) for a, b in zip(x, y)} == {(int(a), int(b)) for a, b in zip(*np.nonzero(near))} and near.sum() > 100
    ranks = [sum(int(w) << (64 * (3 - i)) for i, w in enumerate(p)) for p in prints[tree.gray_order(prints, np.zeros(700, int))]]
    gray = lambda x: x ^ (x >> 1)
    inverse = {}
    for x in ranks:
        g, n = x, x
        while n := n >> 1:
            g ^= n
        inverse[x] = g
        assert gray(g) == x
    assert [inverse[x] for x in ranks] == sorted(inverse[x] for x in ranks)
