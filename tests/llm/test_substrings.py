"""Rows that share a doc_id, and rows without one: each loses its own repeated words only."""

import random

from tessera.llm import substrings


def test_two_texts_under_one_id(spark):
    w, z = [f"w{i}" for i in range(20)], [f"z{i}" for i in range(30)]
    made = [(1, " ".join(w)), (2, " ".join(w)), (2, " ".join(z)), (3, " ".join(z[10:])), (None, " ".join(w)), (None, " ".join(w)), (None, None)]
    for parts in (1, 4):
        df = spark.createDataFrame(made, "doc_id long, text string").repartition(parts)
        got = sorted((r.doc_id or 0, r.n_words, r.n_removed, len(r.kept_text.split())) for r in substrings.cut_repeats(df).collect())
        assert got == [(0, 0, 0, 0), (0, 20, 0, 20), (0, 20, 0, 20), (1, 20, 0, 20), (2, 20, 20, 0), (2, 30, 0, 30), (3, 20, 20, 0)]


def test_shared_ids_against_brute_force(spark):
    """Few ids for many texts that share passages."""
    rng = random.Random(3)
    passages = [[f"p{k}_{i}" for i in range(rng.randint(10, 30))] for k in range(12)]
    made = []
    for n in range(120):
        text = [f"u{n}_{i}" for i in range(rng.randint(0, 9))]
        for _ in range(rng.randint(0, 4)):
            text += rng.choice(passages) + [f"v{n}_{rng.random()}"]
        made.append((rng.choice([None, *range(25)]), " ".join(text)))
    made += made[:15]
    first = {}
    for d, t in made:
        words = t.split()
        for i in range(len(words) - 12):
            if d is not None:
                key = tuple(words[i : i + 13])
                first[key] = min(d, first.get(key, d))
    want = []
    for d, t in made:
        words = t.split()
        gone = {i + k for i in range(len(words) - 12) if d is not None and first[tuple(words[i : i + 13])] < d for k in range(13)}
        want.append((str(d), len(words), len(gone), " ".join(x for i, x in enumerate(words) if i not in gone)))
    got = [(str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in substrings.cut_repeats(spark.createDataFrame(made, "doc_id long, text string").repartition(5)).collect()]
    assert sorted(got) == sorted(want) and sum(x[2] for x in want) > 300
