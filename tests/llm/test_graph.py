"""Components of one block of edges need no rounds; those of several come out the same."""

import random

import pytest

from tessera.llm import graph


@pytest.mark.parametrize("held", [1 << 16, 7])
def test_components(spark, monkeypatch, held):
    monkeypatch.setattr(graph, "EDGES", held)
    rounds = []
    settled = graph._settled
    monkeypatch.setattr(graph, "_settled", lambda now: rounds.append(1) or settled(now))
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(-30, 20)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5), (None, 3), (7, 6)]
    root = {}
    for a, b in edges:
        if a is not None and a != b:
            x, y = root.setdefault(a, a), root.setdefault(b, b)
            root = {n: min(x, y) if r in (x, y) else r for n, r in root.items()}
    rows = graph.components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted((r.node, r.root) for r in rows.collect()) == sorted(root.items())
    assert bool(rounds) == (held == 7)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
