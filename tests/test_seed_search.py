"""Seeds and their members come from one search of the query windows: the table is dealt to cells once."""

from tessera.operators import neighbours
from tessera.plans import seeds
from tessera.sources.frames import frames


def test_one_search(spark, data, monkeypatch):
    rows = frames(spark, data)
    want = neighbours.window_knn(rows).join(neighbours.optima(rows).select("id"), "id", "left_semi").select("id", "nbr")
    want = sorted([tuple(r) for r in want.collect()] + [(r.id, r.id) for r in neighbours.optima(rows).collect()])
    dealt, celled = [], neighbours.celled
    monkeypatch.setattr(neighbours, "celled", lambda *a: dealt.append(1) or celled(*a))
    got = seeds.seed_occurrences(rows).collect()
    assert len(dealt) == 1
    assert sorted((r.model_id, r.series_id * (1 << 32) + r.start) for r in got) == want
