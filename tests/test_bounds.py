"""Merges of any number of labels; too many classes to be assigned to each other are an error, not a part of the rows."""

import numpy as np
import pytest

from tessera.functions import hmm
from tessera.plans import models


def test_bounds(spark, data, monkeypatch):
    monkeypatch.setattr(models, "CLASSES_AT_MOST", 2)
    with pytest.raises(ValueError, match="over"):
        models.best_label_mapping(spark, data)


@pytest.mark.parametrize("how", ["average", "complete"])
@pytest.mark.parametrize("n", [2, 9, 40])
def test_merges_are_those_of_one_after_another(spark, how, n):
    rng = np.random.default_rng(n)
    x = rng.normal(0, 1, (n, 3))
    dist = ((x[:, None] - x[None]) ** 2).sum(2)
    pairs = spark.createDataFrame([(i, j, float(dist[i, j])) for i in range(n) for j in range(i + 1, n)], "l1 int, l2 int, dist double")
    got = [(r.i, r.j, r.dist) for r in models.linked(pairs, how).orderBy("step").collect()]
    assert got == [(i, j, pytest.approx(d)) for i, j, d in hmm.linkage(dist, how)]


def test_merges_of_many_labels(spark, tmp_path):
    """150 labels, 11,175 pairs, some without a vector whose id is divisible by 50: all are merged, by the true greatest distance of two labels' vectors."""
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (600, 64)).astype(np.float32)
    rows = [(i, v.tolist(), i % 150) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    far = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(2)).reshape(4, 150, 4, 150).max(axis=(0, 2)).round(5)
    np.fill_diagonal(far, np.inf)
    got = models.merge_groups_complete(spark, str(tmp_path)).orderBy("step").collect()
    want = hmm.linkage(far, "complete")
    assert len(got) == 149 and np.allclose([r.dist for r in got], [d for *_, d in want])
    assert len(models.merge_groups_average(spark, str(tmp_path)).collect()) == 149
