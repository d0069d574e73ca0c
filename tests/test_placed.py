"""Numbers of windows come from the lengths of series: they are those of the windows themselves, and no window is held."""

from tessera.operators.windows import multi, placed


def test_placed(spark):
    rows = spark.createDataFrame([(s, t, float(10 * s + t)) for s, n in ((1, 9), (2, 3), (5, 12)) for t in range(n)], "series_id long, t int, x double")
    want = [(s, n, t) for s, size in ((1, 9), (2, 3), (5, 12)) for n in (4, 7) for t in range(0, size - n + 1, 2)]
    out = placed(rows, [4, 7], 2)
    assert [(r.series_id, r.len, r.start) for r in out.orderBy("win_id").collect()] == want
    assert "collect_list" not in out._jdf.queryExecution().toString()
    full = multi(rows, [4, 7], 2).orderBy("win_id").collect()
    assert [(r.win_id, r.series_id, r.len, r.start) for r in full] == [(i, *w) for i, w in enumerate(want)]
    assert all(r.xs == [10.0 * r.series_id + r.start + k for k in range(r.len)] for r in full)
