"""The stages of the pipeline, each held against what its operator decides."""

import os

from test_jaccard import components

import corpus_pipeline
from tessera.llm import decontaminate, quality


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    a = stages["quality"](spark, docs, data).cache()
    assert a.columns == columns and ids(a) == ids(quality.judge(docs).where("quality.kept"))
    b = stages["near_duplicates"](spark, a, data).cache()
    rows = sorted((r.doc_id, r.text) for r in a.collect())
    first = set(components([t for _, t in rows])[0])  # brute force: five-word shingles, 0.8 or more
    assert b.columns == columns and ids(b) == [rows[i][0] for i in sorted(first)] and len(first) < len(rows)
    c = stages["decontamination"](spark, b, data).cache()
    hits = decontaminate.mark(b, spark.read.parquet(f"{data}/benchmark.parquet"))
    assert c.columns == columns and ids(c) == ids(hits.where("benchmark_hits.n_hit = 0")) and c.count() < b.count()
    d = stages["mixing"](spark, c, data).cache()
    assert d.columns == columns and set(ids(d)) <= set(ids(c))
    n = sum(len(r.text.split()) for r in c.collect())
    assert abs(sum(len(r.text.split()) for r in d.collect()) - 1.5 * n) < 0.05 * n
    e = stages["sharding"](spark, d, data).collect()
    assert sorted(r.doc_id for r in e) == ids(d) and {r.shard for r in e} == set(range(8))


def test_run(spark, data):
    """Of what the stages write, only the last one's rows are left."""
    out = corpus_pipeline.run(spark, data)
    assert out.columns[-2:] == ["shard", "slot"] and out.count() > 0
    files = {f.rsplit("/", 2)[-2] for f in out.inputFiles()}
    folder = out.inputFiles()[0].removeprefix("file://").rsplit("/", 2)[0]
    assert files == {"sharding"} and os.listdir(folder) == ["sharding"]
