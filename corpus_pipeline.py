"""From raw documents to shards: each stage reads what the one before has written.

Nulls and odd rows: a null text is an empty one, which the rules reject; rows without a doc_id are documents like others,
and rows that share one are mixed and sharded each for itself. Other columns pass through all stages, but those named
shard and slot are replaced by the last. A table of which a stage keeps nothing goes on as an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, mixing, quality, sharding, simhash
from tessera.llm.base import checkpoint_dir

#: The rules keep good documents, one of each group of near copies stays, those with benchmark passages go, sources are mixed to their targets, and the mix is sharded.
STAGES = [
    ("quality", quality.stage),
    ("near_duplicates", simhash.stage),
    ("decontamination", decontaminate.stage),
    ("mixing", mixing.stage),
    ("sharding", sharding.stage),
]
#: Fingerprints, connected components and differencing have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet to the shared checkpoint folder and read again. A stage's rows are deleted once the next one's are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, last = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            path = spark._jvm.org.apache.hadoop.fs.Path(last)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        last = f"{folder}/{name}"
    return docs
