"""Reading tables, cutting lineage and joining small tables: what every operator here shares.

Nulls and odd rows: none of these functions reads a value, so nulls, repeated rows and empty tables pass as they are; an
empty table is small, and a name that a column has in other capitals counts as taken.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it has been counted and has at most so many rows.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder `spark.checkpoint.dir`. Where that is unset one of our own is made on a local master (tests); elsewhere it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-"))
    return sc.getCheckpointDir()


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or with a number after it the first that is no column of df."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(len(taken) + 1))) if n.lower() not in taken)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from there, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, which is checkpointed and so cheap to count, marked for broadcast if it has at most `limit` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
