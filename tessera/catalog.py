"""Queries by name, each with the DuckDB SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Common table expressions that the SQL of many queries begins with: frames of the events, and runs of equal types as labels.
FRAMES = "fr AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS x, event_type AS tag, hour(ts)::DOUBLE AS h FROM events)"
MARKUP = (
    FRAMES
    + """, isl AS (SELECT series_id, t, tag, t - row_number() OVER (PARTITION BY series_id, tag ORDER BY t) AS g FROM fr),
mk AS (SELECT series_id, tag, min(t) AS start, max(t) + 1 AS stop FROM isl GROUP BY series_id, tag, g)"""
)


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add
