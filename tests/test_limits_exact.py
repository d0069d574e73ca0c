"""Variances that are at a limit exactly, whatever the order in which their frames come."""

from datetime import datetime, timedelta

import duckdb

import __spark_entry__ as entry


def test_flat_segments_at_the_limit(spark, tmp_path):
    """Hours with a variance of 60, which sums in floating point put a little above it in some orders."""
    rows, n = [], 0
    for user, hours in enumerate([[22, 5, 23, 19, 11], [17, 21, 3, 15], [2, 14, 11, 17, 22, 23, 23], [3, 15, 17, 21], [0, 23, 0, 23]]):
        for day, hour in enumerate(hours):
            rows.append((n, datetime(2024, 1, 1, hour) + timedelta(days=day), user, "view", 5.0, "{}"))
            n += 1
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in entry.queries()["flat_segments"](spark, str(tmp_path)).collect())
    assert [r[0] for r in got] == [0, 1, 2, 3]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(con.execute(entry.oracle_sql()["flat_segments"]).fetchall()) == got
