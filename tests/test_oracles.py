"""Every query with SQL gives the rows that DuckDB gives; every other one gives rows."""

import decimal

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"pipeline"} | {n for n in entry.queries() if n.startswith("op")}


def norm(v):
    if isinstance(v, float):
        return round(v, 4) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, list):
        return str([norm(x) for x in v])
    return "~" if v is None else v


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SLOW))
def test_query(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=str)
    if sql := entry.oracle_sql().get(name):
        got = duck.execute(sql)
        names = [x[0] for x in got.description]
        assert sorted(names) == columns
        assert rows == sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in got.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
