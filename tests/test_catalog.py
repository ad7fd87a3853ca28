"""Every registered query against its SQL in DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

from loamline import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if value is None or value != value:
        return ""
    if isinstance(value, float):
        return f"{value:.9g}" if value != int(value) else str(int(value))
    return str(value)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(v[k]) for k in order) for v in values)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_agrees_with_sql(spark, duck, name):
    frame = catalog.QUERIES[name](spark, FOLDER)
    result = duck.execute(catalog.SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows(frame.columns, frame.collect()) == rows(columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


def test_flagship(spark):
    out = catalog.flagship(spark, FOLDER).collect()
    assert [r["place"] for r in out] == list(range(1, len(out) + 1)) and out[0]["total_found"] >= len(out) > 0
