"""Every query of the registry against its SQL in DuckDB, over the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if hasattr(value, "quantize"):
        return float(f"{float(value):.9g}")
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    relation = duck.sql(SQL[name])
    assert columns == sorted(relation.columns)
    order = [relation.columns.index(c) for c in columns]
    expected = sorted((tuple(plain(row[i]) for i in order) for row in relation.fetchall()), key=repr)
    found = sorted((tuple(plain(row[c]) for c in columns) for row in frame.collect()), key=repr)
    assert found == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {n for n in QUERIES if n.startswith("op") or n == "pipeline"}))
def test_query_without_sql_runs(spark, name):
    frame = QUERIES[name](spark, SF)
    assert frame.columns
    assert frame.count() >= 0


def test_entry(spark):
    assert registry.entry(spark).count() > 0
