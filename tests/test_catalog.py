"""Every query with SQL gives DuckDB's rows over the same tables."""

import math
import os

import duckdb
import pytest

from threadloom.plans import catalog, ingestion

QUERIES, SQL = catalog.QUERIES | ingestion.QUERIES, catalog.SQL | ingestion.SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_tiny}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf_tiny, duck, name):
    got = QUERIES[name](spark, sf_tiny)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    left, right = rows(got.columns, got.collect()), rows(want.columns, want.fetchall())
    assert len(left) == len(right)
    assert [tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r) for r in left] == [tuple(float(x) if not isinstance(x, (bool, str, tuple, type(None))) else x for x in r) for r in right]
