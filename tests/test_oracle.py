"""Every registered query against its brute-force DuckDB SQL on sf0.001."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from vicinity.plans.registry import QUERIES

TABLES = ["embeddings", "part", "lineitem", "customer", "documents"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _rows(df):
    cols = sorted(df.columns)
    norm = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else (round(v, 6) if isinstance(v, float) else v)
    return cols, sorted((tuple(norm(getattr(x, "item", lambda: x)()) for x in rec) for rec in df[cols].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) & set(QUERIES)))
def test_query_matches_oracle(spark, con, name):
    got = entry.queries()[name](spark, SF_SMALL).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()
    assert _rows(got) == _rows(want)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["id", "label", "prediction"]


def test_rows_only_queries(spark):
    for name in set(QUERIES) - set(entry.oracle_sql()):
        assert entry.queries()[name](spark, SF_SMALL).count() > 0
