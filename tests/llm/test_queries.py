"""The registered queries against their DuckDB SQL on sf0.001."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from vicinity.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = [sorted((tuple(round(v, 6) if isinstance(v, float) else getattr(v, "item", lambda v=v: v)() for v in r) for r in df[cols].itertuples(index=False)), key=repr) for df in (got, want)]
    assert rows[0] == rows[1]


def test_one_query_per_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
