"""knn_join_offset asks for every fifth part, among all parts."""

import duckdb

from vicinity.plans.oracle import SQL
from vicinity.plans.registry import QUERIES


def test_every_fifth_part_is_searched_among_all(spark, tmp_path):
    path = f"{tmp_path}/part.parquet"
    spark.sql("SELECT id + 1 AS p_partkey, CAST(id * 7 % 50 AS INT) AS p_size, 900 + (id * 37 % 100) / 8D AS p_retailprice FROM range(100)").coalesce(1).write.parquet(path)
    got = sorted(map(tuple, QUERIES["knn_join_offset"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{path}/*.parquet'")
    want = sorted(con.execute(SQL["knn_join_offset"]).fetchall())
    assert got == want, [x for x in zip(got, want) if x[0] != x[1]][:3]
    assert {r[0] for r in got} == set(range(5, 101, 5)) and len(got) == 100
