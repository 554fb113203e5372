"""The centre tree: exact for any data, cells that grow, rings that cut pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from test_pruned_equals_exact import _np, _part, as_lists, brute
from vicinity import assemble, build_index, knn_join, knn_self_join, read_table
from vicinity.operators import search as S
from vicinity.operators import tree as T


@pytest.mark.parametrize("block_rows,ring_rows,cells", [(2_000, 256, None), (3, 4, 30), (5, 7, 2)])
def test_join_equals_brute_force(spark, monkeypatch, block_rows, ring_rows, cells):
    monkeypatch.setattr(T, "RING_ROWS", ring_rows)
    df = _part(spark)
    q, t = df.where("id % 4 = 0"), df.where("id % 4 <> 0")
    index = T.build_tree_index(t, block_rows=block_rows, n_cells=cells)
    assert as_lists(knn_join(q, index, 6)) == brute(*_np(q), *_np(t), 6)


def test_self_join_with_ties_through_the_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(T, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(T, "QUERIES_PER_KEY", 9)
    monkeypatch.setattr(T, "RING_ROWS", 8)
    part = read_table(spark, SF_SMALL, "part")
    df = assemble(part, ["p_size", F.length("p_type")], "features").select(F.col("p_partkey").alias("id"), "features")
    index = T.build_tree_index(df, label_col=None, block_rows=5)
    ids, vecs = _np(df)
    assert as_lists(knn_self_join(index, 5)) == brute(ids, vecs, ids, vecs, 5, exclude_self=True)


@pytest.mark.parametrize("dim", [1, 3, 64])
def test_blobs_outliers_and_far_queries(spark, dim):
    rng = np.random.default_rng(dim)
    pts = np.concatenate([rng.normal(c, 1.0, (150, dim)) for c in (-50, 0, 40)] + [rng.normal(0, 1e6, (3, dim)), np.zeros((20, dim))])
    qs = np.concatenate([rng.normal(0, 30, (20, dim)), [[1e9] * dim, [0.0] * dim]])
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(pts)], "id long, features array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(qs)], "id long, features array<double>")
    exact = knn_join(q, build_index(t, label_col=None, centers="single"), 4, search="exact")
    tree = knn_join(q, T.build_tree_index(t, label_col=None), 4)
    rows = lambda nn: sorted((r.q_id, r.t_id, r.d2, r["rank"]) for r in nn.collect())
    assert rows(tree) == rows(exact)


def test_few_points_nulls_and_no_points(spark):
    schema = "id long, features array<double>, label double"
    nan = float("nan")
    t = spark.createDataFrame([(1, [0.0, 1.0], 1.0), (2, None, 1.0), (3, [nan, 0.0], 0.0), (4, [5.0, 5.0], None)], schema)
    q = spark.createDataFrame([(1, [0.0, 0.0], 0.0), (2, None, 0.0), (3, [1.0, nan], 0.0)], schema)
    assert as_lists(knn_join(q, T.build_tree_index(t), 5)) == {1: [1, 4]}
    assert knn_join(q, T.build_tree_index(t.where("id = 9")), 5).count() == 0
    same = spark.createDataFrame([(i, [2.0, 2.0], 0.0) for i in range(40)], schema)
    assert as_lists(knn_join(q.where("id = 1"), T.build_tree_index(same), 3)) == {1: [0, 1, 2]}
    with pytest.raises(ValueError):
        knn_join(q, T.build_tree_index(t), 1, search="exact")


def test_cells_grow_with_the_points(spark):
    assert [T.tree_cell_count(n) for n in (1, 400, 5000, 1_000_000, 10**9)] == [2, 14, 50, 707, 22360]
    n = 1_000_000
    pts = spark.range(n).select("id", F.array(F.rand(1) * 1000, F.rand(2) * 1000).alias("features"))
    index = T.build_tree_index(pts, label_col=None)
    cells = index.table.select(F.explode("cells").alias("c")).select("c.cell", "c.n", F.size("c.rings").alias("rings"))
    counted = cells.agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("n"), F.max("rings").alias("rings")).first()
    assert counted.n == n and counted.cells > 500 and counted.rings > 3
    # Rings and norms: of a million points, a query measures a few hundred.
    q = pts.where("id < 50").select(F.col("id").alias("q_id"), F.col("features").alias("q_vec"))
    measured = T.near_pairs(T.tree_candidates(q, index, 5, 5, False), index).count()
    assert measured < 50 * 1_000


def test_rings_cut_the_pairs_that_leave_the_join(spark):
    part = read_table(spark, "/root/testdata/sf0.01", "part")
    df = assemble(part, ["p_size", F.col("p_retailprice") / 100], "features").select(F.col("p_partkey").alias("id"), "features")
    flat, tree = build_index(df, label_col=None, centers="kmeans"), T.build_tree_index(df, label_col=None, n_cells=31)
    q = df.select(F.col("id").alias("q_id"), F.col("features").alias("q_vec"))
    cand = S.candidates(q, flat, 5).select("q_id", "q_vec", "_u", "dc", "cell", "blocks")
    before = S._grid_join(cand, flat).count()
    T_RING = T.RING_ROWS
    try:
        T.RING_ROWS = 16
        tree = T.build_tree_index(df, label_col=None, n_cells=31)
        after = T._pairs(T.tree_candidates(q, tree, 5, 5, False), tree).count()
    finally:
        T.RING_ROWS = T_RING
    assert after * 3 < before, (before, after)


def test_the_first_bound_does_not_measure_whole_cells(spark, monkeypatch):
    rng = np.random.default_rng(4)
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.random((20_000, 2)))], "id long, features array<double>")
    index = T.build_tree_index(t, label_col=None, n_cells=2)  # 10,000 points a cell, and a query measured most of them
    seen = []
    pairs = T._pairs
    monkeypatch.setattr(T, "_pairs", lambda cand, ix: seen.append(pairs(cand, ix).count()) or pairs(cand, ix))
    q = t.where("id % 100 = 0")
    near = as_lists(knn_join(q, index, 4))
    assert seen[0] <= 200 * 2 * T.FIRST_POINTS
    assert near == brute(*_np(q), *_np(t), 4)


def test_nothing_is_written_that_grows_with_the_groups(spark, monkeypatch):
    written = {}
    plain = T.materialize
    monkeypatch.setattr(T, "materialize", lambda df, name="table", *a: written.setdefault(name, df.columns) and plain(df, name, *a))
    df = _part(spark)
    knn_join(df, T.build_tree_index(df, n_cells=30), 3).collect()
    assert written["tree-queries"] == ["q_id", "q_vec", "_whole", "group"]
    assert written["tree-bounds"] == ["q_id", "q_vec", "_u", "group", "_cell", "_dc"]


def test_a_written_table_leaves_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    seen = []

    def shuffles():
        return int(spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size())

    at = shuffles()
    for _ in range(3):
        T.materialize(spark.range(1000).repartition(3, "id"), "left").count()
        seen.append(shuffles())
    assert seen[-1] <= at + 3 and spark.conf.get(key, None) == before  # a count's own one may stay
