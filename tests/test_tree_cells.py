"""Cells of a centre tree in Arrow batches: the same, to the last bit, as by expression."""

import numpy as np
from pyspark.sql import functions as F

from vicinity import knn_join
from vicinity.operators import tree as T


def frame(spark, n, dim, seed):
    v = np.random.default_rng(seed).normal(0, 10, (n, dim)).round(2)
    v[: n // 10] = v[0]
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "t_id long, t_vec array<double>")


def test_batches_equal_the_expression(spark, monkeypatch):
    monkeypatch.setattr(T, "BATCH_PAIRS", 50)
    for dim in (1, 4):
        pts = frame(spark, 400, dim, dim).withColumn("group", (F.col("t_id") % 3).cast("int"))
        # Two equal centres a group: the smaller cell wins; group 2 has no cells.
        cells = spark.createDataFrame([(g * 100 + c, g, [float(c // 2 * 5)] * dim) for g in (0, 1) for c in range(8)], "cell long, group int, center array<double>")
        got = [sorted(map(tuple, T._nearest_cell(pts, T._by_group(cells), dim, 16).select("t_id", "cell", "t_dist").collect())) for limit in (8 << 20, 0) if monkeypatch.setattr(T, "BATCH_BYTES", limit) is None]
        assert got[0] == got[1] and len(got[0]) == 267


def test_assignment_is_not_interpreted(spark, monkeypatch):
    seen = []
    plain = T._nearest_in_batches
    monkeypatch.setattr(T, "_nearest_in_batches", lambda *a: seen.append(1) or plain(*a))
    index = T.build_tree_index(frame(spark, 300, 4, 1), "t_id", "t_vec", None)
    assert len(seen) == T.LLOYD_ROUNDS + 1 and index.points.count() == 300


def test_groups_without_cells_take_no_points(spark, monkeypatch):
    far = [(i, tuple([1e6 * i] * 2)) for i in range(1, 5)]
    monkeypatch.setattr(T, "fit_centers", lambda *a, **k: [(0, (0.0, 0.0)), *far])
    monkeypatch.setattr(T, "SAMPLE_PER_CELL", 1)
    pts = frame(spark, 500, 2, 3).unionByName(spark.createDataFrame([(900, [4e6, 4e6])], "t_id long, t_vec array<double>"))
    index = T.build_tree_index(pts, "t_id", "t_vec", None, seed=1)
    assert index.points.count() == 501
    near = knn_join(pts.where("t_id = 900"), index, 1, "t_id", "t_vec").collect()
    assert [r.t_id for r in near] == [900]
