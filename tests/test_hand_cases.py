"""Hand cases worked out by hand (FIXTURES.md §3)."""

import pytest
from pyspark.sql import functions as F

from conftest import points
from vicinity import (
    build_index,
    candidate_cells,
    cell_count,
    cell_count_col,
    class_count,
    classify_predictions,
    indegree,
    knn_join,
    outliers,
    regress_predictions,
)
from vicinity.ml import KNNClassifier, KNNRegressor

H1_TRAIN = [(1, -5.0, 0.0), (2, 5.0, 0.0), (3, 20.0, 0.0), (4, 30.0, 0.0)]
H1_CELLS = [(0, (0.0,)), (1, (25.0,))]


def _nn(spark, train, query_x, k, search="pruned", centers="kmeans"):
    idx = build_index(points(spark, train), centers=centers)
    q = points(spark, [(100, query_x, 0.0)])
    return idx, knn_join(q, idx, k, search=search).orderBy("rank").collect()


@pytest.mark.parametrize("search", ["pruned", "exact"])
def test_h1_squared_bounds(spark, search):
    _, rows = _nn(spark, H1_TRAIN, 10.0, 2, search, H1_CELLS)
    assert [r.t_id for r in rows] == [2, 3]
    assert [r.d2 for r in rows] == [25.0, 100.0]


def test_h1_reference_rule_would_fail_single_cell(spark):
    # searching only the cell with the least upper bound misses id 3
    _, rows = _nn(spark, H1_TRAIN, 10.0, 2, "single_cell", H1_CELLS)
    assert [r.t_id for r in rows] == [2, 1]


def test_h2_query_inside_cell(spark):
    _, rows = _nn(spark, H1_TRAIN, 24.0, 2, "pruned", H1_CELLS)
    assert [r.t_id for r in rows] == [3, 4]
    assert [r.d2 for r in rows] == [16.0, 36.0]


def test_h3_cell_smaller_than_k(spark):
    train = [(1, 0.0, 0.0), (2, 10.0, 0.0), (3, 12.0, 0.0)]
    cells = [(0, (0.0,)), (1, (11.0,))]
    idx, rows = _nn(spark, train, 0.0, 2, "pruned", cells)
    assert [r.t_id for r in rows] == [1, 2]
    cand = candidate_cells(points(spark, [(100, 0.0, 0.0)]), idx, 2).orderBy("cell").collect()
    assert [c.cell for c in cand] == [0, 1]
    assert cand[0].bound == 12.0


def _classify(spark, train, x, k):
    idx = build_index(points(spark, train), centers="kmeans")
    nn = knn_join(points(spark, [(100, x, 0.0)]), idx, k)
    return classify_predictions(nn).collect()[0].prediction


def test_h4_vote_tie_smallest_label(spark):
    assert _classify(spark, [(1, 0.0, 1.0), (2, 2.0, 0.0)], 1.0, 2) == 0.0


def test_h5_distance_tie_smallest_id(spark):
    assert _classify(spark, [(1, 0.0, 5.0), (2, 2.0, 7.0)], 1.0, 1) == 5.0


def _regress(spark, train, x, k, exact="mean"):
    idx = build_index(points(spark, train), centers="kmeans")
    nn = knn_join(points(spark, [(100, x, 0.0)]), idx, k)
    return regress_predictions(nn, exact).collect()[0].prediction


def test_h6_inverse_squared_distance(spark):
    assert _regress(spark, [(1, 0.0, 10.0), (2, 3.0, 40.0)], 1.0, 2) == pytest.approx(16.0)


def test_h7_one_exact_match(spark):
    assert _regress(spark, [(1, 1.0, 10.0), (2, 3.0, 40.0)], 1.0, 2) == 10.0


def test_h8_two_exact_matches(spark):
    train = [(1, 1.0, 10.0), (2, 1.0, 20.0), (3, 3.0, 40.0)]
    assert _regress(spark, train, 1.0, 3, "mean") == 15.0
    assert _regress(spark, train, 1.0, 3, "sum") == 30.0


def test_h9_k_beyond_data(spark):
    _, rows = _nn(spark, [(1, 0.0, 1.0), (2, 5.0, 2.0)], 1.0, 5)
    assert [r.t_id for r in rows] == [1, 2]


def test_h10_empty_training_and_null_vector(spark):
    train = points(spark, [(1, 0.0, 1.0)]).where("id < 0")
    q = points(spark, [(100, 1.0, 0.0), (101, None, 0.0)])
    out = KNNClassifier(k=3).fit(train).transform(q).orderBy("id").collect()
    assert [r.prediction for r in out] == [None, None]
    train2 = points(spark, [(1, 0.0, 1.0), (2, 2.0, 2.0)])
    out2 = KNNRegressor(k=1).fit(train2).transform(q).orderBy("id").collect()
    assert [r.prediction for r in out2] == [1.0, None]


H11 = [(1, 0.0), (2, 1.0), (3, 3.0), (4, 100.0)]


def test_h11_indegree(spark):
    idx = build_index(points(spark, H11, with_label=False), label_col=None)
    deg = indegree(idx, 1).orderBy("id")
    assert [r.indegree for r in deg.collect()] == [1, 2, 1, 0]
    assert [r.id for r in outliers(deg, 0).collect()] == [4]
    with_self = indegree(idx, 1, count_self=True).orderBy("id").collect()
    assert [r.indegree for r in with_self] == [2, 3, 2, 1]


def test_h12_indegree_by_value(spark):
    idx = build_index(points(spark, [(1, 0.0), (2, 0.0), (3, 5.0)], with_label=False), label_col=None)
    deg = indegree(idx, 1, key="value", count_self=True).collect()
    assert sorted((r.features[0], r.indegree) for r in deg) == [(0.0, 3), (5.0, 1)]


def test_h13_cell_count(spark):
    ns = [1, 7, 8, 17, 18, 400, 5000, 1000000]
    want = [2, 2, 2, 2, 3, 14, 50, 50]
    assert [cell_count(n) for n in ns] == want
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    assert [r.c for r in df.select(cell_count_col(F.col("n")).alias("c")).collect()] == want


def test_h14_class_count(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (4.0,)], "label double")
    assert class_count(df) == 5
