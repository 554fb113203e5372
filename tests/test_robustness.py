"""Pruned search under rounding, unusable vectors, row keys and labels."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import points
from vicinity import build_index, indegree, knn_join, knn_self_join, read_libsvm
from vicinity.ml import KNNClassifier, KNNOutlierDetector, KNNRegressor
from vicinity.plans.checks import plan_text

NAN = float("nan")


def nn(df):
    return sorted((r.q_id, r.rank, r.t_id, r.d2) for r in df.collect())


def test_near_points_far_from_all_centres(spark):
    """Rounding in distances of 1e9 must not prune a neighbour at 7e-8."""
    train = points(spark, [(1, 7e-8, 1.0), (2, 0.5, 2.0)] + [(10 + i, 1e9 + i, 0.0) for i in range(2500)])
    index = build_index(train, centers=[(0, (1e9,)), (1, (-3e9,))])
    queries = points(spark, [(0, 0.0, 0.0)])
    assert nn(knn_join(queries, index, 1)) == nn(knn_join(queries, index, 1, search="exact")) != []


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e9, 1e12, 1e15])
def test_pruned_equals_exact_at_any_offset(spark, offset):
    rng = random.Random(int(offset) % 97)
    rows = [(i, offset + rng.choice([0, 1000, 5000]) + rng.random() * rng.choice([1e-6, 1, 100]), 0.0) for i in range(3000)]
    index = build_index(points(spark, rows), centers="kmeans", max_cells=8)
    queries = points(spark, [(i, x + rng.random(), y) for i, x, y in rows[::60]])
    assert nn(knn_join(queries, index, 4)) == nn(knn_join(queries, index, 4, search="exact"))


def test_unusable_vectors_are_left_out_in_every_mode(spark):
    rows = [(1, [0.0, 0.0], 1.0), (2, [1.0, 0.0], 2.0), (3, [NAN, 0.0], 3.0), (4, [None, 0.0], 4.0), (5, None, 5.0), (6, [float("inf"), 1.0], 6.0), (7, [9.0, 9.0], 7.0)]
    train = spark.createDataFrame(rows, "id long, features array<double>, label double")
    queries = spark.createDataFrame([(10, [0.1, 0.0]), (11, [NAN, 0.0]), (12, [None, 1.0]), (13, None)], "id long, features array<double>")
    centers = [(0, (0.0, 0.0)), (1, (9.0, 9.0))]
    for how in (centers, "kmeans", "single"):
        index = build_index(train, centers=how)
        assert index.n == 3
        for search in ("pruned", "exact"):
            assert [(q, t) for q, _, t, _ in nn(knn_join(queries, index, 2, search=search))] == [(10, 1), (10, 2)]


def test_large_k_is_cut_before_the_shuffle(spark):
    index = build_index(points(spark, [(i, float(i), 0.0) for i in range(1500)]), centers="single")
    plan = plan_text(knn_join(points(spark, [(0, 3.0, 0.0)]), index, 1200))
    assert "WindowGroupLimit" in plan
    assert len(nn(knn_join(points(spark, [(0, 3.0, 0.0)]), index, 1200))) == 1200


def test_single_cell_search_fills_its_places(spark):
    """A cell of one point has the least bound for many queries, but cannot fill five places."""
    rows = [(i, float(i % 40), 0.0) for i in range(400)] + [(1000, 20.5, 0.0)]
    index = build_index(points(spark, rows), centers=[(0, (10.0,)), (1, (30.0,)), (2, (20.5,))])
    got = nn(knn_join(points(spark, [(0, 20.4, 0.0)]), index, 5, search="single_cell"))
    assert len(got) == 5


def test_single_cell_search_refuses_a_cell_that_auto_made(spark):
    wide = spark.range(60).select("id", F.array(*[(F.col("id") % (i + 2)).cast("double") for i in range(17)]).alias("features"))
    index = build_index(wide, label_col=None)
    for search in (lambda: knn_join(wide, index, 3, search="single_cell"), lambda: knn_self_join(index, 3, search="single_cell")):
        with pytest.raises(ValueError, match="single_cell"):
            search()
    assert len(nn(knn_join(wide, index, 3))) == 180
    assert len(nn(knn_join(wide, build_index(wide, label_col=None, centers="single"), 3, search="single_cell"))) == 180


def test_equal_vectors_are_searched_once(spark):
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(6)), float(rng.randrange(4))]) for i in range(300)] + [(500, [50.0, 50.0])]
    df = spark.createDataFrame(rows, "id long, features array<double>")
    index = build_index(df, label_col=None)
    for k in (1, 3, 20):
        for count_self in (False, True):
            slow = indegree(index, k, key="value", nn=knn_self_join(index, k, count_self=count_self, keep_vectors=True))
            fast = indegree(index, k, key="value", count_self=count_self)
            assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect()))


@pytest.fixture(scope="module")
def libsvm(spark, tmp_path_factory):
    """The usage of the classic readers: labels and sparse features, no ids."""
    folder = tmp_path_factory.mktemp("libsvm")
    rng = random.Random(2)
    for name, n in (("train", 60), ("input", 12)):
        lines = []
        for _ in range(n):
            label = rng.randrange(3)
            lines.append(f"{label} 1:{label * 10 + rng.random():.4f} 3:{rng.random():.4f}")
        (folder / f"{name}.txt").write_text("\n".join(lines) + "\n")
    return [spark.read.format("libsvm").option("numFeatures", "3").load(str(folder / f"{n}.txt")) for n in ("train", "input")]


def test_flows_without_ids(spark, libsvm):
    train, queries = libsvm
    out = KNNClassifier(k=3, probabilityCol="probability", rawPredictionCol="raw").fit(train).transform(queries)
    assert out.columns == ["label", "features", "prediction", "raw", "probability"]
    for r in out.collect():
        assert r.prediction == r.label and sum(r.raw) == 3 and r.probability[int(r.label)] == 1.0
    reg = KNNRegressor(k=2).fit(train).transform(queries)
    assert reg.columns == ["label", "features", "prediction"]
    assert all(abs(r.prediction - r.label) < 1e-9 for r in reg.collect())
    detector = KNNOutlierDetector(k=2, threshold=0).fit(train)
    flagged = detector.transform(train)
    assert flagged.columns == ["label", "features", "indegree", "prediction"] and flagged.count() == 60
    assert detector.detect().count() == flagged.where("prediction = 1").count()


def test_repeated_and_null_ids_keep_their_rows(spark):
    train = points(spark, [(1, 0.0, 1.0), (2, 6.0, 2.0)])
    queries = points(spark, [(7, 0.1, 0.0), (7, 5.9, 0.0), (None, 5.0, 0.0)]).select("label", "features", "id")
    out = KNNClassifier(k=1).fit(train).transform(queries)
    assert out.columns == ["label", "features", "id", "prediction"]
    assert sorted((r.features[0], r.prediction) for r in out.collect()) == [(0.1, 1.0), (5.0, 2.0), (5.9, 2.0)]
    with pytest.raises(ValueError, match="name every row once"):
        KNNOutlierDetector().fit(queries)


def test_empty_names_add_no_column(spark):
    train = points(spark, [(1, 0.0, 1.0), (2, 6.0, 2.0)])
    assert KNNClassifier(predictionCol="").fit(train).transform(train).columns == train.columns
    assert KNNRegressor(predictionCol="").fit(train).transform(train).columns == train.columns
    assert KNNOutlierDetector(predictionCol="").fit(train).transform(train).columns == [*train.columns, "indegree"]


def test_labels(spark):
    odd = points(spark, [(1, 0.0, 1.0), (2, 6.0, 1.5)])
    with pytest.raises(ValueError, match="labels"):
        KNNClassifier(probabilityCol="p").fit(odd)
    with pytest.raises(ValueError, match="labels"):
        KNNClassifier(rawPredictionCol="p").fit(points(spark, [(1, 0.0, -1.0)]))
    assert KNNClassifier().setLabelCol("label").setProbabilityCol("").setSeed(3).fit(odd).transform(odd).count() == 2
    train = points(spark, [(1, 0.0, None), (2, 1.0, 10.0)])
    got = KNNRegressor(k=2).fit(train).transform(points(spark, [(0, 0.5, 0.0)])).first().prediction
    assert got == 10.0


def test_class_count_metadata(spark):
    from vicinity import class_count

    df = points(spark, [(1, 0.0, 0.0)])
    for attr, n in (({"type": "binary", "vals": ["a", "b"]}, 2), ({"type": "nominal", "vals": ["a", "b", "c"]}, 3), ({"type": "nominal", "num_vals": 7}, 7), ({"type": "numeric"}, 1)):
        assert class_count(df.select(F.col("label").alias("label", metadata={"ml_attr": attr})), "label") == n


def test_read_libsvm_is_exported():
    assert callable(read_libsvm)


def test_index_of_one_point(spark):
    df = spark.createDataFrame([(7, [1.0, 2.0], 3.0)], "id long, features array<double>, label double")
    index = build_index(df, centers="kmeans")
    assert [tuple(r) for r in knn_join(df, index, 2).collect()] == [(7, 7, 3.0, 0.0, 1)]
