"""Params, copies, name clashes; LibSVM source; result sink; row numbering."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, points
from vicinity import number_rows, read_libsvm, read_table, write_libsvm
from vicinity.ml import KNNClassifier, KNNOutlierDetector, KNNRegressor
from vicinity.session import scratch_path


def test_copy_keeps_k_and_threshold(spark):
    est = KNNOutlierDetector(k=7, threshold=3)
    c = est.copy()
    assert c.getK() == 7 and c.getThreshold() == 3
    model = est.fit(points(spark, [(1, 0.0), (2, 1.0), (3, 5.0)], with_label=False))
    m2 = model.copy()
    assert m2.getK() == 7 and m2.getThreshold() == 3 and m2.index is model.index


def test_k_refused(spark):
    with pytest.raises(ValueError):
        KNNClassifier(k=0).fit(points(spark, [(1, 0.0, 1.0)]))
    with pytest.raises(ValueError):
        KNNOutlierDetector(k=1, threshold=-1).fit(points(spark, [(1, 0.0)], with_label=False))


def test_name_clash_refused(spark):
    train = points(spark, [(1, 0.0, 1.0), (2, 1.0, 2.0)])
    model = KNNClassifier(k=1).fit(train)
    with pytest.raises(ValueError):
        model.transform(train.withColumn("prediction", F.lit(1.0)))


def test_estimators_on_embeddings(spark):
    emb = read_table(spark, SF_SMALL, "embeddings")
    train, q = emb.where("vec_id % 5 <> 0"), emb.where("vec_id % 5 = 0")
    kw = dict(k=5, idCol="vec_id", featuresCol="embedding", labelCol="label")
    clf = KNNClassifier(probabilityCol="probability", **kw).fit(train)
    out = clf.transform(q)
    assert out.columns == q.columns + ["prediction", "probability"]
    rows = out.collect()
    assert len(rows) == q.count()
    for r in rows:
        assert abs(sum(r.probability) - 1.0) < 1e-9
        assert r.probability[int(r.prediction)] == max(r.probability)
    exact = KNNClassifier(search="exact", **kw).fit(train).transform(q)
    a = {r.vec_id: r.prediction for r in rows}
    b = {r.vec_id: r.prediction for r in exact.collect()}
    assert a == b
    reg = KNNRegressor(**kw).fit(train).transform(q)
    assert reg.where("prediction IS NULL").count() == 0


def test_outlier_detector_detect_is_pure(spark):
    emb = read_table(spark, SF_SMALL, "embeddings")
    m = KNNOutlierDetector(k=10, threshold=3, idCol="vec_id", featuresCol="embedding").fit(emb)
    a = m.detect().count()
    assert m.detect().count() == a
    flagged = m.transform(emb)
    assert flagged.where("prediction = 1.0").count() == a


def test_transform_without_id_column(spark):
    train = points(spark, [(1, 0.0, 1.0), (2, 10.0, 2.0)])
    q = spark.createDataFrame([([1.0],), ([9.0],)], "features array<double>")
    out = KNNClassifier(k=1).fit(train).transform(q).orderBy(F.col("features")[0]).collect()
    assert [r.prediction for r in out] == [1.0, 2.0]
    assert out[0].asDict().keys() == {"features", "prediction"}


def test_libsvm_hand_sample(spark, tmp_path):
    path = tmp_path / "sample.txt"
    path.write_text("1 1:0.5 3:2.0\n0 2:1.5\n")
    rows = read_libsvm(spark, str(path), num_features=3).orderBy("label").collect()
    assert [(r.label, list(r.features)) for r in rows] == [(0.0, [0.0, 1.5, 0.0]), (1.0, [0.5, 0.0, 2.0])]


def test_result_sink_round_trip(spark):
    emb = read_table(spark, SF_SMALL, "embeddings")
    path = scratch_path(spark, "sink")
    write_libsvm(emb, path, "label", "embedding")
    back = read_libsvm(spark, path, num_features=64)
    assert back.count() == emb.count()
    out = scratch_path(spark, "parquet")
    emb.write.parquet(out)
    assert spark.read.parquet(out).count() == emb.count()


def test_number_rows_is_dense_and_ordered(spark):
    li = read_table(spark, SF_SMALL, "lineitem")
    cols = li.columns
    numbered = number_rows(li.repartition(5), cols)
    rows = numbered.select("row_id", *cols).collect()
    ids = sorted(r.row_id for r in rows)
    assert ids == list(range(1, len(rows) + 1))
    by_id = sorted(rows, key=lambda r: r.row_id)
    keys = [tuple(r[c] for c in cols) for r in by_id]
    assert keys == sorted(keys)
