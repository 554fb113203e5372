"""Estimators over every index, and their schemas without a job."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from vicinity import assemble, read_table
from vicinity.ml import KNNClassifier, KNNOutlierDetector, KNNRegressor


def _rows(df, *names):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*names).collect()), key=repr)


@pytest.fixture(scope="module")
def part(spark):
    p = read_table(spark, SF_SMALL, "part")
    return assemble(p, ["p_size", F.length("p_type")], "features").select(F.col("p_partkey").alias("id"), "features", (F.col("p_size") % 3).cast("double").alias("label"))


@pytest.mark.parametrize("search", ["tree", "blocks"])
def test_estimators_agree_over_every_index(spark, part, search):
    q = part.drop("label")
    for make, names in ((KNNClassifier, ["id", "prediction", "p"]), (KNNRegressor, ["id", "prediction"])):
        more = {"probabilityCol": "p"} if make is KNNClassifier else {}
        want, got = (make(k=4, search=s, **more).fit(part).transform(q) for s in ("exact", search))
        assert _rows(got, *names) == _rows(want, *names)
    for key in ("id", "value"):
        want, got = (KNNOutlierDetector(k=3, threshold=1, key=key, search=s).fit(q).detect() for s in ("exact", search))
        assert _rows(got, *want.columns) == _rows(want, *want.columns)


def test_schema_without_a_job(spark, part):
    q = part.drop("label")
    models = [
        KNNClassifier(k=2, probabilityCol="p", rawPredictionCol="r").fit(part), KNNClassifier(k=2, predictionCol="").fit(part),
        KNNRegressor(k=2).fit(part), KNNOutlierDetector(k=2, threshold=0).fit(q),
    ]
    kinds = lambda schema: [(f.name, f.dataType.simpleString()) for f in schema]
    for m in models:
        assert kinds(m.transformSchema(q.schema)) == kinds(m.transform(q).schema)
    with pytest.raises(ValueError):
        models[2].transformSchema(q.withColumn("prediction", F.lit(1)).schema)
    with pytest.raises(ValueError):
        models[2].transformSchema(q.drop("features").schema)
