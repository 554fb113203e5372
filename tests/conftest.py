import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vicinity.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    return local_session("*", shuffle_partitions=8, memory="4g", app="vicinity-tests")


def points(spark, rows, with_label=True):
    """Hand fixture: rows of (id, x[, label]) with ``features = array(x)``."""
    if with_label:
        df = spark.createDataFrame(rows, "id long, x double, label double")
    else:
        df = spark.createDataFrame(rows, "id long, x double")
    from pyspark.sql import functions as F

    return df.withColumn("features", F.when(F.col("x").isNull(), None).otherwise(F.array("x")))
