"""A stream of query rows scored micro-batch by micro-batch."""

from conftest import SF_SMALL
from vicinity import read_table
from vicinity.ml import KNNClassifier
from vicinity.session import scratch_path
from vicinity.streaming.scoring import score_stream


def test_stream_scores_like_batch(spark):
    emb = read_table(spark, SF_SMALL, "embeddings")
    train, q = emb.where("vec_id % 5 <> 0"), emb.where("vec_id % 5 = 0")
    model = KNNClassifier(k=5, idCol="vec_id", featuresCol="embedding").fit(train)
    src = scratch_path(spark, "stream-src")
    q.write.parquet(src)
    stream = spark.readStream.schema(q.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = scratch_path(spark, "stream-out")

    def sink(batch, epoch_id):
        batch.select("vec_id", "prediction").write.mode("append").parquet(out)

    query = score_stream(model, stream, sink).option("checkpointLocation", scratch_path(spark, "stream-ckpt")).start()
    query.processAllAvailable()
    query.stop()
    got = {r.vec_id: r.prediction for r in spark.read.parquet(out).collect()}
    want = {r.vec_id: r.prediction for r in model.transform(q).collect()}
    assert got == want
