"""Score a stream of query rows with a fitted model.

Each micro-batch is an ordinary DataFrame, so ``foreachBatch`` runs the same
k-NN join against the model's stored index table (written once at ``fit``)
and hands the scored batch to a sink. No state is kept between batches: a
k-NN prediction depends only on the query row and the fixed index.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter


def score_stream(model, stream: DataFrame, sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """``stream.writeStream`` that applies ``model.transform`` to each micro-batch.

    ``sink(scored_batch, epoch_id)`` writes the result (e.g. an idempotent
    ``write.mode("append").parquet(path)`` keyed by ``epoch_id``). Start it
    with ``.option("checkpointLocation", ...).start()``.
    """

    def run(batch: DataFrame, epoch_id: int) -> None:
        sink(model.transform(batch), epoch_id)

    return stream.writeStream.foreachBatch(run)
