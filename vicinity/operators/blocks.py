"""Brute force over wide vectors by matrix products, with an exact recheck.

Queries and points meet in blocks of bounded rows, each pair of blocks once. A
pair of blocks is one matrix product: with the stored squared norms,
``|q|^2 + |t|^2 - 2 q.t`` is every squared distance but for rounding, at most
``error = ROUNDING * (width + 4) * (|q|^2 + |t|^2)``. Of a query, only points whose
approximate distance minus its error does not exceed the k-th smallest of
approximate distance plus error can be among its k nearest in the block; only these
get their true distance, added up in index order like everywhere else. So the
answer is that of the exact search, bit for bit, for a few full distances a query.

The blocks run in Arrow batches inside the tasks; Spark deals them out, and the top k over
all blocks is a window as in the other searches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vicinity.functions.vectors import sqnorm
from vicinity.operators.cells import CellIndex
from vicinity.session import allow_group_limit, materialize, ship_code

#: Rows of a block of queries, and of points (the index's blocks), that meet in one product.
QUERY_ROWS = 2_000
ROUNDING = 16 * 2.0**-53


def block_top(q, t, q2, t2, t_ids, k: int, q_ids=None):
    """``(query, point, d2)`` of each query's ``k`` nearest points of a block, ties to the smallest id, and the number of full distances.

    ``q`` and ``t`` are matrices, ``q2`` and ``t2`` squared norms. ``q_ids`` leaves out points of the query's own id.
    """
    import numpy as np

    with np.errstate(over="ignore", invalid="ignore"):
        size = q2[:, None] + t2[None, :]
        near = size - 2 * (q @ t.T)
        error = ROUNDING * (q.shape[1] + 4) * size
    # Beyond the range of doubles nothing is known: such a pair is measured.
    lost = ~np.isfinite(near)
    near[lost], error[lost] = 0.0, np.inf
    upper = near + error
    if q_ids is not None:
        own = q_ids[:, None] == t_ids[None, :]
        upper[own] = np.inf
    if k < t.shape[0]:
        limit = np.partition(upper, k - 1, axis=1)[:, k - 1]
        rows, cols = np.nonzero(near - error <= limit[:, None])
    else:
        rows, cols = np.nonzero(np.ones(near.shape, bool))
    if q_ids is not None:
        other = ~own[rows, cols]
        rows, cols = rows[other], cols[other]
    with np.errstate(over="ignore"):
        diff = q[rows] - t[cols]
        # cumsum adds in index order, as the expressions in the JVM do.
        d2 = np.cumsum(diff * diff, axis=1)[:, -1] if q.shape[1] else np.zeros(len(rows))
    order = np.lexsort((t_ids[cols], d2, rows))
    rows, cols, d2 = rows[order], cols[order], d2[order]
    first = np.searchsorted(rows, rows)
    kept = np.arange(len(rows)) - first < k
    return rows[kept], cols[kept], d2[kept], len(rows)


def blocks_search(q: DataFrame, index: CellIndex, k: int, exclude_self: bool = False) -> DataFrame:
    """``(q_id, t_id, label, d2, rank)`` of the queries ``(q_id, q_vec)`` among all points of the index."""
    spark = q.sparkSession
    ship_code(spark)
    label = F.col("t_label") if index.has_label else F.lit(None).cast("double")
    spread = [(c.cell, c.blocks) for c in index.cells]
    points = index.points.select("t_id", label.alias("label"), "t_vec", sqnorm("t_vec", index.dim).alias("t2"), "cell", "block")
    q = materialize(q.select("q_id", "q_vec", sqnorm("q_vec", index.dim).alias("q2")), "block-queries")
    qblocks = max(1, -(-q.count() // QUERY_ROWS))
    every = F.array(*[F.struct(F.lit(c).alias("cell"), F.lit(b).alias("blocks")) for c, b in spread])
    asked = q.withColumn("qblock", F.pmod(F.xxhash64("q_id"), F.lit(qblocks))).select("*", F.inline(every))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    points = points.withColumn("qblock", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(qblocks - 1).cast("long"))))
    keys = ["cell", "block", "qblock"]
    fields = {f.name: f.dataType for f in [*q.schema, *points.schema]}
    schema = T.StructType([T.StructField("q_id", fields["q_id"]), T.StructField("t_id", fields["t_id"]), T.StructField("label", T.DoubleType()), T.StructField("d2", T.DoubleType())])

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        def matrix(column):
            return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("q_id", left.schema.field("q_id").type), ("t_id", right.schema.field("t_id").type), ("label", pa.float64()), ("d2", pa.float64()))})
        ids = np.asarray(right.column("t_id").to_pylist())
        mine = np.asarray(left.column("q_id").to_pylist()) if exclude_self else None
        rows, cols, d2, _ = block_top(matrix(left.column("q_vec")), matrix(right.column("t_vec")), left.column("q2").to_numpy(), right.column("t2").to_numpy(), ids, k, mine)
        return pa.table({"q_id": left.column("q_id").take(pa.array(rows)), "t_id": right.column("t_id").take(pa.array(cols)), "label": right.column("label").take(pa.array(cols)), "d2": pa.array(d2)})

    found = asked.groupBy(*keys).cogroup(points.groupBy(*keys)).applyInArrow(run, schema)
    allow_group_limit(spark, k)
    w = Window.partitionBy("q_id").orderBy("d2", "t_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("q_id", "t_id", "label", "d2", "rank")
