"""Outliers by in-degree in the k-NN graph.

A point's in-degree is how many other points list it among their ``k``
nearest. Points with in-degree at most ``threshold`` are outliers. The
self-join, the counts and the filter are DataFrame steps; nothing is
collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vicinity.operators.cells import CellIndex, build_index
from vicinity.operators.search import knn_self_join
from vicinity.operators.tree import TreeIndex, build_tree_index
from vicinity.session import allow_group_limit, materialize

KEYS = ("id", "value")


def indegree(
    index: CellIndex | TreeIndex,
    k: int,
    key: str = "id",
    count_self: bool = False,
    search: str = "pruned",
    nn: DataFrame | None = None,
) -> DataFrame:
    """In-degree of every training point (``key="id"``) or distinct vector (``key="value"``).

    ``key="id"``: ``(id, features, indegree)``, one row per point, 0 kept.
    ``key="value"``: ``(features, indegree)``, one row per distinct vector;
    a query adds at most 1 to a value however many of its neighbours share it.
    ``count_self`` follows :func:`knn_self_join`.
    """
    if key not in KEYS:
        raise ValueError(f"key must be one of {KEYS}")
    if key == "value" and nn is None and search != "single_cell":
        return _indegree_by_value(index, k, count_self, search)
    if nn is None:
        nn = knn_self_join(index, k, count_self=count_self, search=search, keep_vectors=(key == "value"))
    pts = index.points
    if key == "id":
        counts = nn.groupBy("t_id").agg(F.count(F.lit(1)).alias("_n"))
        return (
            pts.select("t_id", "t_vec")
            .join(counts, "t_id", "left")
            .select(
                F.col("t_id").alias("id"),
                F.col("t_vec").alias("features"),
                F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias("indegree"),
            )
        )
    counts = nn.groupBy("t_vec").agg(F.count_distinct("q_id").alias("_n"))
    values = pts.select("t_vec").distinct()
    return values.join(counts, "t_vec", "left").select(
        F.col("t_vec").alias("features"),
        F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias("indegree"),
    )


def _indegree_by_value(index: CellIndex | TreeIndex, k: int, count_self: bool, search: str) -> DataFrame:
    """In-degree of distinct vectors, searched among distinct vectors.

    Rows of one vector have the same neighbours but for themselves, so each
    vector is searched once, with the number of its rows and the ``k + 1``
    smallest of their ids. A vector whose first row is among the ``places``
    nearest rows has fewer than ``places`` vectors before it, so the nearest
    ``places`` vectors (by distance, then first id) hold all rows that count;
    their ids are laid out, ranked, and cut. Work grows with the vectors, not
    with the pairs of equal rows.
    """
    pts = index.points.select("t_id", "t_vec")
    if not index.cells:
        return pts.select(F.col("t_vec").alias("features"), F.lit(0).cast("long").alias("indegree"))
    places = k + 1 if count_self else k
    allow_group_limit(pts.sparkSession, k + 1)
    w = Window.partitionBy("t_vec").orderBy("t_id")
    few = pts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1)
    ids = few.groupBy("t_vec").agg(F.array_sort(F.collect_list("t_id")).alias("ids"))
    rows = pts.groupBy("t_vec").agg(F.count(F.lit(1)).alias("rows"), F.min("t_id").alias("id"))
    values = materialize(rows.join(ids, "t_vec"), "vector-values")
    if isinstance(index, TreeIndex):
        distinct = build_tree_index(values, "id", "t_vec", None)
    else:
        centers = [(c.cell, c.center) for c in index.cells]
        distinct = build_index(values, "id", "t_vec", None, centers=centers, block_rows=index.block_rows)
    # The vector itself comes first (distance 0), then up to ``places`` others.
    near = knn_self_join(distinct, places, count_self=True, search=search).select("q_id", "t_id", "d2")
    own = values.select(F.col("id").alias("q_id"), F.col("rows").alias("q_rows"))
    other = values.select(F.col("id").alias("t_id"), "ids")
    laid = near.join(own, "q_id").join(other, "t_id")
    # A row is not in its own list: one row less at its own vector.
    keep = F.when((F.col("q_id") == F.col("t_id")) & F.lit(not count_self), F.slice("ids", F.lit(1), F.size("ids") - 1)).otherwise(F.col("ids"))
    laid = laid.select("q_id", "q_rows", "t_id", "d2", F.explode(keep).alias("row"))
    first = laid.withColumn("_r", F.row_number().over(Window.partitionBy("q_id").orderBy("d2", "row"))).where(F.col("_r") <= places)
    counts = first.select("q_id", "q_rows", "t_id").distinct().groupBy("t_id").agg(F.sum("q_rows").alias("_n"))
    return values.join(counts.withColumnRenamed("t_id", "id"), "id", "left").select(
        F.col("t_vec").alias("features"), F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias("indegree")
    )


def indegree_summary(degrees: DataFrame) -> DataFrame:
    """``(total, points, mean)`` over an in-degree table."""
    return degrees.agg(
        F.sum("indegree").cast("long").alias("total"),
        F.count(F.lit(1)).alias("points"),
        F.avg("indegree").alias("mean"),
    )


def outliers(degrees: DataFrame, threshold: int) -> DataFrame:
    """Rows with ``indegree <= threshold``."""
    if threshold < 0:
        raise ValueError("threshold must be at least 0")
    return degrees.where(F.col("indegree") <= threshold)


def outlier_flags(degrees: DataFrame, threshold: int) -> DataFrame:
    """``degrees`` with ``prediction`` = 1.0 for an outlier, else 0.0."""
    if threshold < 0:
        raise ValueError("threshold must be at least 0")
    return degrees.withColumn("prediction", (F.col("indegree") <= threshold).cast("double"))
