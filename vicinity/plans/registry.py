"""The queries that prove each operator, over the driver's tables.

Every builder takes ``(spark, sf_dir)`` and returns a DataFrame over whole
tables. For classification and regression, ``embeddings`` is split into queries
(``vec_id % 5 = 0``) and training rows (the rest); joins search among all rows,
and self-joins use every row on both sides. Computed doubles are rounded to 6
places so another engine can be compared value for value; array columns are
reported through scalar summaries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.functions.sparse import sparse_norm, sparse_sqdist
from vicinity.functions.vectors import fast_sqdist, norm, sqdist, sqdist_sql
from vicinity.ml import KNNClassifier, KNNOutlierDetector, KNNRegressor
from vicinity.operators.cells import build_index, cell_count_col, centers_sql, label_centers
from vicinity.operators.graph import append_points, build_graph
from vicinity.operators.outliers import indegree, indegree_summary, outlier_flags, outliers
from vicinity.operators.predict import (
    attach,
    class_count,
    class_count_df,
    classify_predictions,
    regress_predictions,
    vote_counts,
    vote_share,
)
from vicinity.operators.search import candidate_cells, knn_join, knn_self_join
from vicinity.operators.sparse_search import build_sparse_index, sparse_knn_join
from vicinity.operators.tree import build_tree_index
from vicinity.session import materialize, scratch_path
from vicinity.sources.libsvm import read_libsvm, read_sparse_libsvm, write_libsvm, write_sparse_libsvm
from vicinity.sources.points import assemble, labeled_points, number_rows, read_table
from vicinity.sources.terms import term_counts

# Fixed parameters of the registered queries.
K = 5
K_SELF = 10
THRESHOLD = 3
SEED = 17
SPLIT = "vec_id % 5 = 0"


def _emb(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings")


def _split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    emb = _emb(spark, sf)
    return emb.where(SPLIT), emb.where(f"NOT ({SPLIT})")


def _r(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)



def _nn(spark: SparkSession, sf: str, search: str = "pruned", centers="auto", whole: bool = False) -> DataFrame:
    """Neighbours of the queries among the training rows, or among all rows (``whole``)."""
    q, t = _split(spark, sf)
    t = _emb(spark, sf) if whole else t
    index = build_index(t, "vec_id", "embedding", "label", centers=centers, seed=SEED)
    return knn_join(q, index, K, "vec_id", "embedding", search=search)


def _width(df: DataFrame, col: str) -> int:
    row = df.where(F.col(col).isNotNull()).select(F.size(col).alias("w")).first()
    return int(row["w"]) if row else 0


def _label_index(df: DataFrame):
    dim = _width(df, "embedding")
    centers = label_centers(df, "label", "embedding", dim, decimals=6)
    return build_index(df, "vec_id", "embedding", "label", centers=centers)


def _placed(name: str):
    """Sum of the elements weighted by their place: another order gives another value."""
    fold = f"aggregate(transform({name}, (x, i) -> x * (i + 1)), 0D, (acc, x) -> acc + x)"
    return F.round(F.expr(fold), 6).alias("f_placed")


# ---- sources and scalar functions -------------------------------------------

def q_labeled_points(spark, sf):
    lp = labeled_points(_emb(spark, sf), "vec_id", "label", "embedding")
    return lp.select(
        "id", "label",
        F.size("features").cast("long").alias("dim"),
        F.array_min("features").alias("f_min"),
        F.array_max("features").alias("f_max"),
        _placed("features"),
    )


def q_vector_norm(spark, sf):
    lp = labeled_points(_emb(spark, sf), "vec_id", "label", "embedding")
    dim = _width(lp, "features")
    return lp.select("id", F.round(norm("features", dim), 6).alias("norm"))


def _to_label_center(spark, sf):
    emb = _emb(spark, sf)
    dim = _width(emb, "embedding")
    centers = label_centers(emb, "label", "embedding", dim, decimals=6)
    lp = labeled_points(emb, "vec_id", "label", "embedding")
    joined = lp.join(centers, lp["label"].cast("int") == centers["cell"])
    return joined.select("id", "cell", sqdist("features", "center", dim).alias("d2"))


def q_pairwise_sqdist(spark, sf):
    return _to_label_center(spark, sf).select("id", "cell", _r("d2"))


def q_pairwise_distance(spark, sf):
    return _to_label_center(spark, sf).select("id", "cell", F.round(F.sqrt("d2"), 6).alias("dist"))


def q_libsvm_scan(spark, sf):
    path = scratch_path(spark, "libsvm-embeddings")
    write_libsvm(_emb(spark, sf), path, "label", "embedding")
    back = read_libsvm(spark, path, num_features=_width(_emb(spark, sf), "embedding"))
    return back.select(
        "label",
        F.size("features").cast("long").alias("dim"),
        F.array_min("features").alias("f_min"),
        F.array_max("features").alias("f_max"),
        _placed("features"),
    )


# ---- k-NN join ----------------------------------------------------------------

def _nn_out(nn: DataFrame) -> DataFrame:
    return nn.select("q_id", "t_id", "label", _r("d2"), "rank")


def q_knn_join(spark, sf):
    return _nn_out(_nn(spark, sf, search="exact", centers="single", whole=True))


def q_knn_join_pruned(spark, sf):
    return _nn_out(_nn(spark, sf, search="pruned", centers="kmeans", whole=True))


def q_knn_join_single_cell(spark, sf):
    q, _ = _split(spark, sf)
    nn = knn_join(q, _label_index(_emb(spark, sf)), K, "vec_id", "embedding", search="single_cell")
    return _nn_out(nn)


def q_knn_join_blocks(spark, sf):
    """Brute force by matrix products of blocks, with an exact recheck."""
    return _nn_out(_nn(spark, sf, search="blocks", centers="single", whole=True))


def q_fast_sqdist(spark, sf):
    """Distance of every point to its label's mean vector, from stored norms where these are good enough."""
    emb = _emb(spark, sf)
    dim = _width(emb, "embedding")
    centers = label_centers(emb, "label", "embedding", dim, decimals=6)
    lp = labeled_points(emb, "vec_id", "label", "embedding")
    joined = lp.join(centers, lp["label"].cast("int") == centers["cell"]).select("id", "cell", "features", "center")
    normed = joined.withColumns({"fn": norm("features", dim), "cn": norm("center", dim)})
    return normed.select("id", "cell", F.round(fast_sqdist("features", "fn", "center", "cn", dim), 6).alias("d2"))


def _lineitem_points(spark, sf):
    """All of ``lineitem``, numbered over its columns, as four scaled features."""
    items = read_table(spark, sf, "lineitem")
    rows = number_rows(items, items.columns, "id", keep=["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return assemble(rows, [F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_discount") * 100, F.col("l_tax") * 100]).select("id", "features")


def q_tree_knn_join(spark, sf):
    """Neighbours of every line item whose number 50 divides, among all, through the centre tree."""
    pts = _lineitem_points(spark, sf)  # the numbered rows are written
    index = build_tree_index(pts, label_col=None, seed=SEED)
    nn = knn_join(pts.where("id % 50 = 0"), index, K)
    return nn.select("q_id", "t_id", _r("d2"), "rank")


def q_tree_cells(spark, sf):
    """The tree's cells and what must hold for them: every point in the ring of its distance, all points counted."""
    pts = _lineitem_points(spark, sf)  # the numbered rows are written
    index = build_tree_index(pts, label_col=None, seed=SEED)
    rings = index.table.select(F.explode("cells").alias("c")).select("c.cell", "c.center", "c.radius", F.inline("c.rings")).drop("subs")
    placed = index.points.join(rings, ["cell", "ring"], "left")
    far = F.abs(F.sqrt(sqdist("t_vec", "center", index.dim)) - F.col("t_dist")) > 1e-9 * (1 + F.col("t_dist"))
    members = rings.agg(F.sum("n")).first()[0]
    return placed.agg(
        F.count(F.lit(1)).alias("points"), F.lit(members).cast("long").alias("members"),
        F.count(F.when(F.col("lo").isNull() | (F.col("t_dist") < F.col("lo")) | (F.col("t_dist") > F.col("hi")) | (F.col("t_dist") > F.col("radius")) | far, 1)).alias("misplaced"),
        (F.count_distinct("cell") >= F.lit(index.n_cells // 2)).alias("cells_grow"),
    )


def q_part_self_join(spark, sf):
    """Self-join by id over many equal vectors, each searched once."""
    index = build_index(_part_points(spark, sf), "p_partkey", "features", None, seed=SEED)
    return knn_self_join(index, K).select("q_id", "t_id", _r("d2"), "rank")


def q_part_self_join_append(spark, sf):
    """The lists of ``part_self_join``, kept up while two batches of parts are appended."""
    pts = _part_points(spark, sf)
    graph = build_graph(pts.where("p_partkey % 5 > 1"), K, "p_partkey", "features", seed=SEED)
    for batch in (0, 1):
        graph = append_points(graph, pts.where(f"p_partkey % 5 = {batch}"), "p_partkey", "features")
    return graph.neighbours().select("q_id", "t_id", _r("d2"), "rank")


def q_knn_indegree_append(spark, sf):
    """The in-degrees of ``knn_indegree``, kept up while two batches of vectors are appended."""
    emb = _emb(spark, sf)
    graph = build_graph(emb.where("vec_id % 5 > 1"), K_SELF, "vec_id", "embedding", seed=SEED)
    for batch in (0, 1):
        graph = append_points(graph, emb.where(f"vec_id % 5 = {batch}"), "vec_id", "embedding")
    return graph.indegrees().select("id", "indegree")


def q_knn_self_join(spark, sf):
    index = build_index(_emb(spark, sf), "vec_id", "embedding", "label", centers="kmeans", seed=SEED)
    return knn_self_join(index, K_SELF).select("q_id", "t_id", _r("d2"), "rank")


# ---- cells ----------------------------------------------------------------------

def q_nearest_cell(spark, sf):
    index = _label_index(_emb(spark, sf))
    return index.points.select(F.col("t_id").alias("id"), "cell", F.round("t_dist", 6).alias("dist"))


def q_cell_stats(spark, sf):
    index = _label_index(_emb(spark, sf))
    return index.points.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("t_dist"), 6).alias("radius")
    )


def q_candidate_cells(spark, sf):
    q, _ = _split(spark, sf)
    return candidate_cells(q, _label_index(_emb(spark, sf)), K, "vec_id", "embedding").select("q_id", "cell")


def q_cell_count(spark, sf):
    n = _emb(spark, sf).agg(F.count(F.lit(1)).alias("n"))
    return n.select("n", cell_count_col(F.col("n"), 50).alias("cells"))


def q_kmeans_cells(spark, sf):
    """k-means cells and what must hold for them: every point in its nearest cell, none beyond its radius."""
    index = build_index(_emb(spark, sf), "vec_id", "embedding", "label", centers="kmeans", seed=SEED)
    centers = centers_sql([(c.cell, c.center) for c in index.cells])
    nearest = F.expr(f"array_min(transform({centers}, c -> {sqdist_sql('t_vec', 'c.center')}))")
    radius = F.create_map(*[F.lit(x) for c in index.cells for x in (c.cell, c.radius)])
    checked = index.points.select("cell", "t_dist", F.sqrt(nearest).alias("nearest"), radius[F.col("cell")].alias("radius"))
    return checked.agg(
        F.count(F.lit(1)).alias("points"),
        F.count_distinct("cell").alias("cells"),
        F.lit(sum(c.n for c in index.cells)).cast("long").alias("members"),
        F.count(F.when(F.col("t_dist") > F.col("nearest") * (1 + 1e-9), 1)).alias("misplaced"),
        F.count(F.when(F.col("t_dist") > F.col("radius"), 1)).alias("outside"),
    )


# ---- classification and regression --------------------------------------------

def q_class_count(spark, sf):
    return class_count_df(_emb(spark, sf), "label")


def q_vote_counts(spark, sf):
    return vote_counts(_nn(spark, sf))


def q_vote_share(spark, sf):
    return vote_share(_nn(spark, sf)).select("q_id", "label", "votes", _r("share"))


def q_knn_classify(spark, sf):
    q, _ = _split(spark, sf)
    preds = classify_predictions(_nn(spark, sf))
    out = attach(q, preds, "vec_id", ["prediction"])
    return out.select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("label"), "prediction")


def _regress(spark, sf, exact_match: str, whole_training: bool):
    q, t = _split(spark, sf)
    if whole_training:
        t = _emb(spark, sf)
    index = build_index(t, "vec_id", "embedding", "label", seed=SEED)
    nn = knn_join(q, index, K, "vec_id", "embedding")
    out = attach(q, regress_predictions(nn, exact_match=exact_match), "vec_id", ["prediction"])
    return out.select(F.col("vec_id").alias("id"), _r("prediction"))


def q_knn_regress(spark, sf):
    return _regress(spark, sf, "mean", False)


def q_knn_regress_exact_match(spark, sf):
    return _regress(spark, sf, "mean", True)


def q_knn_regress_exact_sum(spark, sf):
    return _regress(spark, sf, "sum", True)


# ---- outliers ---------------------------------------------------------------------

def _degrees(spark, sf):
    index = build_index(_emb(spark, sf), "vec_id", "embedding", "label", seed=SEED)
    return indegree(index, K_SELF)


def q_knn_indegree(spark, sf):
    return _degrees(spark, sf).select("id", "indegree")


def q_indegree_summary(spark, sf):
    return indegree_summary(_degrees(spark, sf)).select("total", "points", _r("mean"))


def q_knn_outliers(spark, sf):
    return outliers(_degrees(spark, sf), THRESHOLD).select("id", "indegree")


def q_outlier_flags(spark, sf):
    return outlier_flags(_degrees(spark, sf), THRESHOLD).select("id", "indegree", "prediction")


# ---- the estimators ---------------------------------------------------------------

def q_knn_classifier_model(spark, sf):
    q, t = _split(spark, sf)
    model = KNNClassifier(k=K, idCol="vec_id", featuresCol="embedding", seed=SEED).fit(t)
    return model.transform(q).select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("label"), "prediction")


def q_knn_regressor_model(spark, sf):
    q, t = _split(spark, sf)
    model = KNNRegressor(k=K, idCol="vec_id", featuresCol="embedding", seed=SEED).fit(t)
    return model.transform(q).select(F.col("vec_id").alias("id"), _r("prediction"))


def _outlier_model(spark, sf):
    return KNNOutlierDetector(k=K_SELF, threshold=THRESHOLD, idCol="vec_id", featuresCol="embedding", seed=SEED).fit(_emb(spark, sf))


def q_outlier_model_detect(spark, sf):
    return _outlier_model(spark, sf).detect().select("id", "indegree")


def q_outlier_model_transform(spark, sf):
    out = _outlier_model(spark, sf).transform(_emb(spark, sf))
    return out.select(F.col("vec_id").alias("id"), "indegree", "prediction")


def q_class_count_metadata(spark, sf):
    """Class count from the metadata that ``StringIndexer`` leaves."""
    customer = read_table(spark, sf, "customer")
    indexed = StringIndexer(inputCol="c_mktsegment", outputCol="segment").fit(customer).transform(customer)
    return indexed.agg(F.count(F.lit(1)).alias("n"), F.lit(class_count(indexed, "segment")).cast("long").alias("num_classes"))


def q_knn_join_offset(spark, sf):
    """Pruned search on features far from the origin, where rounding errors are large."""
    part = read_table(spark, sf, "part")
    pts = assemble(part, ["p_size", F.col("p_retailprice") + F.lit(1e9)]).select("p_partkey", "features")
    index = build_index(pts, "p_partkey", "features", None, centers="kmeans", seed=SEED)
    nn = knn_join(pts.where("p_partkey % 5 = 0"), index, K, "p_partkey", "features")
    return nn.select("q_id", "t_id", _r("d2", 3), "rank")


def _part_points(spark, sf):
    part = read_table(spark, sf, "part")
    return assemble(part, ["p_size", F.length("p_type")], "features")


def _value_degrees(spark, sf):
    index = build_index(_part_points(spark, sf), "p_partkey", "features", None, seed=SEED)
    deg = indegree(index, K_SELF, key="value")
    return deg.select(F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1"), "indegree")


def q_knn_indegree_by_value(spark, sf):
    return _value_degrees(spark, sf)


def q_knn_outliers_by_value(spark, sf):
    return outliers(_value_degrees(spark, sf), THRESHOLD)


# ---- sparse vectors: term counts of the documents -----------------------------------

K_SPARSE = 10


def _term_counts(spark, sf):
    """Documents as sparse vectors of word counts, written as LibSVM text (label = doc_id) and read back."""
    rows, width = term_counts(read_table(spark, sf, "documents"), "doc_id", "text")
    path = scratch_path(spark, "libsvm-terms")
    write_sparse_libsvm(rows, path, "doc_id", "features")
    return read_sparse_libsvm(spark, path, width).select(F.col("label").cast("long").alias("doc_id"), "features")


def q_sparse_vector_norm(spark, sf):
    terms = _term_counts(spark, sf)
    return terms.select("doc_id", F.size("features.indices").cast("long").alias("stored"), F.round(sparse_norm("features"), 6).alias("norm"))


def q_sparse_sqdist(spark, sf):
    """Distance of every document to the one with the next smaller id, by a merge of their entries."""
    terms = materialize(_term_counts(spark, sf), "term-vectors")
    ranked = number_rows(terms.select("doc_id"), ["doc_id"], "place")
    pairs = ranked.join(ranked.select(F.col("doc_id").alias("before"), (F.col("place") + 1).alias("place")), "place")
    joined = pairs.join(terms, "doc_id").join(terms.select(F.col("doc_id").alias("before"), F.col("features").alias("other")), "before")
    return joined.select("doc_id", "before", F.round(sparse_sqdist("features", "other"), 6).alias("d2"))


def q_sparse_knn_join(spark, sf):
    """The nearest documents by word counts of every document whose id 50 divides, among all."""
    terms = materialize(_term_counts(spark, sf), "term-vectors")
    index = build_sparse_index(terms, "doc_id", "features", None)
    nn = sparse_knn_join(terms.where("doc_id % 50 = 0"), index, K_SPARSE, "doc_id")
    return nn.select("q_id", "t_id", _r("d2"), "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "labeled_points": q_labeled_points,
    "vector_norm": q_vector_norm,
    "pairwise_sqdist": q_pairwise_sqdist,
    "pairwise_distance": q_pairwise_distance,
    "libsvm_scan": q_libsvm_scan,
    "knn_join": q_knn_join,
    "knn_join_pruned": q_knn_join_pruned,
    "knn_join_single_cell": q_knn_join_single_cell,
    "knn_self_join": q_knn_self_join,
    "nearest_cell": q_nearest_cell,
    "cell_stats": q_cell_stats,
    "candidate_cells": q_candidate_cells,
    "cell_count": q_cell_count,
    "kmeans_cells": q_kmeans_cells,
    "class_count": q_class_count,
    "vote_counts": q_vote_counts,
    "vote_share": q_vote_share,
    "knn_classify": q_knn_classify,
    "knn_regress": q_knn_regress,
    "knn_regress_exact_match": q_knn_regress_exact_match,
    "knn_regress_exact_sum": q_knn_regress_exact_sum,
    "knn_indegree": q_knn_indegree,
    "indegree_summary": q_indegree_summary,
    "knn_outliers": q_knn_outliers,
    "outlier_flags": q_outlier_flags,
    "knn_indegree_by_value": q_knn_indegree_by_value,
    "knn_outliers_by_value": q_knn_outliers_by_value,
    "knn_classifier_model": q_knn_classifier_model,
    "knn_regressor_model": q_knn_regressor_model,
    "outlier_model_detect": q_outlier_model_detect,
    "outlier_model_transform": q_outlier_model_transform,
    "class_count_metadata": q_class_count_metadata,
    "knn_join_offset": q_knn_join_offset,
    "sparse_vector_norm": q_sparse_vector_norm,
    "sparse_sqdist": q_sparse_sqdist,
    "sparse_knn_join": q_sparse_knn_join,
    "fast_sqdist": q_fast_sqdist,
    "knn_join_blocks": q_knn_join_blocks,
    "tree_knn_join": q_tree_knn_join,
    "tree_cells": q_tree_cells,
    "part_self_join": q_part_self_join,
    "part_self_join_append": q_part_self_join_append,
    "knn_indegree_append": q_knn_indegree_append,
}
