"""Exact k-nearest-neighbour joins, classification, regression and outlier
detection as Spark DataFrame plans."""

from vicinity.functions.sparse import as_sparse, sparse_norm, sparse_sqdist
from vicinity.functions.vectors import as_array, distance, fast_sqdist, norm, sqdist, sqnorm
from vicinity.operators.cells import (
    Cell,
    CellIndex,
    assign,
    build_index,
    cell_count,
    cell_count_col,
    cell_stats,
    fit_centers,
    label_centers,
)
from vicinity.operators.graph import append_points, build_graph
from vicinity.operators.outliers import indegree, indegree_summary, outlier_flags, outliers
from vicinity.operators.predict import (
    attach,
    class_count,
    class_count_df,
    classify_predictions,
    probability_predictions,
    regress_predictions,
    vote_counts,
    vote_share,
)
from vicinity.operators.search import candidate_cells, knn_join, knn_self_join
from vicinity.operators.sparse_search import build_sparse_index, sparse_knn_join
from vicinity.operators.tree import build_tree_index
from vicinity.sources.libsvm import read_libsvm, read_sparse_libsvm, write_libsvm, write_sparse_libsvm
from vicinity.sources.points import assemble, ensure_id, labeled_points, number_rows, read_table

__all__ = [name for name in dir() if not name.startswith("_")]
