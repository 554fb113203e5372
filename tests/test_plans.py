"""Plan shape: top-k cut before the shuffle, no cross product, no Python, pruned scans."""

from vicinity import build_index, candidate_cells, knn_join, read_table
from vicinity.plans.checks import plan_text

from conftest import SF_SMALL


def _index(spark):
    emb = read_table(spark, SF_SMALL, "embeddings")
    return emb, build_index(emb.where("vec_id % 5 <> 0"), "vec_id", "embedding", "label")


def test_knn_plan_shape(spark):
    emb, idx = _index(spark)
    text = plan_text(knn_join(emb.where("vec_id % 5 = 0"), idx, 5, "vec_id", "embedding"), "formatted")
    assert "WindowGroupLimit" in text
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "collect_list"):
        assert bad not in text


def test_query_scan_is_pruned(spark):
    emb, idx = _index(spark)
    text = plan_text(candidate_cells(emb.where("vec_id % 5 = 0"), idx, 5, "vec_id", "embedding"), "formatted")
    # the query side reads only the two columns it needs, and the split reaches the scan
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in text
    assert "((vec_id#" in text and "% 5) = 0)" in text
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Exchange"):
        assert bad not in text


def test_registered_queries_have_no_python_stage(spark):
    import __spark_entry__ as entry

    for name in ("knn_classify", "knn_regress", "knn_indegree"):
        text = plan_text(entry.queries()[name](spark, SF_SMALL), "formatted")
        assert "EvalPython" not in text and "CartesianProduct" not in text, name


def test_replicated_points_are_not_broadcast(spark, monkeypatch):
    # with query blocks the points are repeated per block; the static planner
    # must not broadcast them on an estimate that ignores the repetition
    from vicinity.operators import search as S

    monkeypatch.setattr(S, "TARGET_PAIRS", 50)
    monkeypatch.setattr(S, "BROADCAST_CANDIDATE_BYTES", 0)
    monkeypatch.setattr(S, "MIN_PAIRS_PER_KEY", 50)
    emb, idx = _index(spark)
    text = plan_text(knn_join(emb.where("vec_id % 5 = 0"), idx, 5, "vec_id", "embedding"), "formatted")
    join_lines = [line for line in text.splitlines() if "Join Inner" in line]
    assert join_lines and all("SortMergeJoin" in line for line in join_lines), join_lines
