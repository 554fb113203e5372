"""The k-NN graph under appended points equals a rebuild."""

import numpy as np
import pytest

from vicinity import append_points, build_graph, build_index, indegree, knn_self_join
from vicinity.operators import graph as G
from vicinity.operators import search as S

SCHEMA = "id long, features array<double>"


def lists(graph):
    return sorted(map(tuple, graph.neighbours().collect()))


def plain(rows, k):
    ids = np.array([i for i, _ in rows])
    mat = np.array([v for _, v in rows])
    out = []
    for i, v in zip(ids, mat, strict=True):
        d2 = np.cumsum((v - mat) ** 2, axis=1)[:, -1]
        near = [j for j in np.lexsort((ids, d2)) if ids[j] != i][:k]
        out += [(int(i), int(ids[j]), float(d2[j]), r) for r, j in enumerate(near, 1)]
    return sorted(out)


def degrees_of(neighbours, rows):
    counts = {i: 0 for i, _ in rows}
    for _, t, _, _ in neighbours:
        counts[t] += 1
    return counts


@pytest.mark.parametrize("width,max_segments", [(2, 8), (2, 1), (24, 8)])
def test_appends_equal_a_rebuild(spark, width, max_segments):
    rng = np.random.default_rng(width)
    k = 4
    # Few values: many ties and equal vectors; ids are shuffled over the batches.
    rows = [(int(i), rng.integers(0, 4 if width == 2 else 2, width).astype(float).tolist()) for i in rng.permutation(120)]
    batches = [rows[:3], rows[3:70], rows[70:71], rows[71:]]  # fewer than k points to begin with
    graph = build_graph(spark.createDataFrame(batches[0], SCHEMA), k)
    have = list(batches[0])
    for batch in batches[1:]:
        graph = append_points(graph, spark.createDataFrame(batch, SCHEMA), max_segments=max_segments)
        have += batch
        want = plain(have, k)
        assert lists(graph) == want
        assert {r.id: r.indegree for r in graph.degrees.collect()} == degrees_of(want, have)
    assert len(graph.segments) <= max_segments
    index = build_index(spark.createDataFrame(have, SCHEMA), label_col=None)
    assert lists(graph) == sorted(map(tuple, knn_self_join(index, k).select("q_id", "t_id", "d2", "rank").collect()))
    assert sorted(map(tuple, graph.indegrees().collect())) == sorted(map(tuple, indegree(index, k).collect()))


def test_a_distant_batch_measures_no_old_point_and_a_hot_vector_stays_small(spark, monkeypatch):
    k, n = 3, 300
    old = [(i, [float(i % 60), float(i % 7)]) for i in range(n)]
    graph = build_graph(spark.createDataFrame(old, SCHEMA), k)
    before = lists(graph)
    seen = []
    join = S._grid_join
    monkeypatch.setattr(S, "_grid_join", lambda cand, ix, target=None: (seen.append(join(cand, ix, target).count()), join(cand, ix, target))[1])
    far = append_points(graph, spark.createDataFrame([(1000 + i, [1e6, 1e6 + i]) for i in range(20)], SCHEMA))
    assert seen[-1] == 0  # the reverse search joins nothing
    assert [r for r in lists(far) if r[0] < 1000] == before
    seen.clear()
    hot = append_points(graph, spark.createDataFrame([(1000 + i, [3.0, 3.0]) for i in range(500)], SCHEMA))
    assert sum(seen) <= (k + 1) * (2 * n + 2 * (k + 1)) + n  # not 500 x 300
    want = plain(old + [(1000 + i, [3.0, 3.0]) for i in range(500)], k)
    assert lists(hot) == want


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    graph = build_graph(empty, 2)
    assert lists(graph) == [] and graph.degrees.collect() == []
    one = append_points(graph, spark.createDataFrame([(5, [1.0]), (6, None), (7, [float("nan")])], SCHEMA))
    assert lists(one) == [] and [tuple(r) for r in one.degrees.collect()] == [(5, 0)]
    assert append_points(one, empty) is one
    two = append_points(one, spark.createDataFrame([(4, [3.0])], SCHEMA))
    assert lists(two) == [(4, 5, 4.0, 1), (5, 4, 4.0, 1)]
    assert lists(one) == []  # the graph before stays as it was
    for bad in ([(5, [2.0])], [(8, [2.0]), (8, [3.0])], [(None, [2.0])], [(9, [2.0, 3.0])]):
        with pytest.raises(ValueError):
            append_points(two, spark.createDataFrame(bad, SCHEMA))
    with pytest.raises(ValueError):
        build_graph(empty, 0)
    assert G.MAX_SEGMENTS >= 1


def test_old_and_new_points_are_compared_once_for_both(spark, monkeypatch):
    rng = np.random.default_rng(9)
    k, rows = 3, [(int(i), rng.integers(0, 3, 20).astype(float).tolist()) for i in rng.permutation(90)]
    rows[-1] = (rows[-1][0], rows[0][1])  # a vector that is there already
    monkeypatch.setattr(S, "PACKED_PAIRS", 1)
    met = []
    monkeypatch.setattr(G, "packed_cross_search", lambda *x, search=G.packed_cross_search: met.append(x) or search(*x))
    monkeypatch.setattr(G, "_reverse", lambda *x: pytest.fail("pairs are compared a second time"))
    graph, have = build_graph(spark.createDataFrame(rows[:2], SCHEMA), k), rows[:2]
    for batch in (rows[2:50], rows[50:51], rows[51:]):
        graph = append_points(graph, spark.createDataFrame(batch, SCHEMA))
        have = have + batch
        want = plain(have, k)
        assert lists(graph) == want
        assert {r.id: r.indegree for r in graph.degrees.collect()} == degrees_of(want, have)
    assert len(met) == 3
