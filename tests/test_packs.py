"""Packed blocks: the same neighbours as the grid join, bit for bit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinity import build_index, knn_join, knn_self_join
from vicinity.operators import packs as P
from vicinity.operators import search as S
from vicinity.operators.graph import append_points, build_graph


def rows_of(nn):
    return sorted(tuple(-9 if x is None else x for x in r) for r in nn.select("q_id", "t_id", "label", "d2", "rank").collect())


def table(spark, width, scale=1.0, n=600):
    rng = np.random.default_rng(width)
    v = (rng.normal(0, 1, (n, width)) + 3 * rng.integers(0, 4, (n, 1))).round(1) * scale
    v[50:90] = v[50]  # copies, and ties
    rows = [(i, v[i].tolist(), None if i % 7 == 0 else float(i % 3)) for i in range(n)] + [(n + 1, None, 1.0)]
    return spark.createDataFrame(rows, "id long, features array<double>, label double")


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(S, "TWO_PHASE_MIN_CELL", 20)
    for name, value in (("PACK_ROWS", 150), ("RING_ROWS", 40), ("QUERY_ROWS", 16), ("TASK_PAIRS", 60_000), ("CHECK_VALUES", 300), ("FILE_BYTES", 120_000)):
        monkeypatch.setattr(P, name, value)
    return lambda pairs: monkeypatch.setattr(S, "PACKED_PAIRS", pairs)


CASES = [("exact", "single", 2, 1.0), ("exact", "single", 40, 1e-20), ("exact", "single", 40, 1e120), ("pruned", "kmeans", 2, 1.0), ("pruned", "kmeans", 40, 1e8), ("single_cell", "kmeans", 40, 1.0), ("blocks", "single", 40, 1.0)]


@pytest.mark.parametrize("search,centers,width,scale", CASES)
def test_packed_equals_the_grid_join(spark, small, width, scale, search, centers):
    df = table(spark, width, scale)
    index = build_index(df, centers=centers, max_cells=6, block_rows=50)
    small(0)
    got = rows_of(knn_join(df.where("id % 3 = 0"), index, 5, search=search))
    small(10**12)
    want = rows_of(knn_join(df.where("id % 3 = 0"), index, 5, search=search))
    assert len(want) == 200 * 5 and got == want


@pytest.mark.parametrize("width,search", [(3, "pruned"), (30, "exact")])
def test_packed_self_join(spark, small, width, search):
    df = table(spark, width).dropDuplicates(["features"])
    index = build_index(df, centers="kmeans" if search == "pruned" else "single", max_cells=5, block_rows=50)
    small(0)
    got = rows_of(knn_self_join(index, 4, search=search))
    small(10**12)
    assert got == rows_of(knn_self_join(index, 4, search=search)) and len(got) > 2000


def test_null_and_repeated_ids_and_few_points(spark, small):
    df = table(spark, 20, n=60)
    df = df.unionByName(df.where("id < 5")).unionByName(df.where("id = 7").withColumn("id", F.lit(None).cast("long")))
    index = build_index(df, centers="single", block_rows=20)
    few = build_index(df.where("id < 3"), centers="single")
    for ix, k in ((index, 6), (few, 9)):
        small(0)
        got = rows_of(knn_join(df.where("id % 2 = 0 OR id IS NULL"), ix, k, search="exact"))
        small(10**12)
        assert got == rows_of(knn_join(df.where("id % 2 = 0 OR id IS NULL"), ix, k, search="exact"))


def test_rows_that_cross_the_shuffle_do_not_grow_with_the_pairs(spark, small, monkeypatch):
    monkeypatch.setattr(P, "FILE_BYTES", 1 << 20)
    df = table(spark, 20, n=2_000)
    index = build_index(df, centers="single", block_rows=50)
    small(0)
    nn = knn_join(df, index, 3, search="exact")
    found = spark.read.parquet(*nn.inputFiles())
    assert found.count() <= 2_000 * 3 * 4  # of 4,000,000 pairs: k for each query and file of points


def test_assignment_in_batches_equals_the_written_out(spark, monkeypatch):
    from vicinity.operators import cells as C

    pts = table(spark, 5).where("features IS NOT NULL").select(F.col("id").alias("t_id"), F.col("features").alias("t_vec"))
    centers = [(4, (0.0,) * 5), (2, (1.0,) * 5), (1, (1.0,) * 5), (9, (7.5,) * 5)]
    got = [sorted(map(tuple, C.assign(pts, centers, 5).select("t_id", "cell", "t_dist").collect())) for n in (480, 1) if monkeypatch.setattr(C, "MAX_UNROLLED_TERMS", n) is None]
    assert got[0] == got[1] and {r[1] for r in got[0]} == {1, 4, 9}


def test_copies_do_not_swamp_a_list(spark):
    base = spark.range(3_000).select(F.col("id"), F.when(F.col("id") < 2_900, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.col("id") * 1.0, F.lit(0.0))).alias("vec"))
    kept = P._first_copies(base, 5)
    assert kept.count() == 105 and [r.id for r in kept.where("id < 2900").orderBy("id").collect()] == [0, 1, 2, 3, 4]


def test_few_queries_are_not_dealt_over_files_that_all_points_are_read_for():
    """26,000 queries among 104,000 points were 48 files of 542 queries, each read with all points."""
    q_files, t_files = P._files(26_000, 16_384, 104_000, 8 * 64 + 32, 48)
    assert 26_000 // q_files >= P.FILE_QUERIES and q_files * t_files >= 48
    assert P._files(500, 16_384, 104_000, 544, 48)[0] == 1
    assert P._files(10**6, 16_384, 100, 544, 48)[0] * 16_384 >= 10**6  # a file of queries holds one packed row
    assert P._files(10, 10, 10**9, 544, 1)[1] * P.FILE_BYTES >= 544 * 10**9


def test_places_of_true_values():
    rng = np.random.default_rng(5)
    for rows, cols in ((1, 1), (3, 5), (16, 64), (33, 41), (1, 7), (5, 0)):
        for share in (0.0, 0.001, 0.05, 0.9, 1.0):
            mask = rng.random((rows, cols)) < share
            assert P._true(mask).tolist() == np.flatnonzero(mask).tolist()


def nearest(pack, bound=np.inf, k=5, exclude_self=True):
    cells = {0: ((0.0,) * pack.vec.shape[1], float(pack.dist.max()), len(pack.ids), None)}
    return P.Nearest(pack.vec, pack.ids, pack.flags, np.broadcast_to(bound, len(pack.ids)), k, k + 1, cells, "pruned", exclude_self)


def pack_of(ids, vec):
    dist = np.sqrt((vec * vec).sum(1))
    order = np.argsort(dist)
    return P.Pack(np.zeros(len(ids), "i4"), dist[order], vec[order], ids[order], np.full(len(ids), 3, "u1"), ids[order] * 1.0)


def brute(vec, k=5):
    d2 = np.cumsum((vec[:, None, :] - vec[None, :, :]) ** 2, axis=2)[:, :, -1]
    np.fill_diagonal(d2, np.inf)
    return {i: [(d2[i, j], j) for j in np.lexsort((np.arange(len(vec)), d2[i]))[:k]] for i in range(len(vec))}


def lists_of(*states):
    found = {}
    for state in states:
        ids, _, t, _, _, d2 = state.rows()
        for i, j, d in zip(ids.tolist(), t.tolist(), d2.tolist(), strict=True):
            found.setdefault(i, []).append((d, j))
    return {i: sorted(x)[:5] for i, x in found.items()}


def test_points_found_are_put_in_order_now_and_then(monkeypatch):
    """Not once for each block of queries and ring of points: that cost more than their products."""
    monkeypatch.setattr(P, "RING_ROWS", 20)
    monkeypatch.setattr(P, "QUERY_ROWS", 50)
    calls = []
    monkeypatch.setattr(P, "_ordered", lambda *x, ordered=P._ordered: calls.append(1) or ordered(*x))
    vec = np.random.default_rng(2).normal(0, 1, (1000, 20)).round(1)
    vec[300:320] = vec[300]  # ties
    pack = pack_of(np.arange(1000), vec)
    state = nearest(pack)
    state.take(pack)
    assert lists_of(state) == brute(vec)
    assert len(calls) <= 25  # of 1,000 blocks


def test_two_packed_rows_meet_once_for_the_lists_of_both(monkeypatch):
    vec = np.random.default_rng(3).normal(0, 1, (900, 20)).round(1)
    vec[300:320] = vec[300]
    ids = np.random.default_rng(4).permutation(900)
    packs = [pack_of(i, vec[i]) for i in (ids[:400], ids[400:897], ids[897:])]  # the last fills no list
    alone = [nearest(pack) for pack in packs]
    for state, pack in zip(alone, packs, strict=True):
        state.take(pack)
        state.rows()
    bounds = [np.sqrt(state.limit) for state in alone]
    compared = []
    monkeypatch.setattr(P, "_true", lambda mask, true=P._true: compared.append(mask.size) or true(mask))
    states = list(alone)
    for a, b in ((0, 1), (0, 2), (1, 2)):
        left, right = nearest(packs[a], bounds[a]), nearest(packs[b], bounds[b])
        compared.clear()
        left.meet(packs[a], right, packs[b])
        assert b == 2 or 0 < sum(compared) <= 400 * 497
        states += [left, right]
    assert lists_of(*states) == brute(vec)


@pytest.mark.parametrize("search", ["pruned", "exact"])
def test_packed_self_join_of_wide_copies(spark, small, search):
    df = table(spark, 30)
    index = build_index(df, centers="kmeans" if search == "pruned" else "single", max_cells=5, block_rows=50)
    small(0)
    got = rows_of(knn_self_join(index, 4, search=search))
    small(10**12)
    assert got == rows_of(knn_self_join(index, 4, search=search)) and len(got) == 600 * 4


def test_a_batch_of_a_graph_meets_itself_once(spark, small, monkeypatch):
    df = table(spark, 20, n=300).dropDuplicates(["features"])
    want = sorted(map(tuple, knn_self_join(build_index(df, centers="single"), 4).select("q_id", "t_id", "rank").collect()))
    small(0)
    met = []
    monkeypatch.setattr(S, "packed_self_search", lambda *x, search=P.packed_self_search: met.append(x) or search(*x))
    graph = append_points(build_graph(df.where("id % 3 > 0"), 4), df.where("id % 3 = 0"))
    assert sorted(map(tuple, graph.neighbours().select("q_id", "t_id", "rank").collect())) == want and len(met) == 2
