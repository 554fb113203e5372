"""Matrix products with an exact recheck, distances from norms, equal rows searched once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinity import build_index, fast_sqdist, knn_join, knn_self_join, norm, sqdist
from vicinity.operators import blocks as B
from vicinity.operators import search as S


def plain(q, t, k, q_ids=None, t_ids=None):
    out = []
    for i, v in enumerate(q):
        d2 = np.cumsum((v - t) ** 2, axis=1)[:, -1]
        order = [j for j in np.lexsort((t_ids, d2)) if q_ids is None or t_ids[j] != q_ids[i]][:k]
        out += [(i, int(j), float(d2[j])) for j in order]
    return out


@pytest.mark.parametrize("offset", [0.0, 1e3, 1e8])
def test_block_equals_exact_with_few_full_distances(offset):
    rng = np.random.default_rng(3)
    q, t = rng.normal(offset, 1, (60, 48)), rng.normal(offset, 1, (900, 48))
    t[100:140] = t[100]  # ties
    ids = rng.permutation(900)
    rows, cols, d2, full = B.block_top(q, t, (q * q).sum(1), (t * t).sum(1), ids, 7)
    assert list(zip(rows.tolist(), cols.tolist(), d2.tolist(), strict=True)) == plain(q, t, 7, None, ids)
    if offset < 1e8:
        assert full <= 60 * 60  # of 54,000; at 1e8 norms say nothing and all are measured


def test_block_with_huge_values_and_few_points():
    q, t = np.array([[1e200, 0.0], [1.0, 2.0]]), np.array([[1e200, 1.0], [0.0, 0.0]])
    with np.errstate(over="ignore"):
        rows, cols, d2, _ = B.block_top(q, t, (q * q).sum(1), (t * t).sum(1), np.array([1, 2]), 1)
    assert list(zip(rows.tolist(), cols.tolist(), strict=True)) == [(0, 0), (1, 1)] and d2.tolist() == [1.0, 5.0]
    rows, *_ = B.block_top(q, t, (t * t).sum(1), (t * t).sum(1), np.array([1, 2]), 5, np.array([1, 9]))
    assert rows.tolist() == [0, 1, 1]


@pytest.mark.parametrize("block_rows", [50, 2_000])
def test_blocks_search_equals_exact(spark, monkeypatch, block_rows):
    monkeypatch.setattr(B, "QUERY_ROWS", 40)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 1, 30).round(1).tolist(), float(i % 3)) for i in range(400)] + [(1000, None, 0.0)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label double")
    index = build_index(df, centers="single", block_rows=block_rows)
    got = lambda nn: sorted(map(tuple, nn.select("q_id", "t_id", "label", "d2", "rank").collect()))
    q = df.where("id % 3 = 0")
    assert got(knn_join(q, index, 4, search="blocks")) == got(knn_join(q, index, 4, search="exact"))
    assert got(knn_self_join(index, 3, search="blocks")) == got(knn_self_join(index, 3, search="exact"))


def test_distance_from_norms_is_good_to_its_precision(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(0, 1, (200, 8))
    rows = [(i, (v * 1e5).tolist(), (v * 1e5 + rng.normal(0, 10.0 ** -(i % 12), 8)).tolist()) for i, v in enumerate(base)] + [(900, [1.0] * 8, [1.0] * 8)]
    df = spark.createDataFrame(rows, "id long, a array<double>, b array<double>").withColumns({"an": norm("a", 8), "bn": norm("b", 8)})
    for dim in (8, None):
        for precision in (1e-3, 1e-9):
            got = df.select(sqdist("a", "b").alias("d2"), fast_sqdist("a", "an", "b", "bn", dim, precision).alias("fast")).collect()
            assert all(abs(r.d2 - r.fast) <= precision * r.d2 for r in got)
    loose = df.select((F.abs(sqdist("a", "b") - fast_sqdist("a", "an", "b", "bn", 8, 1e-2)) > 0).alias("x")).where("x").count()
    assert loose > 0  # some do come from norms
    with pytest.raises(ValueError):
        fast_sqdist("a", "an", "b", "bn", 8, 0)


def test_equal_rows_of_a_self_join_are_searched_once(spark, monkeypatch):
    n = 600
    df = spark.range(n).select("id", F.when(F.col("id") < n // 3, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array((F.col("id") % 40).cast("double"), F.lit(0.0))).alias("features"), (F.col("id") % 2).cast("double").alias("label"))
    index = build_index(df, centers="kmeans", max_cells=4)
    seen = []
    join = S._grid_join
    monkeypatch.setattr(S, "_grid_join", lambda cand, ix, target=None: (seen.append(join(cand, ix, target).count()), join(cand, ix, target))[1])
    got = sorted(map(tuple, knn_self_join(index, 6).select("q_id", "t_id", "label", "d2", "rank").collect()))
    vecs = {r.id: r.features for r in df.collect()}
    ids = np.array(sorted(vecs))
    mat = np.array([vecs[i] for i in ids])
    want = sorted((int(ids[i]), int(ids[j]), float(ids[j] % 2), d2, r % 6 + 1) for r, (i, j, d2) in enumerate(plain(mat, mat, 6, ids, ids)))
    assert got == want
    assert sum(seen) <= 41 * 41 * 2  # pairs of distinct vectors, not of rows
