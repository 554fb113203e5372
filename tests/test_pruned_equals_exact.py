"""Pruned search equals brute force, for any cells, seeds and block sizes.

Brute force here is NumPy over the whole (small) table, with the same
tie rule (distance, then id).
"""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from vicinity import assemble, build_index, knn_join, knn_self_join, read_table


def brute(q_ids, q_vecs, t_ids, t_vecs, k, exclude_self=False):
    out = {}
    for qi, qv in zip(q_ids, q_vecs):
        d2 = ((t_vecs - qv) ** 2).sum(axis=1)
        order = np.lexsort((t_ids, d2))
        picked = [int(t_ids[j]) for j in order if not (exclude_self and t_ids[j] == qi)][:k]
        out[int(qi)] = picked
    return out


def as_lists(nn):
    got = {}
    for r in nn.orderBy("q_id", "rank").collect():
        got.setdefault(r.q_id, []).append(r.t_id)
    return got


def _part(spark):
    part = read_table(spark, SF_SMALL, "part")
    return assemble(part, ["p_size", F.col("p_retailprice") / 100], "features").select(
        F.col("p_partkey").alias("id"), "features", F.col("p_size").cast("double").alias("label")
    )


def _np(df):
    rows = df.orderBy("id").collect()
    return np.array([r.id for r in rows]), np.array([r.features for r in rows], dtype=float)


@pytest.mark.parametrize("max_cells,seed,block_rows", [(2, 1, 50_000), (7, 3, 17), (50, 5, 9)])
def test_part_join(spark, max_cells, seed, block_rows):
    df = _part(spark)
    q = df.where("id % 4 = 0")
    t = df.where("id % 4 <> 0")
    qi, qv = _np(q)
    ti, tv = _np(t)
    want = brute(qi, qv, ti, tv, 6)
    idx = build_index(t, max_cells=max_cells, seed=seed, block_rows=block_rows)
    for search in ("pruned", "exact"):
        assert as_lists(knn_join(q, idx, 6, search=search)) == want


@pytest.mark.parametrize("count_self", [False, True])
def test_part_self_join_with_ties(spark, count_self):
    # (p_size, length(p_type)) repeats a lot: many exact ties at distance 0
    part = read_table(spark, SF_SMALL, "part")
    df = assemble(part, ["p_size", F.length("p_type")], "features").select(F.col("p_partkey").alias("id"), "features")
    ids, vecs = _np(df)
    k = 4
    want = brute(ids, vecs, ids, vecs, k + 1 if count_self else k, exclude_self=not count_self)
    idx = build_index(df, label_col=None, max_cells=9, seed=2, block_rows=13)
    assert as_lists(knn_self_join(idx, k, count_self=count_self)) == want


def test_lineitem_four_wide(spark):
    li = read_table(spark, SF_SMALL, "lineitem")
    df = assemble(li, ["l_quantity", F.col("l_extendedprice") / 1000, F.col("l_discount") * 100, F.col("l_tax") * 100])
    df = df.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "features")
    df = df.dropDuplicates(["id"])
    q = df.where("id % 50 = 3")
    qi, qv = _np(q)
    ti, tv = _np(df)
    want = brute(qi, qv, ti, tv, 10)
    idx = build_index(df, label_col=None, seed=11, block_rows=500)
    assert as_lists(knn_join(q, idx, 10)) == want


@pytest.mark.parametrize("count_self", [False, True])
def test_grid_split_of_hot_cells(spark, monkeypatch, count_self):
    # a tiny pair budget forces many query blocks per cell, and small point
    # blocks many point blocks: every (cell, block, qblock) key is bounded
    from vicinity.operators import search as S

    monkeypatch.setattr(S, "TARGET_PAIRS", 50)
    monkeypatch.setattr(S, "BROADCAST_CANDIDATE_BYTES", 0)
    part = read_table(spark, SF_SMALL, "part")
    df = assemble(part, ["p_size", F.length("p_type")], "features").select(F.col("p_partkey").alias("id"), "features")
    ids, vecs = _np(df)
    k = 3
    want = brute(ids, vecs, ids, vecs, k + 1 if count_self else k, exclude_self=not count_self)
    idx = build_index(df, label_col=None, max_cells=3, seed=4, block_rows=20)
    for search in ("pruned", "exact"):
        assert as_lists(knn_self_join(idx, k, count_self=count_self, search=search)) == want


def test_broadcast_and_grid_paths_agree(spark, monkeypatch):
    # small counted candidates are broadcast; above the bound the grid is used
    from vicinity.operators import search as S

    df = _part(spark)
    q, t = df.where("id % 4 = 0"), df.where("id % 4 <> 0")
    idx = build_index(t, max_cells=7, seed=3, block_rows=40)
    broadcast = as_lists(knn_join(q, idx, 5))
    monkeypatch.setattr(S, "BROADCAST_CANDIDATE_BYTES", 0)
    assert as_lists(knn_join(q, idx, 5)) == broadcast
    qi, qv = _np(q)
    ti, tv = _np(t)
    assert broadcast == brute(qi, qv, ti, tv, 5)
