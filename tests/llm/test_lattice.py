import itertools

import numpy as np
import pytest

from vicinity.llm import lattice as L
from vicinity.sources.points import read_table


def brute(x):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    parent = list(range(len(x)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in zip(*np.nonzero(near), strict=True):
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return near.sum(axis=1), np.array([root(i) for i in range(len(x))])


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")


def compare(spark, x, recall):
    x = x.astype(np.float32).astype(np.float64)
    got = sorted(L.link_vectors(frame(spark, x)).collect(), key=lambda r: r.id)
    links, comp = brute(x)
    mine = np.array([r.n_links for r in got])
    assert (mine <= links).all() and mine.sum() >= recall * links.sum()
    return got, comp


def test_nearest_lattice_point():
    x = np.random.default_rng(0).uniform(-2, 2, (300, 8))
    p = L.nearest_e8(x)
    assert (((2 * p) % 2).sum(axis=1) % 8 == 0).all() and (p.sum(axis=1) % 2 == 0).all()
    # No neighbour by a minimal vector is nearer.
    assert ((x - p) ** 2).sum(axis=1).max() <= 1 + 1e-9
    assert (((x - p)[:, None, :] - L.MINIMAL) ** 2).sum(axis=2).min(axis=1).min() >= 0
    assert ((((x - p)[:, None, :] - L.MINIMAL) ** 2).sum(axis=2).min(axis=1) >= ((x - p) ** 2).sum(axis=1) - 1e-9).all()
    assert len(L.MINIMAL) == 240 and all(abs((v * v).sum() - 2) < 1e-12 for v in L.MINIMAL)


def test_spread_groups_reach_recall(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((25, 64))
    noise = rng.uniform(0.1, 0.5, 25)
    x = np.concatenate([np.repeat(base, 20, 0) + rng.standard_normal((500, 64)) * np.repeat(noise, 20)[:, None], rng.standard_normal((150, 64))])
    got, comp = compare(spark, x, 0.95)
    assert np.mean([r.component_id == c for r, c in zip(got, comp, strict=True)]) > 0.97


def test_one_hot_group_beyond_a_block(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal(64) + 0.15 * rng.standard_normal((600, 64)), np.repeat(rng.standard_normal((1, 64)), 300, 0), rng.standard_normal((50, 64))])
    got, comp = compare(spark, x, 0.999)
    assert [r.component_id for r in got] == comp.tolist()
    assert all(r.kept == (r.id == r.component_id) for r in got)


def test_bad_vectors_link_with_nothing(spark):
    one = [1.0, 2.0, 3.0]
    bad = [None, [], [0.0, 0.0, 0.0], [1.0, None, 3.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0]]
    got = {r.id: r for r in L.link_vectors(frame(spark, [*bad, one, one, [2.0, 4.0, 6.0], [1.0, 2.0], [1e-30, 2e-30, 3e-30], [1e30, 2e30, 3e30]])).collect()}
    for i in range(len(bad)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert [got[i].n_links for i in (6, 7, 8, 10, 11)] == [4] * 5 and {got[i].component_id for i in (6, 7, 8, 10, 11)} == {6}
    assert got[9].n_links == 0


def test_ids_null_and_repeated_and_empty(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(((r.id, r.n_links, r.component_id) for r in L.link_vectors(df).collect()), key=str)
    assert got == sorted([(None, 2, 5), (5, 2, 5), (5, 2, 5), (None, 0, None)], key=str)
    assert L.link_vectors(spark.createDataFrame([], df.schema)).collect() == []


def test_threshold_is_exact(spark):
    rows = []
    for k, cos in enumerate([0.8999999, 0.9000001, 0.95, 0.85]):
        a = np.zeros(8)
        a[2 * (k % 4)] = 1
        b = np.zeros(8)
        b[2 * (k % 4)], b[2 * (k % 4) + 1] = cos, np.sqrt(1 - cos * cos)
        rows += [a, b]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r.id: r.n_links for r in L.link_vectors(df).collect()}
    assert got[0] == got[1] == got[6] == got[7] == 0 and set(got[i] for i in (4, 5)) == {1}
    assert got[2] == got[3] and got[2] <= 1


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_embeddings_equal_brute_force(spark, sf):
    rows = read_table(spark, sf, "embeddings").orderBy("vec_id").collect()
    links, comp = brute(np.array([r.embedding for r in rows], float))
    got = sorted(L.link_vectors(read_table(spark, sf, "embeddings")).collect(), key=lambda r: r.id)
    assert [r.n_links for r in got] == links.tolist()
    assert [r.component_id for r in got] == [rows[c].vec_id for c in comp]


def test_neighbouring_cells_add_recall():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((400, 64))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * z / np.linalg.norm(z, axis=1, keepdims=True)
    (ox, px), (oy, py) = L.cells(x), L.cells(y)
    own = (ox == oy).any(axis=1).mean()
    probed = np.mean([bool(set(ox[i]) & {*oy[i], *py[i]} or set(oy[i]) & set(px[i])) for i in range(400)])
    assert probed > 0.95 and probed > own
    assert len(set(itertools.chain(*ox.tolist()))) > 100
