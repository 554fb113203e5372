"""Exact k-nearest-neighbour join over a :class:`CellIndex`.

Plan, per query batch (``search="pruned"``):

1. ``queries -> (q_id, q_vec)``, narrow.
2. In the same row, the distance ``dc`` from the query to every centre
   (cells are a bounded constant), each cell's bounds ``lb = dc - r`` and
   ``ub = dc + r``, and the query's bound ``U``: the least ``ub`` such that
   cells with ``ub <= U`` hold at least ``k`` points together. The ``k``-th
   neighbour is then no farther than ``U``, so only cells with ``lb <= U``
   can hold a neighbour. Still narrow: no join with the cell table, no
   shuffle.
3. One row per (query, kept cell, block of that cell), joined to the index
   points on ``(cell, block)``: a plain equi-join, hash-shuffled on both
   sides, with a bounded number of points per key. AQE splits keys that
   attract many queries.
4. Before the full distance, pairs failing ``|dc - t_dist| <= U`` (triangle
   inequality) are dropped.

``U`` is tightened first by a cheap phase that searches only each query's
best cell: the ``k``-th distance found there belongs to real points, so it
bounds the answer too and usually lets step 4 drop most pairs.
5. ``row_number() over (partition by q_id order by d2, t_id) <= k``:
   Catalyst plans a partial ``WindowGroupLimit`` ahead of the shuffle on
   ``q_id``, so at most ``k`` rows per query leave each task.

The bounds are sound, so pruning never changes the answer, and ties at the
``k``-th place go to the smallest target id, the same as brute force.
``search="exact"`` keeps every cell (brute force through the same blocked
join); ``search="blocks"`` is the same by matrix products with an exact recheck
(:mod:`vicinity.operators.blocks`), for wide vectors; ``search="single_cell"`` searches only the cell with the least
``ub``, an approximation that can miss neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vicinity.functions.vectors import (
    as_array,
    checked_width,
    double_sql,
    sqdist,
    sqdist_const_sql,
    sqdist_sql,
    usable,
    vector_sql,
)
from vicinity.operators.blocks import blocks_search
from vicinity.operators.cells import CellIndex, build_index, unrolled
from vicinity.operators.packs import NARROW, can_pack, packed_search, packed_self_search
from vicinity.operators.tree import TreeIndex, tree_search
from vicinity.plans.checks import bounded_collect
from vicinity.session import allow_group_limit, materialize

SEARCH_MODES = ("pruned", "exact", "single_cell", "blocks")
# Relative slack on the pruning bounds, far above double rounding error.
SLACK = 1e-9
# Rounding error of a distance, per dimension, relative to the distance
# itself (a few units in the last place): a bound computed from large
# distances is wrong by that much, however small the bound is.
ROUNDING = 16 * 2.0**-53
# The first search phase (best cell only) runs when some cell holds more
# points than this; with small cells the cell bounds are already local.
TWO_PHASE_MIN_CELL = 2048

KNN_SCHEMA = "q_id long, t_id long, label double, d2 double, rank int"


def _check(k: int, search: str, index: CellIndex) -> None:
    if not isinstance(k, int) or k < 1:
        raise ValueError(f"k must be a positive integer, got {k!r}")
    if search not in SEARCH_MODES:
        raise ValueError(f"search must be one of {SEARCH_MODES}, got {search!r}")
    if isinstance(index, TreeIndex) and search != "pruned":
        raise ValueError(f"a centre tree is searched pruned, got {search!r}")
    if search == "single_cell" and index.auto_single:
        raise ValueError('single_cell needs cells, and centers="auto" made one of all points; build the index with centers="kmeans" (or "single", to search everything)')


def prepare_queries(queries: DataFrame, id_col: str, features_col: str, dim: int) -> DataFrame:
    """``(q_id, q_vec)``; rows without a usable vector are left out (they get no neighbours)."""
    v = as_array(queries, features_col)
    if dim:
        v = checked_width(v, dim)
    return queries.select(F.col(id_col).alias("q_id"), v.alias("q_vec")).where(usable("q_vec"))


def cells_sql(index: CellIndex) -> str:
    """The cells as a constant ``array<struct<cell, center, radius, n, blocks>>`` in SQL text."""
    return "array(" + ", ".join(
        f"named_struct('cell', {c.cell}, 'center', {vector_sql(c.center)}, "
        f"'radius', {double_sql(c.radius)}, 'n', {int(c.n)}L, 'blocks', {int(c.blocks)})"
        for c in index.cells
    ) + ")"


def _rounding(dim: int) -> str:
    return double_sql(ROUNDING * (dim + 4))


def _bound_terms(index: CellIndex, kb: int) -> list[str]:
    """``dc_i + rho_i`` per cell holding at least ``kb`` points, ``rho_i`` its ``kb``-th smallest member distance."""
    near = index.near_distance(kb)
    return [
        f"(_dc[{i}] + {double_sql(near[c.cell])}) * (1D + {_rounding(index.dim)})"
        for i, c in enumerate(index.cells)
        if c.cell in near
    ]


def _with_bounds(q: DataFrame, index: CellIndex, kb: int, search: str, slack: float) -> DataFrame:
    """Append ``_u`` (bound on the k-th distance, null = none) and ``_keep`` (cells to search).

    Two sound bounds, the smaller wins:

    * near rule: a cell with at least ``kb`` points has ``kb`` of them within
      ``dc + rho`` of the query, ``rho`` being its ``kb``-th smallest member
      distance to the centre;
    * cumulative rule: the least ``ub = dc + radius`` such that cells with
      ``ub`` at most that hold ``kb`` points together. Only cells with ``ub``
      below the near bound can lower it, so only those are sorted.
    """
    dim = index.dim
    cells = index.cells
    if unrolled(len(cells), dim):
        dcs = ", ".join(f"sqrt({sqdist_const_sql('q_vec', c.center, dim)})" for c in cells)
        out = q.withColumn("_dc", F.expr(f"array({dcs})"))
        items = ", ".join(
            f"named_struct('ub', _dc[{i}] + {double_sql(c.radius)}, 'lb', _dc[{i}] - {double_sql(c.radius)}, "
            f"'dc', _dc[{i}], 'n', {int(c.n)}L, 'cell', {int(c.cell)}, 'blocks', {int(c.blocks)})"
            for i, c in enumerate(cells)
        )
        out = out.withColumn("_b", F.expr(f"array({items})"))
    else:
        dc = f"sqrt({sqdist_sql('q_vec', 'c.center', dim)})"
        out = q.withColumn("_dc", F.expr(f"transform({cells_sql(index)}, c -> {dc})"))
        out = out.withColumn(
            "_b",
            F.expr(
                f"transform({cells_sql(index)}, (c, i) -> named_struct("
                f"'ub', _dc[i] + c.radius, 'lb', _dc[i] - c.radius, 'dc', _dc[i], "
                f"'n', c.n, 'cell', c.cell, 'blocks', c.blocks))"
            ),
        )
    if search == "exact":
        return out.withColumn("_u", F.lit(None).cast("double")).withColumnRenamed("_b", "_keep").drop("_dc")
    if search == "single_cell":
        # The least upper bound among cells that can fill all places; a cell
        # with fewer points only where no cell can.
        best = (
            f"array_min(transform(_b, x -> named_struct('few', x.n < {int(kb)}, 'ub', x.ub, 'cell', x.cell, 'lb', x.lb, "
            "'dc', x.dc, 'n', x.n, 'blocks', x.blocks)))"
        )
        return out.withColumn("_u", F.lit(None).cast("double")).withColumn("_keep", F.expr(f"array({best})")).drop("_b", "_dc")

    terms = _bound_terms(index, kb)
    if "_u1" in q.columns:
        terms.append("_u1")
    near_bound = f"least({', '.join(terms)})" if len(terms) > 1 else (terms[0] if terms else "CAST(NULL AS DOUBLE)")
    out = out.withColumn("_un", F.expr(near_bound))
    cumulative = (
        "aggregate(array_sort(filter(_b, x -> _un IS NULL OR x.ub <= _un)), "
        "named_struct('cum', 0L, 'u', CAST(NULL AS DOUBLE)), "
        "(acc, x) -> named_struct('cum', acc.cum + x.n, 'u', "
        f"CASE WHEN acc.u IS NULL AND acc.cum + x.n >= {int(kb)} THEN x.ub ELSE acc.u END)).u"
    )
    out = out.withColumn("_u", F.expr(f"least({cumulative}, _un)"))
    keep = f"filter(_b, x -> _u IS NULL OR x.lb <= _u + {double_sql(slack)} * _u + {_rounding(dim)} * (x.dc + x.ub))"
    return out.withColumn("_keep", F.expr(keep)).drop("_b", "_dc", "_un")


def candidates(q: DataFrame, index: CellIndex, kb: int, search: str = "pruned", slack: float = SLACK) -> DataFrame:
    """``(q_id, q_vec, _u, dc, lb, ub, cell, blocks)``: one row per query and cell to search.

    A ``_u1`` column on ``q`` (a known bound per query) joins the bounds.
    """
    bounded = _with_bounds(q, index, kb, search, slack)
    # inline_outer, not inline: for a plain generator Catalyst infers a
    # ``size(_keep) > 0`` filter and pushes it below the projections,
    # inlining the whole bound computation into it.
    return bounded.select("q_id", "q_vec", "_u", F.inline_outer("_keep")).where(F.col("cell").isNotNull())

# Work bound per join key: candidate queries x points of one (cell, block)
# are split so that no key pairs more than about this many rows ...
TARGET_PAIRS = 4_000_000
# ... and, when the whole join is small, into about two keys per core, but
# not below this many pairs per key.
MIN_PAIRS_PER_KEY = 100_000
# Candidate rows are broadcast (the points then stream where they lie, no
# shuffle of the points) only when their counted size is under this many
# bytes; otherwise both sides are shuffled on the bounded grid keys.
BROADCAST_CANDIDATE_BYTES = 32 * 1024 * 1024


# From so many pairs of queries and points on, both sides meet as packed blocks
# (:mod:`vicinity.operators.packs`): the rows that the grid copies grow with the pairs.
PACKED_PAIRS = 50_000_000


def _grid_join(cand: DataFrame, index: CellIndex, target_pairs: int | None = None) -> DataFrame:
    """Join (query, cell) candidates with the points of that cell, split into bounded keys.

    Points are already split into hash blocks of at most about
    ``block_rows``. Queries are split per cell too: one small aggregate
    counts the candidate queries of each cell (at most ``max_cells`` rows,
    fetched under that bound), each cell gets ``qblocks`` so that a key holds
    at most about ``target_pairs`` pairs (fewer when the whole join is small,
    so that every core gets keys), query rows go to one ``qblock`` by
    hash and are repeated for every point block, point rows are repeated for
    every ``qblock``. Every key ``(cell, block, qblock)`` then has a bounded
    number of points and of queries, however many queries crowd one cell.

    The candidates are hash-partitioned on the key into a fixed number of
    partitions. AQE would otherwise merge partitions by their (small) input
    size although the join multiplies them into many pairs. The exchange
    also turns the bound columns into plain values before the join, so
    generated code cannot evaluate them once per pair.
    """
    spark = cand.sparkSession
    # Written once: the counts below and the join read the same rows, and
    # nothing upstream (bounds, a first search phase) runs twice.
    cand = materialize(cand, "knn-candidates")
    parallel = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    counts = {
        int(r["cell"]): int(r["n"])
        for r in bounded_collect(cand.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), len(index.cells), "candidates per cell")
    }
    by_cell = {c.cell: c for c in index.cells}
    n_cand = sum(counts.values())
    max_blocks = max((by_cell[cell].blocks for cell in counts), default=1)
    cand_bytes = n_cand * max_blocks * (8 * index.dim + 64)  # counted rows x block copies x row size
    if cand_bytes <= BROADCAST_CANDIDATE_BYTES:
        if max_blocks > 1:
            cand = cand.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        else:
            cand = cand.withColumn("block", F.lit(0))
        return F.broadcast(cand.drop("blocks")).join(index.points, ["cell", "block"])
    total = sum(nq * by_cell[cell].n for cell, nq in counts.items())
    target = min(target_pairs or TARGET_PAIRS, max(MIN_PAIRS_PER_KEY, total // (2 * parallel)))
    qblocks = {}
    for cell, nq in counts.items():
        c = by_cell[cell]
        per_block = -(-c.n // c.blocks)
        qblocks[cell] = max(1, -(-nq * per_block // target))
    keys = sum(by_cell[cell].blocks * qb for cell, qb in qblocks.items())

    def per_cell(mapping: dict) -> Column:
        if all(v == 1 for v in mapping.values()):
            return F.lit(1)
        return F.element_at(F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]), F.col("cell"))

    nqb = per_cell(qblocks)
    if all(v == 1 for v in qblocks.values()):
        cand = cand.withColumn("qblock", F.lit(0))
        pts = index.points.withColumn("qblock", F.lit(0))
    else:
        cand = cand.withColumn("qblock", F.pmod(F.xxhash64("q_id"), nqb.cast("long")).cast("int"))
        pts = index.points.withColumn(
            "qblock", F.explode(F.sequence(F.lit(0), F.coalesce(nqb, F.lit(1)) - 1))
        )
    if all(c.blocks == 1 for c in index.cells):
        cand = cand.withColumn("block", F.lit(0))
    else:
        cand = cand.withColumn("block", F.explode_outer(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cand = cand.drop("blocks")

    parts = max(1, min(keys, parallel))
    cand = cand.repartition(parts, "cell", "block", "qblock")
    if any(v > 1 for v in qblocks.values()):
        # Points are repeated per qblock by a generator whose size the static
        # planner does not multiply: no broadcast from that estimate. (AQE may
        # still choose one from the measured shuffle sizes.)
        pts = pts.hint("merge")
    return cand.join(pts, ["cell", "block", "qblock"])


def _search(
    q: DataFrame,
    index: CellIndex,
    places: int,
    kb: int,
    search: str,
    exclude_self: bool,
    keep_vectors: bool,
    slack: float,
    two_phase: bool = True,
    target_pairs: int | None = None,
) -> DataFrame:
    spark = q.sparkSession
    if isinstance(index, TreeIndex):
        return tree_search(q, index, places, kb, exclude_self, keep_vectors)
    cols = ["q_id", "t_id", "label", "d2", "rank"] + (["t_vec"] if keep_vectors else [])
    if not index.cells:
        schema = KNN_SCHEMA + (", t_vec array<double>" if keep_vectors else "")
        return spark.createDataFrame([], schema)

    if search == "blocks" and keep_vectors:
        raise ValueError('search="blocks" returns no vectors')
    n_queries = q.count() if not keep_vectors and can_pack(q, index) else 0
    packed = n_queries * index.n >= PACKED_PAIRS

    if search == "blocks" and not packed:
        return blocks_search(q, index, places, exclude_self).select(*cols)

    big_cells = max(c.n for c in index.cells) > TWO_PHASE_MIN_CELL
    if search == "pruned" and two_phase and big_cells and len(index.cells) > 1:
        # Phase 1: search each query's best cell only. When it yields all
        # ``places`` neighbours, the farthest of them bounds the final
        # answer (those points exist), usually far tighter than the cell bounds.
        first = _search(q, index, places, kb, "single_cell", exclude_self, False, slack, False, target_pairs)
        u1 = first.groupBy("q_id").agg(
            F.when(F.count(F.lit(1)) >= places, F.sqrt(F.max("d2"))).alias("_u1")
        )
        q = q.join(u1, "q_id", "left")

    if packed:
        mode = {"blocks": "exact"}.get(search, search)
        return packed_search(q, n_queries, index, places, kb, mode, exclude_self).select(*cols)

    cand = candidates(q, index, kb, search, slack).select("q_id", "q_vec", "_u", "dc", "cell", "blocks")
    pairs = _grid_join(cand, index, target_pairs)
    if search == "pruned":
        limit = F.col("_u") * (1 + slack)
        wrong = ROUNDING * (index.dim + 4) * (F.col("dc") + F.col("t_dist"))
        pairs = pairs.where(F.col("_u").isNull() | (F.abs(F.col("dc") - F.col("t_dist")) <= limit + wrong))
    if exclude_self:
        pairs = pairs.where(F.col("q_id") != F.col("t_id"))

    label = F.col("t_label") if index.has_label else F.lit(None).cast("double")
    scored = pairs.select(
        "q_id", "t_id", label.alias("label"),
        sqdist("q_vec", "t_vec", index.dim).alias("d2"),
        *(["_u"] if search == "pruned" else []),
        *(["t_vec"] if keep_vectors else []),
    )
    if search == "pruned":
        # Only what can be among the nearest is sorted.
        far = 1 + 2 * slack + 4 * ROUNDING * (index.dim + 4)
        scored = scored.where(F.col("_u").isNull() | (F.col("d2") <= F.col("_u") * F.col("_u") * far)).drop("_u")
    allow_group_limit(spark, places)
    w = Window.partitionBy("q_id").orderBy("d2", "t_id")
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= places)
    return ranked.select(*cols)


def knn_join(
    queries: DataFrame,
    index: CellIndex | TreeIndex,
    k: int,
    id_col: str = "id",
    features_col: str = "features",
    search: str = "pruned",
    keep_vectors: bool = False,
    slack: float = SLACK,
) -> DataFrame:
    """Each query's ``k`` nearest training points: ``(q_id, t_id, label, d2, rank)``.

    ``d2`` is the squared distance, ``rank`` runs 1..k from near to far, ties
    broken by ``t_id``. Queries with a null vector, or an empty index, give
    no rows; fewer than ``k`` training rows give fewer rows.
    """
    _check(k, search, index)
    q = prepare_queries(queries, id_col, features_col, index.dim)
    return _search(q, index, k, k, search, False, keep_vectors, slack)


def knn_self_join(
    index: CellIndex | TreeIndex,
    k: int,
    count_self: bool = False,
    search: str = "pruned",
    keep_vectors: bool = False,
    slack: float = SLACK,
) -> DataFrame:
    """k-NN of every training point among the training points.

    By default a point is not its own neighbour (``q_id <> t_id``, ``k``
    places). ``count_self=True`` takes ``k + 1`` places with the point
    allowed in its own list, the literal rule of the reference outlier search.
    """
    _check(k, search, index)
    if not count_self and search in ("pruned", "exact") and isinstance(index, CellIndex) and not keep_vectors and index.cells and index.n:
        return _self_join_of_values(index, k, search, slack)
    q = index.points.select(F.col("t_id").alias("q_id"), F.col("t_vec").alias("q_vec"))
    if count_self:
        return _search(q, index, k + 1, k + 1, search, False, keep_vectors, slack)
    return _search(q, index, k, k + 1, search, True, keep_vectors, slack)


def _among_themselves(index: CellIndex, places: int, search: str, exclude_self: bool, slack: float) -> DataFrame:
    """``_search`` of all points of the index in it."""
    q = index.points.select(F.col("t_id").alias("q_id"), F.col("t_vec").alias("q_vec"))
    kb = places + 1 if exclude_self else places
    if index.dim > NARROW and index.n * index.n >= PACKED_PAIRS and can_pack(q, index):
        return packed_self_search(index, places, kb, search, exclude_self)
    return _search(q, index, places, kb, search, exclude_self, False, slack)


def _self_join_of_values(index: CellIndex, k: int, search: str, slack: float) -> DataFrame:
    """The self-join by id, in which equal vectors are searched once and never joined all with all.

    Every distinct vector, with the ``k + 1`` smallest ids of its rows, finds
    itself and its ``k`` nearest other vectors (those before a vector that
    counts hold a row each, so no farther vector has a place). The ids of these
    are laid out by (distance, id) and the first ``k + 1`` kept: they serve
    all rows of the vector, each leaving out itself. Only then do the rows come
    back, ``k`` places each.
    """
    pts = index.points.select("t_id", "t_vec", *(["t_label"] if index.has_label else []))
    spark = pts.sparkSession
    sizes = pts.groupBy("t_vec").agg(F.count(F.lit(1)).alias("rows"), F.min("t_id").alias("id"))
    values = materialize(sizes, "self-values")
    same = values.where("rows > 1")
    if same.isEmpty():
        return _among_themselves(index, k, search, True, slack)
    allow_group_limit(spark, k + 1)
    by_value = Window.partitionBy("t_vec").orderBy("t_id")
    few = materialize(pts.withColumn("_r", F.row_number().over(by_value)).where(F.col("_r") <= k + 1).join(values.select("t_vec", "id"), "t_vec").drop("t_vec", "_r"), "self-ids")
    distinct = build_index(values.select("id", "t_vec"), "id", "t_vec", None, centers=[(c.cell, c.center) for c in index.cells], block_rows=index.block_rows)
    near = _among_themselves(distinct, k + 1, search, False, slack).select(F.col("q_id").alias("value"), F.col("t_id").alias("id"), "d2")
    laid = near.join(few, "id")
    first = laid.withColumn("_r", F.row_number().over(Window.partitionBy("value").orderBy("d2", "t_id"))).where(F.col("_r") <= k + 1)
    lists = first.groupBy("value").agg(F.array_sort(F.collect_list(F.struct("d2", "t_id", *(["t_label"] if index.has_label else [])))).alias("near"))
    rows = pts.select(F.col("t_id").alias("q_id"), "t_vec").join(values.select("t_vec", F.col("id").alias("value")), "t_vec").drop("t_vec")
    label = "x.t_label" if index.has_label else "CAST(NULL AS DOUBLE)"
    others = F.expr(f"transform(slice(filter(near, x -> x.t_id <> q_id), 1, {k}), (x, i) -> named_struct('t_id', x.t_id, 'label', {label}, 'd2', x.d2, 'rank', i + 1))")
    return rows.join(lists, "value").select("q_id", F.inline(others))


def candidate_cells(
    queries: DataFrame,
    index: CellIndex,
    k: int,
    id_col: str = "id",
    features_col: str = "features",
    search: str = "pruned",
    slack: float = SLACK,
) -> DataFrame:
    """``(q_id, cell, dc, lb, ub, bound)``: the cells a query's search visits."""
    _check(k, search, index)
    q = prepare_queries(queries, id_col, features_col, index.dim)
    if not index.cells:
        return q.sparkSession.createDataFrame([], "q_id long, cell int, dc double, lb double, ub double, bound double")
    return candidates(q, index, k, search, slack).select(
        "q_id", "cell", "dc", "lb", "ub", F.col("_u").alias("bound")
    )
