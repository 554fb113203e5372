"""Centre tree: an index whose cells grow with the data, searched ring by ring.

``n`` points get about ``sqrt(n / 2)`` cells (no cap), in about ``sqrt(cells)``
groups. Group centres come from k-means, the centres of a group's cells from a few
Lloyd rounds (grouped averages) over that group's part of a sample of ``SAMPLE_PER_CELL`` points a cell.
Centres only steer the search. Every point is
assigned: to its nearest group centre, then to the nearest cell of that group. So
a point is measured against ``sqrt(cells)`` centres twice, not against all cells.

A cell's points are cut into rings by their distance to its centre, at
quantiles, about ``RING_ROWS`` points each; a ring with more (many points at one
distance) is split by hash. The join key of the search is ``(cell, ring, sub)``.

Cells and rings are a table, a row for each group, and only the group centres
(about ``n ** 0.25`` of them) are ever on the driver or in a plan. The table goes
to the tasks if its counted size allows; otherwise it is joined on the group.

Search, exact, in the query's own rows until the join:

1. Distances to the group centres; in the nearest group, the bound
   ``U = min(dc + hi)`` over its cells, ``hi`` being the far edge of the
   ring that completes ``k`` points.
2. Of the best cell, the rings nearest to the query's own distance are searched, up to some
   hundred points; the k-th distance found lowers ``U``. What is measured here does not grow with the cells.
3. Groups with ``dc - radius <= U``, within them cells with ``dc - radius <= U``,
   within them rings that meet ``[dc - U, dc + U]`` (triangle inequality): one candidate row for each.
4. Equi-join with the points on ``(cell, ring, sub)``, both sides bounded per key; per pair
   first ``|dc - t_dist| <= U`` and ``||q| - |t|| <= U`` from stored norms, then
   the distance, then the top k.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vicinity.functions.vectors import checked_width, double_sql, sqdist, sqdist_sql, sqnorm, vector_sql
from vicinity.operators.cells import DEFAULT_BLOCK_ROWS, DEFAULT_SEED, POINTS_PER_FILE, assign_batches, fit_centers, prepare_points
from vicinity.plans.checks import bounded_collect
from vicinity.session import allow_group_limit, materialize

SAMPLE_PER_CELL = 40
LLOYD_ROUNDS = 2
RING_ROWS = 256
#: Rings of a cell at most; a ring of many points has several subs.
MAX_RINGS = 32
#: Points whose distances give a query its first bound.
FIRST_POINTS = 512
SLACK = 1e-9
ROUNDING = 16 * 2.0**-53
#: The table of cells, and candidates, are broadcast up to this many counted bytes.
BROADCAST_BYTES = 32 << 20
#: Cells of up to this many bytes go to Arrow batches, so many distances at once.
BATCH_BYTES = 8 << 20
BATCH_PAIRS = 1_000_000
#: Queries of a key that meet its points in one task.
QUERIES_PER_KEY = 2_000


@dataclass
class TreeIndex:
    """``points(t_id, [t_label], t_vec, t_norm, cell, ring, sub, t_dist)``; ``table(group, cells)``; group centres on the driver."""

    points: DataFrame
    table: DataFrame
    groups: list[tuple[int, tuple, float, int]]  # group, centre, radius, points
    dim: int
    n: int
    n_cells: int
    has_label: bool
    auto_single: bool = False

    @property
    def cells(self) -> list:
        """The groups: empty for an index without points, as in :class:`CellIndex`."""
        return self.groups


def tree_cell_count(n: int) -> int:
    """``sqrt(n / 2)`` cells, at least 2."""
    return max(2, math.isqrt(max(n, 0) // 2))


def _small(df: DataFrame, row_bytes: float) -> DataFrame:
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def _by_group(cells: DataFrame) -> DataFrame:
    """One row a group, with its cells ``(cell, center)``."""
    return cells.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("cell", "center"))).alias("cells"))


def _nearest_cell(points: DataFrame, by_group: DataFrame, dim: int, n_cells: int) -> DataFrame:
    """``points`` (with ``group``) and ``cell``, ``t_dist``: the nearest cell of the group; the smallest wins ties."""
    if n_cells * (8 * dim + 32) <= min(BROADCAST_BYTES, BATCH_BYTES):
        return _nearest_in_batches(points, by_group, dim, n_cells)
    d2 = sqdist_sql("t_vec", "c.center", dim)
    near = F.expr(f"array_min(transform(cells, c -> named_struct('d2', {d2}, 'cell', c.cell)))")
    groups = F.broadcast(by_group) if n_cells * (8 * dim + 32) <= BROADCAST_BYTES else by_group
    return points.join(groups, "group").withColumn("_n", near).select(*points.columns, F.col("_n.cell").alias("cell"), F.sqrt("_n.d2").alias("t_dist"))


def _nearest_in_batches(points: DataFrame, by_group: DataFrame, dim: int, n_cells: int) -> DataFrame:
    """:func:`_nearest_cell` over Arrow batches: an expression over a cell list is interpreted cell by cell.

    Terms are added in index order, so the distances are the same to the last bit.
    """
    rows = bounded_collect(by_group, n_cells + 1, "groups of cells")
    lists = {int(r["group"]): ([c["cell"] for c in r["cells"]], [list(c["center"]) for c in r["cells"]]) for r in rows}
    cell_type = by_group.schema["cells"].dataType.elementType["cell"].dataType
    schema = T.StructType([*points.schema.fields, T.StructField("cell", cell_type), T.StructField("t_dist", T.DoubleType())])
    narrow = isinstance(cell_type, T.IntegerType)
    at_vec, at_group = points.columns.index("t_vec"), points.columns.index("group")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        cells = {g: (np.array(ids, "i8"), np.array(centers, "f8")) for g, (ids, centers) in lists.items()}
        for batch in batches:
            n = batch.num_rows
            vec = batch.column(at_vec).flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
            group = batch.column(at_group).to_numpy(zero_copy_only=False)
            best, cell, known = np.zeros(n), np.zeros(n, "i8"), np.zeros(n, bool)
            with np.errstate(over="ignore", invalid="ignore"):
                for g in np.unique(group):
                    if g not in cells:
                        continue
                    ids, centers = cells[g]
                    mine = np.flatnonzero(group == g)
                    step = max(1, BATCH_PAIRS // len(ids))
                    for some in (mine[i : i + step] for i in range(0, len(mine), step)):
                        d2 = np.zeros((len(some), len(ids)))
                        for i in range(dim):
                            x = vec[some, i][:, None] - centers[:, i][None, :]
                            d2 += x * x
                        near = d2.argmin(1)  # the first of equals: cells ascend
                        best[some], cell[some], known[some] = d2[np.arange(len(some)), near], ids[near], True
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32() if narrow else pa.int64()), pa.array(np.sqrt(best))], schema.names)
            yield out if known.all() else out.filter(pa.array(known))

    return points.mapInArrow(run, schema)


def _fit(pts: DataFrame, n: int, dim: int, cells: int, seed: int) -> tuple[list[tuple[int, tuple]], DataFrame]:
    """Group centres, and the table ``(cell, group, center)``, fitted on a sample of the points."""
    share = min(1.0, SAMPLE_PER_CELL * cells / n)
    spread = 1 << 30
    sample = pts.select("t_id", "t_vec").where(F.pmod(F.xxhash64("t_id", F.lit(seed)), F.lit(spread)) < int(share * spread) + 1)
    sample = materialize(sample, "tree-sample")
    if sample.isEmpty():
        sample = pts.select("t_id", "t_vec")
    groups = fit_centers(sample, max(1, math.isqrt(cells)) if cells > 3 else 1, seed=seed, max_iter=10) if cells > 3 else [(0, tuple([0.0] * dim))]
    if any(x != x for _, c in groups for x in c):
        groups = [(0, tuple([0.0] * dim))]
    grouped = materialize(assign_batches(sample, groups, dim, "t_vec").withColumnRenamed("cell", "group").drop("t_dist"), "tree-groups")
    # Seeds: of each group as many distinct points as its share of the cells.
    sizes = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("_n")).withColumn("_c", F.ceil(F.col("_n") * F.lit(cells) / F.sum("_n").over(Window.partitionBy())))
    order = Window.partitionBy("group").orderBy(F.xxhash64("t_vec"))
    seeds = grouped.select("group", "t_vec").distinct().withColumn("_r", F.row_number().over(order)).join(F.broadcast(sizes), "group").where("_r <= _c")
    per_group = cells + len(groups) + 1
    centers = materialize(seeds.select((F.col("group").cast("long") * per_group + F.col("_r")).alias("cell"), "group", F.col("t_vec").alias("center")), "tree-cells")
    for _ in range(LLOYD_ROUNDS):
        near = _nearest_cell(grouped, _by_group(centers), dim, cells)
        mean = near.groupBy("group", "cell").agg(*[F.avg(F.col("t_vec")[i]).alias(f"c{i}") for i in range(dim)])
        centers = materialize(mean.select("cell", "group", F.array(*[F.col(f"c{i}") for i in range(dim)]).alias("center")), "tree-cells")
    # A group that no point of the sample is nearest to has no cells.
    real = {int(r["group"]) for r in bounded_collect(centers.select("group").distinct(), len(groups), "groups")}
    return [g for g in groups if g[0] in real], centers


def build_tree_index(
    df: DataFrame, id_col: str = "id", features_col: str = "features", label_col: str | None = "label",
    seed: int = DEFAULT_SEED, block_rows: int = DEFAULT_BLOCK_ROWS, n_cells: int | None = None,
) -> TreeIndex:
    """The tree over all usable points; ``n_cells`` overrides the ``sqrt(n / 2)`` rule."""
    pts, n, dim = prepare_points(df, id_col, features_col, label_col)
    has_label = label_col is not None
    if n == 0:
        return TreeIndex(pts, pts, [], 0, 0, 0, has_label)
    pts = pts.withColumn("t_vec", checked_width(F.col("t_vec"), dim))
    cells = n_cells or tree_cell_count(n)
    groups, centers = _fit(pts, n, dim, cells, seed)
    files = max(df.sparkSession.sparkContext.defaultParallelism, -(-n // POINTS_PER_FILE))
    grouped = assign_batches(pts, groups, dim, "t_vec").withColumnsRenamed({"cell": "group", "t_dist": "g_dist"})
    assigned = _nearest_cell(grouped, _by_group(centers), dim, cells)
    # Points that lie in enough files stay where they are.
    if len(df.inputFiles()) < files:
        assigned = assigned.repartition(files, "t_id")
    assigned = materialize(assigned, "tree-points", "zstd")

    # Ring edges of a cell: every so many of its quantiles.
    stats = assigned.groupBy("group", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("t_dist").alias("radius"),
        F.percentile_approx("t_dist", [i / MAX_RINGS for i in range(1, MAX_RINGS)]).alias("q"),
    )
    rings = f"least({MAX_RINGS}, greatest(1, cast(ceil(n / {RING_ROWS}) as int)))"
    edges = F.expr(f"CASE WHEN {rings} = 1 THEN CAST(array() AS ARRAY<DOUBLE>) ELSE array_distinct(transform(sequence(1, {rings} - 1), i -> q[(i * {MAX_RINGS}) div {rings} - 1])) END")
    stats = materialize(stats.select("group", "cell", "n", "radius", edges.alias("edges")), "tree-stats")
    ring = F.expr("size(filter(edges, e -> e < t_dist))")
    ringed = assigned.join(_small(stats.select("cell", "edges"), 8 * MAX_RINGS + 32), "cell").withColumn("ring", ring).drop("edges")
    subs = F.ceil(F.count(F.lit(1)) / block_rows).cast("int")
    by_ring = ringed.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("t_dist").alias("lo"), F.max("t_dist").alias("hi"), subs.alias("subs"))
    by_cell = by_ring.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("ring", "n", "lo", "hi", "subs"))).alias("rings"))
    full = stats.select("group", "cell", "n", "radius").join(by_cell, "cell").join(centers.select("cell", "center"), "cell")
    table = full.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("cell", "center", "radius", "n", "rings"))).alias("cells"))
    table = materialize(table, "tree-table")
    where = stats.select("cell", "edges").join(by_cell.select("cell", F.expr("map_from_entries(transform(rings, r -> struct(r.ring, r.subs)))").alias("subs")), "cell")
    where = materialize(where, "tree-rings")
    points = assigned.join(_small(where, 24 * MAX_RINGS + 32), "cell").withColumn("ring", ring)
    points = points.withColumn("sub", F.pmod(F.xxhash64("t_id"), F.element_at("subs", F.col("ring")).cast("long")).cast("int")).drop("edges", "subs", "group", "g_dist")
    points = points.withColumn("t_norm", F.sqrt(sqnorm("t_vec", dim)))
    sizes = bounded_collect(assigned.groupBy("group").agg(F.max("g_dist").alias("radius"), F.count(F.lit(1)).alias("n")), max(len(groups), 1), "groups")
    by_id = dict(groups)
    kept = [(int(r["group"]), by_id[int(r["group"])], float(r["radius"]), int(r["n"])) for r in sizes]
    return TreeIndex(points, table, sorted(kept), dim, n, cells, has_label)


def _table(index: TreeIndex) -> DataFrame:
    size = index.n_cells * (8 * index.dim + 64) + (index.n // RING_ROWS + index.n_cells) * 40
    return F.broadcast(index.table) if size <= BROADCAST_BYTES else index.table


def _wrong(dim: int) -> str:
    return double_sql(ROUNDING * (dim + 4))


def _groups_sql(index: TreeIndex) -> str:
    """``array<struct<dg, group, radius, n>>``: the query's distance to the centre of every group."""
    const = "array(" + ", ".join(f"named_struct('group', {g}, 'center', {vector_sql(c)}, 'radius', {double_sql(r)}, 'n', {n}L)" for g, c, r, n in index.groups) + ")"
    dg = f"sqrt({sqdist_sql('q_vec', 'g.center', index.dim)})"
    return f"transform({const}, g -> named_struct('dg', {dg}, 'group', g.group, 'radius', g.radius, 'n', g.n))"


def _with_cells(rows: DataFrame, index: TreeIndex) -> DataFrame:
    """``rows`` (with ``group``) and ``_b``: the group's cells with ``dc``, the query's distance to the centre."""
    dc = f"sqrt({sqdist_sql('q_vec', 'c.center', index.dim)})"
    cells = f"transform(cells, c -> named_struct('cell', c.cell, 'dc', {dc}, 'radius', c.radius, 'n', c.n, 'rings', c.rings))"
    return rows.join(_table(index), "group").withColumn("_b", F.expr(cells)).drop("cells")


def _rings(rows: DataFrame, dim: int) -> DataFrame:
    """One row for each ring of ``_b`` that may hold a point within ``_u`` (null: any)."""
    cell = rows.select("q_id", "q_vec", "_u", F.explode("_b").alias("c"))
    cell = cell.select("q_id", "q_vec", "_u", "c.cell", "c.dc", F.inline_outer("c.rings"))
    reach = f"_u * (1D + {double_sql(SLACK)}) + {_wrong(dim)} * (dc + hi)"
    return cell.where(f"subs IS NOT NULL AND (_u IS NULL OR (hi >= dc - ({reach}) AND lo <= dc + ({reach})))").drop("lo", "hi")


def _pairs(cand: DataFrame, index: TreeIndex) -> DataFrame:
    """Candidates ``(q_id, q_vec, _u, cell, dc, ring, n, subs)`` joined with the points of their rings."""
    cand = materialize(cand, "tree-candidates")
    parts = cand.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).drop("subs", "n")
    keys = ["cell", "ring", "sub"]
    counted = cand.agg(F.sum("subs").alias("rows")).first()["rows"] or 0
    if counted * (8 * index.dim + 64) <= BROADCAST_BYTES:
        return F.broadcast(parts).join(index.points, keys)
    # A key that many queries ask is split: its points are copied once per block of queries.
    heat = materialize(cand.groupBy("cell", "ring").agg(F.ceil(F.count(F.lit(1)) / QUERIES_PER_KEY).alias("qblocks")).where("qblocks > 1"), "tree-heat")
    heat = _small(heat, 24)
    qb = F.coalesce("qblocks", F.lit(1).cast("long"))
    parts = parts.join(heat, ["cell", "ring"], "left").withColumn("qblock", F.pmod(F.xxhash64("q_id"), qb)).drop("qblocks")
    points = index.points.join(heat, ["cell", "ring"], "left").withColumn("qblock", F.explode(F.sequence(F.lit(0).cast("long"), qb - 1))).drop("qblocks")
    spark = cand.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return parts.repartition(n, *keys, "qblock").join(points.hint("merge"), [*keys, "qblock"])


def near_pairs(cand: DataFrame, index: TreeIndex) -> DataFrame:
    """The pairs that are measured: those that pass the tests on stored distances and norms."""
    pairs = _pairs(cand, index)
    wrong = ROUNDING * (index.dim + 4)
    reach = F.col("_u") * (1 + SLACK)
    by_center = F.abs(F.col("dc") - F.col("t_dist")) <= reach + wrong * (F.col("dc") + F.col("t_dist"))
    pairs = pairs.withColumn("_qn", F.sqrt(sqnorm("q_vec", index.dim)))
    by_norm = F.abs(F.col("_qn") - F.col("t_norm")) <= reach + wrong * (F.col("_qn") + F.col("t_norm"))
    return pairs.where(F.col("_u").isNull() | (by_center & by_norm)).drop("_qn")


def _nearest(cand: DataFrame, index: TreeIndex, places: int, exclude_self: bool, keep_vectors: bool) -> DataFrame:
    pairs = near_pairs(cand, index)
    if exclude_self:
        pairs = pairs.where(F.col("q_id") != F.col("t_id"))
    label: Column = F.col("t_label") if index.has_label else F.lit(None).cast("double")
    vectors = ["t_vec"] if keep_vectors else []
    scored = pairs.select("q_id", "t_id", label.alias("label"), sqdist("q_vec", "t_vec", index.dim).alias("d2"), "_u", *vectors)
    far = 1 + 2 * SLACK + 4 * ROUNDING * (index.dim + 4)
    scored = scored.where(F.col("_u").isNull() | (F.col("d2") <= F.col("_u") * F.col("_u") * far)).drop("_u")
    allow_group_limit(cand.sparkSession, places)
    w = Window.partitionBy("q_id").orderBy("d2", "t_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= places).select("q_id", "t_id", "label", "d2", "rank", *vectors)


def _first_rings(rows: DataFrame, kb: int) -> DataFrame:
    """``rows`` with ``_b``: of the cell ``_cell`` the rings nearest to the query's distance ``_dc``, that hold ``kb`` and ``FIRST_POINTS`` points.

    Any ``kb`` points bound the answer. Of a ring of many points one part is enough. One expression: columns
    of it would be put into its lambdas, and worked out for every ring.
    """
    gap = "greatest(0D, r.lo - _dc, _dc - r.hi)"
    upto = (
        f"aggregate(array_sort(transform(c.rings, r -> named_struct('gap', {gap}, 'n', r.n))), named_struct('n', 0L, 'gap', CAST(NULL AS DOUBLE)), "
        f"(a, x) -> named_struct('n', a.n + x.n, 'gap', IF(a.gap IS NULL AND a.n + x.n >= least(c.n, {max(kb, FIRST_POINTS)}L), x.gap, a.gap))).gap"
    )
    cell = f"transform(filter(cells, c -> c.cell = _cell), c -> named_struct('rings', c.rings, 'gap', {upto}))"
    part = f"IF(r.n div r.subs >= {4 * kb}, 1, r.subs)"
    rings = f"transform(filter(c.rings, r -> c.gap IS NULL OR {gap} <= c.gap), r -> named_struct('ring', r.ring, 'n', r.n, 'lo', r.lo, 'hi', r.hi, 'subs', {part}))"
    return rows.withColumn("_b", F.expr(f"transform({cell}, c -> named_struct('cell', _cell, 'dc', _dc, 'rings', {rings}))")).drop("cells")


def tree_candidates(q: DataFrame, index: TreeIndex, places: int, kb: int, exclude_self: bool) -> DataFrame:
    """``(q_id, q_vec, _u, cell, dc, ring, n, subs)``: the rings that each query's search visits."""
    dim, wrong = index.dim, _wrong(index.dim)
    # Distances to groups and cells are worked out again where they are needed: written, they grow with the groups and rings.
    rows = q.withColumn("_g", F.expr(_groups_sql(index)))
    # The group itself bounds the answer if it holds enough points; a cell of it, by its rings, far better.
    whole = F.expr(f"array_min(transform(filter(_g, g -> g.n >= {kb}), g -> (g.dg + g.radius) * (1D + {wrong})))")
    rows = materialize(rows.withColumn("_whole", whole).withColumn("group", F.expr("array_min(_g).group")).drop("_g"), "tree-queries")
    spark = q.sparkSession
    # Few bytes, much work for each row.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    first = _with_cells(rows.repartition(parts).select("q_id", "q_vec", "group", "_whole"), index)
    filled = f"aggregate(c.rings, named_struct('n', 0L, 'hi', CAST(NULL AS DOUBLE)), (a, r) -> named_struct('n', a.n + r.n, 'hi', IF(a.hi IS NULL AND a.n + r.n >= {kb}, r.hi, a.hi))).hi"
    tried = F.expr(f"array_min(filter(transform(_b, c -> named_struct('u', (c.dc + {filled}) * (1D + {wrong}), 'cell', c.cell, 'dc', c.dc)), x -> x.u IS NOT NULL))")
    first = first.withColumn("_t", tried).withColumn("_u", F.least("_whole", "_t.u"))
    bound = materialize(first.select("q_id", "q_vec", "_u", "group", F.col("_t.cell").alias("_cell"), F.col("_t.dc").alias("_dc")), "tree-bounds")
    best = bound.where("_cell IS NOT NULL").repartition(parts).join(_table(index), "group")
    near = _nearest(_rings(_first_rings(best, kb), dim), index, places, exclude_self, False)
    found = near.groupBy("q_id").agg(F.when(F.count(F.lit(1)) >= places, F.sqrt(F.max("d2"))).alias("_u1"))
    known = bound.select("q_id", "_u").join(found, "q_id", "left").select("q_id", F.least("_u", "_u1").alias("_u"))
    rows = rows.select("q_id", "q_vec").join(known, "q_id").repartition(parts).withColumn("_g", F.expr(_groups_sql(index)))
    reach = f"_u * (1D + {double_sql(SLACK)})"
    kept = F.expr(f"transform(filter(_g, g -> _u IS NULL OR g.dg - g.radius <= {reach} + {wrong} * (g.dg + g.radius)), g -> g.group)")
    rows = rows.select("q_id", "q_vec", "_u", F.explode(kept).alias("group"))
    cells = _with_cells(rows, index).withColumn("_b", F.expr(f"filter(_b, c -> _u IS NULL OR c.dc - c.radius <= {reach} + {wrong} * (c.dc + c.radius))"))
    return _rings(cells, dim)


def tree_search(q: DataFrame, index: TreeIndex, places: int, kb: int, exclude_self: bool, keep_vectors: bool) -> DataFrame:
    """``(q_id, t_id, label, d2, rank)`` of the queries ``(q_id, q_vec)``; ``kb`` points must lie within the bound."""
    if not index.groups:
        schema = "q_id long, t_id long, label double, d2 double, rank int" + (", t_vec array<double>" if keep_vectors else "")
        return q.sparkSession.createDataFrame([], schema)
    return _nearest(tree_candidates(q, index, places, kb, exclude_self), index, places, exclude_self, keep_vectors)
