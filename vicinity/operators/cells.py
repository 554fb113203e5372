"""Cells: k-means (or given) centres, nearest-centre assignment, per-cell
stats, and the blocked point table that k-NN search joins against.

Data flow (all DataFrame steps; only the centres and the per-cell stats,
each at most ``max_cells`` rows, reach the driver):

    points --(nearest centre, narrow)--> assigned(t_id, t_label, t_vec, cell, t_dist)
    assigned --groupBy(cell)--> stats(cell, n, radius)          [partial + final agg]
    assigned --(block = hash(t_id) mod blocks[cell], narrow)--> index points

A cell is split into ``ceil(n / block_rows)`` hash blocks, so the search
join key ``(cell, block)`` has a bounded number of points on its build side
however lopsided the cells are, and the number of join keys grows with the
data instead of being stuck at the cell count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vicinity.functions.vectors import (
    MAX_UNROLLED_WIDTH,
    as_array,
    checked_width,
    sqdist_const_sql,
    sqdist_sql,
    usable,
    vector_sql,
)
from vicinity.plans.checks import bounded_collect, check_literal_size
from vicinity.session import allow_group_limit, materialize

DEFAULT_MAX_CELLS = 50
# Points per join block. The grid of the join is square: as many queries as
# points per key, so neither side is copied more often than the other.
DEFAULT_BLOCK_ROWS = 2_000
DEFAULT_SEED = 17
MAX_CELLS_LIMIT = 100_000
# Above this many unrolled terms (cells x width) distances to centres are
# folded with higher-order functions instead of written out: whole-stage
# codegen inlines a projection into one Java method, and past roughly this
# size that method no longer compiles (Spark then falls back to slower code).
MAX_UNROLLED_TERMS = 480
# centers="auto" fits k-means cells up to this width and uses one cell (brute
# force through the same blocked join) above it: in many dimensions the
# triangle-inequality bounds of k-means cells rarely exclude a cell.
AUTO_PRUNE_MAX_DIM = 16
# Rows per file of the written index.
POINTS_PER_FILE = 1_000_000


def cell_count(n: int, cap: int = DEFAULT_MAX_CELLS) -> int:
    """Number of k-means cells for ``n`` training rows.

    ``min(cap, floor(sqrt(n // 2)))``, and 2 when that is 1 or less.
    """
    if cap < 2:
        raise ValueError("cap must be at least 2")
    c = min(cap, math.isqrt(max(n, 0) // 2))
    return c if c > 1 else 2


def cell_count_col(n: Column, cap: int = DEFAULT_MAX_CELLS) -> Column:
    """:func:`cell_count` as a column expression over a row count."""
    return F.greatest(F.lit(2), F.least(F.lit(cap), F.floor(F.sqrt(F.floor(n / 2))))).cast("int")


@dataclass(frozen=True)
class Cell:
    cell: int
    center: tuple
    radius: float  # largest member distance, not squared
    n: int
    blocks: int


@dataclass
class CellIndex:
    """Cells on the driver (bounded) and the blocked point table (distributed).

    ``points`` has columns ``t_id, t_label (optional), t_vec, cell, block, t_dist``.
    """

    cells: list[Cell]
    points: DataFrame
    dim: int
    n: int
    has_label: bool
    block_rows: int = DEFAULT_BLOCK_ROWS
    near: dict = field(default_factory=dict)
    #: ``centers="auto"`` made one cell of all points, for their width.
    auto_single: bool = False

    def near_distance(self, rank: int) -> dict[int, float]:
        """Per cell with ``rank`` members or more, the ``rank``-th smallest member distance to the centre.

        Computed when a search first asks for a rank (one small job, at most
        one row per cell comes back) and kept.
        """
        if rank not in self.near:
            rows = bounded_collect(near_distances(self.points, rank), len(self.cells), "near distances")
            self.near[rank] = {int(r["cell"]): float(r["near"]) for r in rows}
        return self.near[rank]


def centers_sql(centers: list[tuple[int, tuple]]) -> str:
    """``array<struct<cell int, center array<double>>>`` constant as SQL text."""
    return "array(" + ", ".join(
        f"named_struct('cell', {int(cid)}, 'center', {vector_sql(center)})" for cid, center in centers
    ) + ")"


def unrolled(n_centers: int, dim: int) -> bool:
    return 0 < dim <= MAX_UNROLLED_WIDTH and n_centers * dim <= MAX_UNROLLED_TERMS


def nearest_center(vec: str, centers: list[tuple[int, tuple]], dim: int) -> Column:
    """``struct(d2, cell)`` of the nearest centre to column ``vec``; the smallest cell id wins ties.

    Written out centre by centre with the centre values as constants, so it
    runs as generated code; very many centres fall back to ``transform``.
    """
    if unrolled(len(centers), dim):
        items = ", ".join(
            f"named_struct('d2', {sqdist_const_sql(f'`{vec}`', c, dim)}, 'cell', {int(cid)})" for cid, c in centers
        )
        return F.expr(f"array_min(array({items}))")
    d2 = sqdist_sql(f"`{vec}`", "c.center", dim)
    return F.expr(f"array_min(transform({centers_sql(centers)}, c -> named_struct('d2', {d2}, 'cell', c.cell)))")


def fit_centers(
    points: DataFrame,
    n_cells: int,
    vec_col: str = "t_vec",
    seed: int = DEFAULT_SEED,
    max_iter: int = 20,
) -> list[tuple[int, tuple]]:
    """k-means centres ``[(cell, center)]`` fitted on all rows with ``pyspark.ml.clustering.KMeans``."""
    data = points.select(array_to_vector(F.col(vec_col)).alias("v"))
    model = KMeans(k=n_cells, seed=seed, maxIter=max_iter, featuresCol="v").fit(data)
    centers = model.clusterCenters()
    if len(centers) > n_cells:
        raise RuntimeError("k-means returned more centres than asked for")
    return [(i, tuple(float(x) for x in c)) for i, c in enumerate(centers)]


def label_centers(df: DataFrame, label_col: str, features_col: str, dim: int, decimals: int | None = 6) -> DataFrame:
    """Mean vector per label as ``(cell, center)``, ``cell`` = label as int.

    One grouped aggregate with ``dim`` averages (partial + final), rounded
    so that another engine can rebuild the same centres.
    """
    v = as_array(df, features_col)
    aggs = [F.avg(v[i]) for i in range(dim)]
    if decimals is not None:
        aggs = [F.round(a, decimals) for a in aggs]
    grouped = df.groupBy(F.col(label_col).cast("int").alias("cell")).agg(
        *[a.alias(f"c{i}") for i, a in enumerate(aggs)]
    )
    return grouped.select("cell", F.array(*[F.col(f"c{i}") for i in range(dim)]).alias("center"))


def assign(points: DataFrame, centers: list[tuple[int, tuple]], dim: int, vec_col: str = "t_vec") -> DataFrame:
    """Append ``cell`` (nearest centre) and ``t_dist`` (distance to it). Narrow: no shuffle."""
    if not unrolled(len(centers), dim):
        return assign_batches(points, centers, dim, vec_col)
    near = nearest_center(vec_col, centers, dim)
    return points.withColumn("_near", near).select(
        *points.columns,
        F.col("_near.cell").alias("cell"),
        F.sqrt(F.col("_near.d2")).alias("t_dist"),
    )


def assign_batches(points: DataFrame, centers: list[tuple[int, tuple]], dim: int, vec_col: str) -> DataFrame:
    """:func:`assign` over Arrow batches: more terms than are written out would be interpreted one by one.

    Terms are added in index order, so the distances are the same to the last bit.
    """
    schema = T.StructType([*points.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("t_dist", T.DoubleType())])
    at = points.columns.index(vec_col)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            vec = np.ascontiguousarray(batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(n, dim).T)
            best, cell = np.full(n, np.inf), np.full(n, centers[0][0], "i4")
            with np.errstate(over="ignore", invalid="ignore"):
                for j, (cid, center) in enumerate(sorted(centers, key=lambda c: c[0])):
                    d2 = np.zeros(n)
                    for i in range(dim):
                        x = vec[i] - center[i]
                        d2 += x * x
                    nearer = (d2 < best) | (j == 0)
                    best[nearer], cell[nearer] = d2[nearer], cid
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(np.sqrt(best))], schema.names)

    return points.mapInArrow(run, schema)


def cell_stats(assigned: DataFrame) -> DataFrame:
    """``(cell, n, radius)``: members and largest member distance per cell."""
    return assigned.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("t_dist").alias("radius"),
    )


def near_distances(assigned: DataFrame, rank: int) -> DataFrame:
    """``(cell, near)``: each cell's ``rank``-th smallest member distance, for cells with as many members.

    ``row_number() <= rank`` per cell: Catalyst keeps ``rank`` rows per cell in
    each task before the shuffle (partial ``WindowGroupLimit``).
    """
    allow_group_limit(assigned.sparkSession, rank)
    w = Window.partitionBy("cell").orderBy("t_dist", "t_id")
    top = assigned.select("cell", "t_id", "t_dist").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= rank)
    return top.where(F.col("_r") == rank).select("cell", F.col("t_dist").alias("near"))


def _blocks_for(n: int, block_rows: int) -> int:
    return max(1, -(-n // block_rows))


def block_col(cells: list[Cell], id_col: Column) -> Column:
    """``pmod(xxhash64(t_id), blocks[cell])``: a stable hash split of each cell."""
    if all(c.blocks == 1 for c in cells):
        return F.lit(0)
    blocks = F.create_map(*[x for c in cells for x in (F.lit(c.cell), F.lit(c.blocks))])
    return F.pmod(F.xxhash64(id_col), F.element_at(blocks, F.col("cell")).cast("long")).cast("int")


def prepare_points(
    df: DataFrame,
    id_col: str = "id",
    features_col: str = "features",
    label_col: str | None = "label",
) -> tuple[DataFrame, int, int]:
    """``(t_id, [t_label], t_vec)`` with unusable vectors left out, plus the row count and width.

    A vector that is null, or holds a null or a value that is not finite, has
    no distance to anything: such rows are left out, in every search mode
    alike. One job computes count and width and checks that all widths agree.
    """
    cols = [F.col(id_col).alias("t_id")]
    if label_col is not None:
        cols.append(F.col(label_col).cast("double").alias("t_label"))
    cols.append(as_array(df, features_col).alias("t_vec"))
    pts = df.select(*cols).where(usable("t_vec"))
    stats = pts.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.size("t_vec")).alias("lo"),
        F.max(F.size("t_vec")).alias("hi"),
    ).first()
    n = int(stats["n"])
    if n and stats["lo"] != stats["hi"]:
        raise ValueError(f"vectors have different widths ({stats['lo']} to {stats['hi']})")
    dim = int(stats["hi"]) if n else 0
    return pts, n, dim


def build_index(
    df: DataFrame,
    id_col: str = "id",
    features_col: str = "features",
    label_col: str | None = "label",
    centers: str | DataFrame | list = "auto",
    max_cells: int = DEFAULT_MAX_CELLS,
    seed: int = DEFAULT_SEED,
    block_rows: int = DEFAULT_BLOCK_ROWS,
    max_iter: int = 20,
    checkpoint: bool = True,
) -> CellIndex:
    """Build the search index over training rows.

    ``max_cells`` caps the number of k-means cells (50 is the usual rule; more
    cells pay for larger tables). ``centers``: ``"kmeans"`` (fit :func:`cell_count` cells), ``"single"``
    (one cell, for brute-force search), ``"auto"`` (k-means up to
    ``AUTO_PRUNE_MAX_DIM`` wide, else single; ``search="single_cell"`` refuses the latter), a DataFrame ``(cell, center)``
    or a list ``[(cell, center)]`` of given centres.

    With ``checkpoint=True`` (default) the assigned points are written once
    as parquet to the shared checkpoint folder (``spark.checkpoint.dir``):
    later searches read that table instead of recomputing the assignment,
    its lineage is cut, and a lost executor only costs re-reading a file.
    """
    if block_rows < 1:
        raise ValueError("block_rows must be at least 1")
    pts, n, dim = prepare_points(df, id_col, features_col, label_col)
    has_label = label_col is not None
    if n == 0:
        empty = pts.withColumn("cell", F.lit(0)).withColumn("block", F.lit(0)).withColumn("t_dist", F.lit(0.0))
        return CellIndex([], empty, 0, 0, has_label, block_rows)
    pts = pts.withColumn("t_vec", checked_width(F.col("t_vec"), dim))

    auto_single = isinstance(centers, str) and centers == "auto" and dim > AUTO_PRUNE_MAX_DIM
    if isinstance(centers, str) and centers == "auto":
        centers = "kmeans" if dim <= AUTO_PRUNE_MAX_DIM else "single"
    if isinstance(centers, str) and centers == "kmeans" and n == 1:
        # Spark's k-means fails on a single row.
        center_list = [(0, tuple(float(x) for x in pts.first()["t_vec"]))]
    elif isinstance(centers, str) and centers == "kmeans":
        center_list = fit_centers(pts, cell_count(n, max_cells), seed=seed, max_iter=max_iter)
    elif isinstance(centers, str) and centers == "single":
        center_list = [(0, tuple([0.0] * dim))]
    elif isinstance(centers, DataFrame):
        rows = bounded_collect(centers.select("cell", "center"), MAX_CELLS_LIMIT, "centres")
        center_list = [(int(r["cell"]), tuple(float(x) for x in r["center"])) for r in rows]
    else:
        center_list = [(int(c), tuple(float(x) for x in v)) for c, v in centers]
    if not center_list:
        raise ValueError("no centres")
    check_literal_size(len(center_list), dim)
    if any(len(c) != dim for _, c in center_list):
        raise ValueError("centre width differs from the data")

    assigned = assign(pts, center_list, dim)
    if checkpoint:
        # Spread over enough files that a scan of the index runs in parallel.
        files = max(df.sparkSession.sparkContext.defaultParallelism, -(-n // POINTS_PER_FILE))
        assigned = materialize(assigned.repartition(files, "t_id"), "cell-index")
    stats = bounded_collect(cell_stats(assigned), len(center_list), "cell stats")
    by_id = dict(center_list)
    cells = sorted(
        (
            Cell(int(r["cell"]), by_id[int(r["cell"])], float(r["radius"]), int(r["n"]),
                 _blocks_for(int(r["n"]), block_rows))
            for r in stats
        ),
        key=lambda c: c.cell,
    )
    points = assigned.withColumn("block", block_col(cells, F.col("t_id")))
    return CellIndex(cells, points, dim, n, has_label, block_rows, auto_single=auto_single)

