"""Large searches: queries and points meet as packed blocks, read from files and never copied.

A grid join copies every query once per block of points and every point once per block of
queries, so its shuffle grows with the pairs. Here both sides are written once, packed: a row
holds the vectors of some thousand rows as one matrix. The Cartesian product of the two
written tables reads these rows in place, a task for each (file of queries, file of points), and
keeps the ``k`` nearest so far of the queries it is at. What is shuffled are ``k`` rows for each
query and file of points.

Within a task a block of points is compared with those queries only whose bound, by the
triangle inequality over the distance to its cell's centre, reaches into it: points are packed
in the order of (cell, distance to the centre), so a block is a ring. Wide vectors go through a
matrix product in single precision first; every pair that this and its rounding error
cannot exclude gets its true distance, added up in index order like everywhere else, so
the answer is that of brute force bit for bit, ties to the smallest id.

Where all points are searched among themselves, two packed rows meet once, and one product
serves the lists of both (:func:`packed_self_search`); so do rows of two sets
that are searched in each other (:func:`packed_cross_search`).
"""

from __future__ import annotations

import math
from collections import namedtuple
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vicinity.functions.vectors import sqnorm
from vicinity.operators.blocks import block_top
from vicinity.operators.cells import CellIndex
from vicinity.session import allow_group_limit, materialize, session_conf, ship_code

#: Rows and bytes of a packed row.
PACK_ROWS = 16_384
PACK_BYTES = 8 << 20
#: Neighbours that a task holds for a packed row of queries.
PACK_PLACES = 2_000_000
#: Bytes of a file of packed points; one task holds them for one row of queries at a time.
FILE_BYTES = 96 << 20
#: Pairs that are worth a task.
TASK_PAIRS = 50_000_000
#: Points of a ring that is compared at once, and queries of one matrix product.
RING_ROWS = 2_048
QUERY_ROWS = 512
#: Points of one matrix product: its result stays in a core's cache until it is compared.
PRODUCT_ROWS = 512
#: Queries of a file at least: reading and preparing the points costs a task as much as some hundred queries.
FILE_QUERIES = 2_048
#: Up to this width a distance costs no more than the matrix product that could exclude it.
NARROW = 16
#: Values of the vectors whose product is taken in double precision at once, and of pairs whose true distance is: these stay in a core's cache.
CHECK_VALUES = 4_000_000
PAIR_VALUES = 131_072
#: Neighbours that are put in order at once.
MERGE_PLACES = 262_144
SLACK = 1e-9
ROUNDING = 16 * 2.0**-53
#: Beyond this single precision may overflow.
SINGLE_MAX = 1e15
#: Far above what single precision loses near zero.
TINY = 1e-30
NO_ID = -(2**63)

#: The points of a packed row.
Pack = namedtuple("Pack", "cell dist vec ids flags labels")

PACK = "pack long, n int, cell binary, dist binary, ids binary, known binary, extra binary, vec binary, single boolean"
#: The neighbours that a task has found for a packed row of queries.
LISTS = "row binary, t binary, flags binary, labels binary, d2 binary"
LIST_NAMES = [x.split()[0] for x in LISTS.split(", ")]
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


#: One task reads one file, one batch holds one pair of packed rows.
_MEETING = {
    "spark.sql.files.openCostInBytes": str(1 << 40), "spark.sql.files.maxPartitionBytes": str(1 << 40),
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1",
}


def can_pack(q: DataFrame, index: CellIndex) -> bool:
    """Ids of both sides are integers: they go into a matrix of their own."""
    return isinstance(q.schema["q_id"].dataType, _INTEGERS) and isinstance(index.points.schema["t_id"].dataType, _INTEGERS)


def _packed(rows: DataFrame, pack_rows: int) -> DataFrame:
    """Rows ``(cell, dist, id, extra, vec)`` as packed rows, in the order in which they lie in the partition."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        kinds = [("pack", pa.int64()), ("n", pa.int32()), *((c, pa.binary()) for c in ("cell", "dist", "ids", "known", "extra", "vec")), ("single", pa.bool_())]
        schema = pa.schema(kinds)
        held, rows_held, made = [], 0, 0

        def values(column, kind, missing):
            return np.ascontiguousarray(column.fill_null(missing).to_numpy(zero_copy_only=False), dtype=kind)

        def pack(t):
            nonlocal made
            made += 1
            known = values(t.column("id").is_valid(), "u1", False) + 2 * values(t.column("extra").is_valid(), "u1", False)
            vec = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column("vec").chunks])
            with np.errstate(over="ignore"):
                short = vec.astype("f4")
            single = bool((short == vec).all())
            return pa.RecordBatch.from_arrays([
                pa.array([first + made]), pa.array([t.num_rows], pa.int32()),
                *(pa.array([x.tobytes()], pa.binary()) for x in (
                    values(t.column("cell"), "i4", 0), values(t.column("dist"), "f8", 0.0), values(t.column("id"), "i8", NO_ID), known.astype("u1"),
                    values(t.column("extra"), "f8", 0.0), short if single else vec)),
                pa.array([single]),
            ], schema=schema)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, pack_rows - rows_held)
                held.append(part)
                rows_held += part.num_rows
                at += part.num_rows
                if rows_held == pack_rows:
                    yield pack(pa.Table.from_batches(held))
                    held, rows_held = [], 0
        if held:
            yield pack(pa.Table.from_batches(held))

    return rows.select("cell", "dist", "id", "extra", "vec").mapInArrow(run, PACK)


def _values(row, name, kind):
    import numpy as np

    return np.frombuffer(row[name].as_buffer(), kind)


def _read_pack(row, side: str = "") -> Pack:
    vec = _values(row, f"{side}vec", "f4" if row[f"{side}single"].as_py() else "f8").reshape(row[f"{side}n"].as_py(), -1).astype("f8")
    return Pack(*(_values(row, f"{side}{name}", kind) for name, kind in (("cell", "i4"), ("dist", "f8"))), vec, *(_values(row, f"{side}{name}", kind) for name, kind in (("ids", "i8"), ("known", "u1"), ("extra", "f8"))))


def _rings(cell) -> Iterator:
    """From where to where the points of a packed row are compared at once."""
    import numpy as np

    edges = np.unique(np.concatenate([[0, len(cell)], np.flatnonzero(np.diff(cell)) + 1, np.arange(0, len(cell), RING_ROWS)]))
    return zip(edges[:-1], edges[1:], strict=True)


def _each(batches: Iterator) -> Iterator:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i] for j, name in enumerate(batch.schema.names)}


def _points(index: CellIndex) -> DataFrame:
    label = F.col("t_label") if index.has_label else F.lit(None).cast("double")
    return index.points.select("cell", F.col("t_dist").alias("dist"), F.col("t_id").cast("long").alias("id"), label.alias("extra"), F.col("t_vec").alias("vec"))


def _in_rings(points: DataFrame, files: int) -> DataFrame:
    return points.withColumn("_h", F.xxhash64("id")).repartitionByRange(files, "cell", "dist", "_h").sortWithinPartitions("cell", "dist", "_h")


def _first_copies(points: DataFrame, places: int) -> DataFrame:
    """``points`` without the copies of a vector that come after its ``places`` smallest ids: no list has room for them."""
    hashed = points.withColumn("_h", F.xxhash64("vec"))
    many = materialize(hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > places).select("_h"), "pack-copies")
    if many.isEmpty():
        return points
    allow_group_limit(points.sparkSession, places)
    w = Window.partitionBy("_h", "vec").orderBy("id")
    copied = hashed.join(many, "_h", "left_semi").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= places).drop("_r")
    return hashed.join(many, "_h", "left_anti").unionByName(copied).drop("_h")


def _files(n_queries: int, q_rows: int, n_points: int, row_bytes: int, worth: int) -> tuple[int, int]:
    """Files of queries (``q_rows`` at most in each) and of points, for about ``worth`` tasks.

    A task begins without bounds, and the first points it meets cost several times those that come later.
    So points are split only by their bytes, or where there are too few queries for the tasks.
    """
    t_files = max(1, -(-n_points * row_bytes // FILE_BYTES))
    q_files = max(1, -(-n_queries // q_rows), min(-(-worth // t_files), n_queries // FILE_QUERIES))
    return q_files, max(t_files, min(-(-worth // q_files), -(-n_points // RING_ROWS)))


def _true(mask):
    """Places of the few true values of a boolean matrix, eight values at a time."""
    import numpy as np

    flat = mask.reshape(-1)
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view("u8") != 0)
    if len(words) > whole // 64:
        return np.flatnonzero(flat)
    at = (words[:, None] * 8 + np.arange(8)).reshape(-1)
    return np.concatenate([at[flat[at]], whole + np.flatnonzero(flat[whole:])])


def _ordered(row, dist, tid):
    """Places in order of ``(row, dist, tid)``: by the distance in single precision, then those that tie there."""
    import numpy as np

    with np.errstate(over="ignore"):
        key = (row << 32) | dist.astype("f4").view("i4").astype("i8")
    order = np.argsort(key)
    key = key[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    if len(same):
        tied = np.union1d(same, same + 1)
        some = order[tied]
        order[tied] = some[np.lexsort((tid[some], dist[some], key[tied]))]
    return order


class Nearest:
    """The ``k`` nearest so far of the queries of one packed row.

    Points found wait until they are as many as half of the places: put in order one block after the other,
    they would cost more than the products that found them.
    """

    def __init__(self, q, ids, known, bound, k, kb, cells, mode, exclude_self):
        import numpy as np

        self.np, self.q, self.ids, self.known, self.k, self.exclude_self = np, q, ids, known, k, exclude_self
        self.cells, self.mode, self.dim = cells, mode, q.shape[1]
        n = len(q)
        self.d2 = np.full((n, k), np.inf)
        self.t = np.full((n, k), NO_ID, "i8")
        self.flags = np.zeros((n, k), "u1")
        self.labels = np.zeros((n, k))
        self.found = np.zeros(n, "i8")
        self.wrong = ROUNDING * (self.dim + 4)
        self.bound = bound  # a distance, infinite if none is known
        self.dc_of = (None, None)
        self.best = None
        if mode == "single_cell":
            best = [np.full(n, 2), np.full(n, np.inf), np.full(n, -1)]
            for cell, (center, radius, size, _) in sorted(cells.items()):
                few, ub = int(size < kb), self._dc(cell) + radius
                better = (few < best[0]) | ((few == best[0]) & (ub < best[1]))
                for held, new in zip(best, (few, ub, cell), strict=True):
                    held[better] = new[better] if isinstance(new, np.ndarray) else new
            self.best = best[2]
        elif mode == "pruned":
            for cell, (_, _, _, near) in cells.items():
                if near is not None:
                    self.bound = np.minimum(self.bound, (self._dc(cell) + near) * (1 + self.wrong))
        with np.errstate(over="ignore"):
            self.q2 = (q * q).sum(1)
            # What a known bound says of squared distances, with room for rounding.
            self.limit = self.bound * self.bound * (1 + 2 * SLACK + 4 * self.wrong)
        self.left = None
        if np.abs(q).max(initial=0.0) < SINGLE_MAX:
            self.left = np.ones((n, self.dim + 2), "f4")
            self.left[:, :-2] = q
        self.waiting, self.n_waiting = [], 0

    def _pairs_d2(self, rows, t, cols):
        """True squared distances of single pairs, added up in index order."""
        np = self.np
        d2 = np.empty(len(rows))
        step = max(1, PAIR_VALUES // self.dim)
        with np.errstate(over="ignore", invalid="ignore"):
            for i in range(0, len(rows), step):
                x = self.q[rows[i : i + step]]
                x -= t[cols[i : i + step]]
                x *= x
                d2[i : i + step] = np.cumsum(x, axis=1)[:, -1]
        return d2

    def _d2(self, a, b):
        """True squared distances of rows that broadcast, added up in index order."""
        d = self.np.zeros(self.np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
        with self.np.errstate(over="ignore", invalid="ignore"):
            for i in range(self.dim):
                x = a[..., i] - b[..., i]
                d += x * x
        return d

    def _dc(self, cell):
        if self.dc_of[0] != cell:
            center = self.np.asarray(self.cells[cell][0])
            self.dc_of = cell, self.np.sqrt(self._d2(self.q, center))
        return self.dc_of[1]

    def _within(self, cell, dist, least=0.0):
        """Queries whose bound, or ``least``, reaches into the ring."""
        np = self.np
        if self.mode == "exact":
            return np.arange(len(self.q))
        lo, hi, dc = dist.min(), dist.max(), self._dc(cell)
        # Ties at the bound stay in: their ids may be smaller.
        with np.errstate(over="ignore"):
            reach = np.sqrt(np.maximum(self.limit, least)) * (1 + SLACK) + self.wrong * (dc + hi)
        return np.flatnonzero((dc - hi <= reach) & (lo - dc <= reach))

    def take(self, pack):
        for a, b in _rings(pack.cell):
            self.add(int(pack.cell[a]), *(x[a:b] for x in pack[1:]))

    def meet(self, mine, other, theirs):
        """``take(theirs)``, and ``other.take(mine)`` for those whose queries are ``theirs``: each pair is compared once."""
        np = self.np
        if self.left is None or other.left is None or not np.isfinite(self.limit).all() or not np.isfinite(other.limit).all():
            self.take(theirs)
            other.take(mine)
            return
        c = (self.dim + 8) * 2.0**-22
        for lo, hi in _rings(theirs.cell):
            rows = self._within(int(theirs.cell[lo]), theirs.dist[lo:hi], other.limit[lo:hi].max())
            t = theirs.vec[lo:hi]
            right = np.empty((self.dim + 2, len(t)), "f4")
            right[:-2], right[-2], right[-1] = t.T, -other.q2[lo:hi] * (1 - c) / 2, 1
            for at in range(0, len(rows), QUERY_ROWS):
                some = rows[at : at + QUERY_ROWS]
                left = self.left[some]
                left[:, -1] = -self.q2[some] * (1 - c) / 2
                # The product is half of the least squared distance there can be, negated.
                with np.errstate(over="ignore"):
                    here, there = ((-(x * (1 + c) + TINY) / 2).astype("f4") for x in (self.limit[some], other.limit[lo:hi]))
                near = np.empty((len(some), len(t)), bool)
                for j in range(0, len(t), PRODUCT_ROWS):
                    least = left @ right[:, j : j + PRODUCT_ROWS]
                    np.logical_or(least >= here[:, None], least >= there[None, j : j + PRODUCT_ROWS], out=near[:, j : j + PRODUCT_ROWS])
                r, col = np.divmod(_true(near), len(t))
                r = some[r]
                d2 = self._pairs_d2(r, t, col)
                self._offer(r, col, d2, *(x[lo:hi] for x in theirs[3:]))
                other._offer(lo + col, r, d2, *mine[3:])

    def add(self, cell, dist, t, ids, flags, labels):
        """Points of one cell, packed by their distance to its centre."""
        np = self.np
        if self.mode == "single_cell":
            rows = np.flatnonzero(self.best == cell)
        else:
            rows = self._within(cell, dist)
        if not len(rows):
            return
        t2 = (t * t).sum(1)
        wide = self.dim > NARROW and self.left is not None and np.abs(t).max(initial=0.0) < SINGLE_MAX
        if wide:
            c = (self.dim + 8) * 2.0**-22
            right = np.empty((self.dim + 2, len(t)), "f4")
            right[:-2], right[-2], right[-1] = t.T, -t2 * (1 - c) / 2, 1
        for at in range(0, len(rows), QUERY_ROWS):
            some = rows[at : at + QUERY_ROWS]
            if wide:
                left = self.left[some]
                q2, limit = self.q2[some], self.limit[some]
                free = ~np.isfinite(limit) | (limit > 4 * SINGLE_MAX**2)
                if free.any():
                    places = self._places(ids)
                    # The first points: those at hand bound the answer.
                    if len(t) <= places or free.sum() * len(t) > 8 * QUERY_ROWS * RING_ROWS:
                        self._all(some, t, t2, ids, flags, labels)
                        continue
                    left[:, -1] = 0
                    with np.errstate(over="ignore", invalid="ignore"):
                        near = np.partition((left[free] @ right), len(t) - places, axis=1)[:, len(t) - places]
                        # near is (t2 (1 - c) / 2 - q.t) negated, so q2 - 2 near is about the places-th squared distance.
                        guess = q2[free] - 2 * near.astype("f8") + 2 * c * (q2[free] + t2.max(initial=0.0))
                    limit = limit.copy()
                    limit[free] = np.maximum(guess, 0.0)
                    if not np.isfinite(limit).all():
                        self._all(some, t, t2, ids, flags, labels)
                        continue
                    self.limit[some] = np.minimum(self.limit[some], limit)
                left[:, -1] = -(q2 * (1 - c) - limit * (1 + c) - TINY) / 2
                near = np.empty((len(some), len(t)), bool)
                for j in range(0, len(t), PRODUCT_ROWS):
                    np.greater_equal(left @ right[:, j : j + PRODUCT_ROWS], 0, out=near[:, j : j + PRODUCT_ROWS])
                hits = _true(near)
                if len(hits) > len(some) * len(t) // 8:
                    self._all(some, t, t2, ids, flags, labels)
                    continue
                r, col = np.divmod(hits, len(t))
                self._offer(some[r], col, self._pairs_d2(some[r], t, col), ids, flags, labels)
            elif self.dim <= NARROW:
                d2 = self._d2(self.q[some][:, None, :], t[None, :, :])
                r, col = np.nonzero(d2 <= self.limit[some][:, None])
                if len(r) > 16 * len(some) * self.k and self.k < len(t):
                    # Most are not among the k nearest: only those up to the k-th distance are sorted.
                    places = min(len(t), self._places(ids))
                    kth = np.partition(d2, places - 1, axis=1)[:, places - 1]
                    r, col = np.nonzero(d2 <= np.minimum(self.limit[some], kth)[:, None])
                self._offer(some[r], col, d2[r, col], ids, flags, labels)
            else:
                self._all(some, t, t2, ids, flags, labels)
        # Without a bound the next points would all be found.
        if not np.isfinite(self.limit[rows]).all():
            self._merge()

    def _places(self, ids):
        """So many points hold ``k`` that count, whichever of them are left out as the query's own."""
        if not self.exclude_self:
            return self.k
        return self.k + int(self.np.unique(ids, return_counts=True)[1].max())

    def _all(self, some, t, t2, ids, flags, labels):
        """The same in double precision, where single precision excludes little or nothing."""
        step = max(1, CHECK_VALUES // (len(t) * self.dim))
        for i in range(0, len(some), step):
            rows = some[i : i + step]
            r, col, d2, _ = block_top(self.q[rows], t, self.q2[rows], t2, ids, min(self.k, len(t)), self.ids[rows] if self.exclude_self else None)
            self._offer(rows[r], col, d2, ids, flags, labels)

    def _offer(self, rows, cols, d2, ids, flags, labels):
        """Pairs with their true distances; the ``k`` nearest of each query stay."""
        np = self.np
        ok = d2 <= self.limit[rows]
        if self.exclude_self:
            ok &= self.ids[rows] != ids[cols]
        rows, cols, d2 = rows[ok], cols[ok], d2[ok]
        if len(rows):
            self.waiting.append((rows, d2, ids[cols], flags[cols], labels[cols]))
            self.n_waiting += len(rows)
        if self.n_waiting > len(self.ids) * self.k // 2:
            self._merge()

    def _merge(self):
        """Those that wait get their places."""
        np = self.np
        if not self.waiting:
            return
        new = [np.concatenate(x) for x in zip(*self.waiting, strict=True)]
        self.waiting, self.n_waiting = [], 0
        step = max(1, MERGE_PLACES // self.k)
        if len(self.ids) <= step:
            self._place(*new)
            return
        for lo in range(0, len(self.ids), step):
            here = (new[0] >= lo) & (new[0] < lo + step)
            if here.any():
                self._place(*(x[here] for x in new))

    def _place(self, rows, d2, tid, flags, labels):
        np, k = self.np, self.k
        found = np.bincount(rows, minlength=len(self.ids))
        own = np.flatnonzero(found)
        old, place = np.nonzero(np.arange(k)[None, :] < self.found[own][:, None])
        at = own[old]
        row = np.concatenate([at, rows])
        dist = np.concatenate([self.d2[at, place], d2])
        tid = np.concatenate([self.t[at, place], tid])
        flag = np.concatenate([self.flags[at, place], flags])
        label = np.concatenate([self.labels[at, place], labels])
        order = _ordered(row, dist, tid)
        row = row[order]
        found[own] += self.found[own]
        rank = np.arange(len(row)) - (np.cumsum(found) - found)[row]
        kept = rank < k
        row, rank, order = row[kept], rank[kept], order[kept]
        self.d2[row, rank], self.t[row, rank], self.flags[row, rank], self.labels[row, rank] = dist[order], tid[order], flag[order], label[order]
        self.found[own] = np.minimum(found[own], k)
        full = own[self.found[own] == k]
        self.limit[full] = np.minimum(self.limit[full], self.d2[full, k - 1])

    def lists(self):
        np = self.np
        self._merge()
        r, place = np.nonzero(np.arange(self.k)[None, :] < self.found[:, None])
        return r, self.t[r, place], self.flags[r, place], self.labels[r, place], self.d2[r, place]

    def rows(self):
        r, *found = self.lists()
        return self.ids[r], self.known[r], *found


def packed_search(q: DataFrame, n_queries: int, index: CellIndex, k: int, kb: int, mode: str = "exact", exclude_self: bool = False) -> DataFrame:
    """``(q_id, t_id, label, d2, rank)`` of the queries ``(q_id, q_vec, [_u1])`` among the points of the index.

    ``mode`` is ``exact``, ``pruned`` or ``single_cell``; ``_u1`` is a known bound of a query's distances, or null.
    """
    spark, dim = q.sparkSession, index.dim
    ship_code(spark)
    points = _points(index)
    u1 = F.col("_u1") if "_u1" in q.columns else F.lit(None).cast("double")
    asked = q.select(F.lit(0).alias("cell"), F.lit(0.0).alias("dist"), F.col("q_id").cast("long").alias("id"), u1.alias("extra"), F.col("q_vec").alias("vec"))
    if exclude_self:  # a null id differs from none
        points, asked = points.where("id IS NOT NULL"), asked.where("id IS NOT NULL")
    else:
        points = _first_copies(points, k)

    row_bytes = 8 * dim + 32
    pack_rows = max(1, min(PACK_ROWS, PACK_BYTES // row_bytes))
    q_rows = max(1, min(pack_rows, PACK_PLACES // k))
    cores = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    worth = max(1, min(3 * cores, n_queries * index.n // TASK_PAIRS))
    q_files, t_files = _files(n_queries, q_rows, index.n, row_bytes, worth)
    near = index.near_distance(kb) if mode == "pruned" else {}
    cells = {c.cell: (c.center, c.radius, c.n, near.get(c.cell)) for c in index.cells}
    schema = T.StructType([T.StructField("q_id", T.LongType()), T.StructField("t_id", T.LongType()), T.StructField("label", T.DoubleType()), T.StructField("d2", T.DoubleType())])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def result(state):
            ids, known, t, flags, labels, d2 = state.rows()
            return pa.RecordBatch.from_arrays([
                pa.array(ids, mask=(known & 1) == 0), pa.array(t, mask=(flags & 1) == 0), pa.array(labels, mask=(flags & 2) == 0), pa.array(d2),
            ], names=["q_id", "t_id", "label", "d2"])

        state, at = None, None
        for row in _each(batches):
            if row["q_pack"].as_py() != at:
                if state is not None:
                    yield result(state)
                at, asked = row["q_pack"].as_py(), _read_pack(row, "q_")
                state = Nearest(asked.vec, asked.ids, asked.flags, np.where(asked.flags & 2, asked.labels, np.inf), k, kb, cells, mode, exclude_self)
            state.take(_read_pack(row, "t_"))
        if state is not None:
            yield result(state)

    with session_conf(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": str(PACK_BYTES)}):
        right = materialize(_packed(_in_rings(points, t_files), pack_rows), "pack-points")
        left = materialize(_packed(asked.repartition(q_files), max(1, min(pack_rows, -(-n_queries // q_files) + 8))), "pack-queries")
    with session_conf(spark, _MEETING | {"spark.sql.execution.arrow.maxBytesPerBatch": str(PACK_BYTES)}):
        left = left.select(*[F.col(c).alias(f"q_{c}") for c in ("pack", "n", "cell", "dist", "ids", "known", "extra", "vec", "single")])
        right = right.select(*[F.col(c).alias(f"t_{c}") for c in ("n", "cell", "dist", "ids", "known", "extra", "vec", "single")])
        met = left.crossJoin(right)
        found = materialize(met.mapInArrow(run, schema), "pack-found")
    types = q.schema["q_id"].dataType, index.points.schema["t_id"].dataType
    found = found.select(F.col("q_id").cast(types[0]).alias("q_id"), F.col("t_id").cast(types[1]).alias("t_id"), "label", "d2")
    allow_group_limit(spark, k)
    w = Window.partitionBy("q_id").orderBy("d2", "t_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("q_id", "t_id", "label", "d2", "rank")


def _binary(values) -> list:
    import pyarrow as pa

    return [pa.array([x.tobytes()], pa.binary()) for x in values]


def _lists(state: Nearest) -> list:
    row, *found = state.lists()
    return _binary([row.astype("i4"), *found])


def _meeting(k: int, kb: int, cells: dict, mode: str, exclude_self: bool):
    """The lists of both rows, of each two packed rows that meet; a packed row has the bounds of its rows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def read(row, side):
            pack = _read_pack(row, side)
            return pack, Nearest(pack.vec, pack.ids, pack.flags, _values(row, f"{side}bound", "f8"), k, kb, cells, mode, exclude_self)

        def result(pack, state):
            return pa.RecordBatch.from_arrays([pa.array([pack]), *_lists(state)], names=["pack", *LIST_NAMES])

        at, mine, state, others = None, None, None, {}
        for row in _each(batches):
            if row["q_pack"].as_py() != at:
                if state is not None:
                    yield result(at, state)
                at, (mine, state) = row["q_pack"].as_py(), read(row, "q_")
            other = row["t_pack"].as_py()
            if other not in others:
                others[other] = read(row, "t_")
            theirs, their_state = others[other]
            state.meet(mine, their_state, theirs)
        if state is not None:
            yield result(at, state)
        for pack, (_, their_state) in others.items():
            yield result(pack, their_state)

    return run


def _together(table, k: int) -> tuple:
    """``(ids, known, found, row, rank, t, flags, labels, d2)``: the lists of a packed row as one, ``found`` places for each of its rows."""
    import numpy as np

    def joined(name, kind):
        return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name) if x.is_valid])

    ids, known = joined("ids", "i8"), joined("known", "u1")
    row, t, flags, labels, d2 = (joined(name, kind) for name, kind in zip(LIST_NAMES, ("i4", "i8", "u1", "f8", "f8"), strict=True))
    order = _ordered(row.astype("i8"), d2, t)
    row, t, flags, labels, d2 = (x[order] for x in (row, t, flags, labels, d2))
    found = np.bincount(row, minlength=len(ids))
    rank = np.arange(len(row)) - (np.cumsum(found) - found)[row]
    kept = rank < k
    return ids, known, np.minimum(found, k), *(x[kept] for x in (row, rank, t, flags, labels, d2))


def packed_cross_search(queries: DataFrame, n_queries: int, points: DataFrame, n_points: int, dim: int, k: int) -> DataFrame:
    """``(id, near)`` of both sides ``(id, vec, bound)``: the ``k`` nearest rows of the other side, as ``array<struct<d2, t_id>>``.

    Only what is within ``bound``, a distance or null, is listed, and rows that find nothing are left out. Ids are whole
    numbers, distinct over both sides. Each pair is compared once.
    """
    spark = queries.sparkSession
    ship_code(spark)
    row_bytes = 8 * dim + 32
    pack_rows = max(1, min(PACK_ROWS, PACK_BYTES // row_bytes, PACK_PLACES // k))
    cores = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    worth = max(1, min(3 * cores, n_queries * n_points // TASK_PAIRS))
    q_files, t_files = _files(n_queries, pack_rows, n_points, row_bytes, worth)
    t_files = max(t_files, -(-n_points * k // (4 * PACK_PLACES)))
    cells = {0: (tuple([0.0] * dim), math.inf, n_points, None)}

    def lists(table):
        import numpy as np
        import pyarrow as pa

        ids, _, found, _, _, t, _, _, d2 = _together(table, k)
        near = pa.StructArray.from_arrays([pa.array(d2), pa.array(t)], ["d2", "t_id"])
        near = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(found)]).astype("i4")), near)
        return pa.table({"id": pa.array(ids), "near": near}).filter(pa.array(found > 0))

    def rows(df):
        bound = F.coalesce("bound", F.lit(math.inf))
        return df.select(F.lit(0).alias("cell"), F.sqrt(sqnorm("vec", dim)).alias("dist"), F.col("id").cast("long").alias("id"), bound.alias("extra"), "vec")

    names = ("pack", "n", "cell", "dist", "ids", "known", "extra", "vec", "single")
    with session_conf(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": str(PACK_BYTES)}):
        left = materialize(_packed(_in_rings(rows(queries), q_files), max(1, min(pack_rows, -(-n_queries // q_files) + 8))), "pack-queries")
        right = materialize(_packed(_in_rings(rows(points), t_files), pack_rows), "pack-points")
    right = right.withColumn("pack", -F.col("pack"))  # the sides' numbers begin at 1
    sides = [df.select(*[F.col(c).alias(f"{side}_{c}") for c in names], F.col("extra").alias(f"{side}_bound")) for side, df in (("q", left), ("t", right))]
    with session_conf(spark, _MEETING | {"spark.sql.execution.arrow.maxBytesPerBatch": str(PACK_BYTES)}):
        found = materialize(sides[0].crossJoin(sides[1]).mapInArrow(_meeting(k, k, cells, "pruned", False), f"pack long, {LISTS}"), "pack-found")
    none = F.lit(None).cast("binary")
    own = left.unionByName(right).select("pack", "ids", "known", *[none.alias(c) for c in LIST_NAMES])
    each = own.unionByName(found.select("pack", none.alias("ids"), none.alias("known"), *LIST_NAMES))
    return each.groupBy("pack").applyInArrow(lists, "id long, near array<struct<d2: double, t_id: bigint>>")


def packed_self_search(index: CellIndex, k: int, kb: int, mode: str = "exact", exclude_self: bool = True) -> DataFrame:
    """``(q_id, t_id, label, d2, rank)`` of all points of the index among themselves, ``mode`` ``exact`` or ``pruned``.

    A packed row is searched among its own points first; the bounds found go with it. Then any two rows meet in one
    task, for the lists of both, and the lists of a row come together, packed as they are.
    """
    spark, n = index.points.sparkSession, index.n
    ship_code(spark)
    points = _points(index)
    if exclude_self:  # a null id differs from none
        points = points.where("id IS NOT NULL")
    row_bytes = 8 * index.dim + 32
    pack_rows = max(1, min(PACK_ROWS, PACK_BYTES // row_bytes, PACK_PLACES // k))
    cores = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # Tasks for each two files; a task holds the points and the lists of one of them.
    worth = max(1, min(3 * cores, n * n // 2 // TASK_PAIRS))
    held = max(1, -(-n * row_bytes // FILE_BYTES), -(-n * k // (4 * PACK_PLACES)))
    files = max(held, min(math.isqrt(2 * worth), n // FILE_QUERIES))
    near = index.near_distance(kb) if mode == "pruned" else {}
    cells = {c.cell: (c.center, c.radius, c.n, near.get(c.cell)) for c in index.cells}
    bounded = {cell: (*c[:3], None) for cell, c in cells.items()}

    def own(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i, row in enumerate(_each([batch])):
                pack = _read_pack(row)
                state = Nearest(pack.vec, pack.ids, pack.flags, np.full(len(pack.ids), np.inf), k, kb, cells, mode, exclude_self)
                state.take(pack)
                found = _lists(state)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, *_binary([np.sqrt(state.limit)]), *found], names=names)

    def together(table):
        import pyarrow as pa

        ids, known, _, row, rank, t, flags, labels, d2 = _together(table, k)
        return pa.table({
            "q_id": pa.array(ids[row], mask=(known[row] & 1) == 0), "t_id": pa.array(t, mask=(flags & 1) == 0),
            "label": pa.array(labels, mask=(flags & 2) == 0), "d2": pa.array(d2), "rank": pa.array((rank + 1).astype("i4")),
        })

    schema = f"{PACK}, bound binary, {LISTS}"
    names = [x.split()[0] for x in schema.split(", ")]
    found_names = LIST_NAMES
    with session_conf(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": str(PACK_BYTES)}):
        packs = materialize(_packed(_in_rings(points, files), pack_rows), "pack-points")
    with session_conf(spark, _MEETING | {"spark.sql.execution.arrow.maxBytesPerBatch": str(PACK_BYTES)}):
        packs = materialize(packs.mapInArrow(own, schema), "pack-own")
        sides = [packs.select(*[F.col(c).alias(f"{side}_{c}") for c in names if c not in found_names]) for side in "qt"]
        met = sides[0].join(sides[1], F.col("q_pack") < F.col("t_pack"))
        found = materialize(met.mapInArrow(_meeting(k, kb, bounded, mode, exclude_self), f"pack long, {LISTS}"), "pack-found")
    none = F.lit(None).cast("binary")
    each = packs.select("pack", "ids", "known", *found_names).unionByName(found.select("pack", none.alias("ids"), none.alias("known"), *found_names))
    nn = each.groupBy("pack").applyInArrow(together, "q_id long, t_id long, label double, d2 double, rank int")
    kind = index.points.schema["t_id"].dataType
    return nn.select(F.col("q_id").cast(kind).alias("q_id"), F.col("t_id").cast(kind).alias("t_id"), "label", "d2", "rank")
