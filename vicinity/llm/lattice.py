"""Near-duplicate embeddings by E8 lattice hashing with exact verification.

Vectors are linked if their cosine, in double precision, is 0.9 or more.

1. Hashing: in each of ``TABLES`` tables a random projection maps the unit
   vector to ``BLOCKS`` blocks of eight coordinates, and each block is decoded
   to the nearest point of the E8 lattice (the nearer of its two D8 cosets).
   The lattice points are the vector's cell.
2. Probing: besides its own cell, a vector looks into ``PROBES`` neighbouring
   cells, those reached by the minimal lattice vectors that add least to its
   distance. At cosine 0.9 a pair meets in a table with probability of about
   0.24, so 16 tables find about 0.99 of such pairs, and more of closer ones.
3. Balls: within a cell of the first table, the vectors within half the link
   angle of the smallest one are one ball. All vectors of a ball are linked
   with each other, by the triangle inequality, so a group of copies of any
   size costs one comparison per member and is never expanded into pairs.
4. Verification: pairs of balls that meet in a cell are compared by their
   centres: fully linked, not linked, or undecided (by angle and radii). The
   members of undecided pairs are compared in blocks of bounded size, which
   return counts and one link per pair of balls, not the pairs.

Links are counted from sizes and counts; components are taken over balls.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing (their component is their own id, ``kept``
true). Vectors of different width never link. Repeated rows are links of each
other. A null id sorts after all others; alone it has a null component. The
index is random by a fixed seed and is fitted on nothing.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.llm.common import components, quoted, ship, sorted_runs
from vicinity.llm.words import mix, stream
from vicinity.session import materialize
from vicinity.sources.points import read_table

THRESHOLD = 0.9
TABLES, BLOCKS, PROBES, SCALE, SEED = 16, 2, 8, 0.6, 8
GROUP = 256
ANGLE = float(np.arccos(THRESHOLD))
#: Room for rounding in decisions by angle; closer cases are compared directly.
SLACK = 1e-7
_U = np.uint64
_COORD = stream(BLOCKS * 8, 31) | _U(1)


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


MINIMAL = minimal_vectors()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer vectors of even sum."""
    r = np.rint(x)
    e = x - r
    rows = np.flatnonzero(r.sum(axis=-1).astype(np.int64) & 1)
    k = np.abs(e[rows]).argmax(axis=-1)
    r[rows, k] += np.where(e[rows, k] >= 0, 1.0, -1.0)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8 to the rows of ``x`` (n x 8)."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=-1) <= ((x - b) ** 2).sum(axis=-1))[:, None], a, b)


def cells(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Own cell (n x TABLES) and probed cells (n x TABLES * PROBES) of unit vectors."""
    n, width = unit.shape
    rng = np.random.default_rng([SEED, width])
    own, probed = np.empty((n, TABLES), np.int64), np.empty((n, TABLES, PROBES), np.int64)
    salts = stream(TABLES, 32 + width)
    for t in range(TABLES):
        x = (unit @ rng.standard_normal((width, BLOCKS * 8)) * SCALE).reshape(n, BLOCKS, 8)
        point = nearest_e8(x.reshape(-1, 8)).reshape(n, BLOCKS, 8)
        # Stepping a block by a minimal vector v adds 2 - 2 r.v to the squared distance (r: what decoding left).
        extra = (2 - 2 * ((x - point) @ MINIMAL.T)).reshape(n, -1)
        steps = np.argsort(extra, axis=1, kind="stable")[:, :PROBES]
        with np.errstate(over="ignore"):
            def hashed(p: np.ndarray, t: int = t) -> np.ndarray:
                twice = np.rint(2 * p).astype(np.int64).reshape(len(p), -1).astype(_U)
                return mix((twice * _COORD).sum(axis=1, dtype=_U) + salts[t]).astype(np.int64)

            own[:, t] = hashed(point)
            for k in range(PROBES):
                moved = point.copy()
                moved[np.arange(n), steps[:, k] // len(MINIMAL)] += MINIMAL[steps[:, k] % len(MINIMAL)]
                probed[:, t, k] = hashed(moved)
    return own, probed.reshape(n, -1)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 2048):
            rows, lists = batch.column(0).slice(lo, 2048), batch.column(1).slice(lo, 2048)
            widths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            for width in np.unique(widths[widths > 0]).tolist():
                at = np.flatnonzero(widths == width)
                v = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
                # Scaled by the largest component first, so that no square overflows or vanishes.
                top = np.abs(v).max(axis=1)
                ok = np.isfinite(v).all(axis=1) & (top > 0)
                v, at = v[ok] / top[ok, None], at[ok]
                unit = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
                if not len(at):
                    continue
                own, probed = cells(unit)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.take(pa.array(at)), pa.array([u.tobytes() for u in unit], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * TABLES), pa.array(own.ravel())),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * TABLES * PROBES), pa.array(probed.ravel())),
                    ],
                    ["row", "vec", "own", "probed"],
                )


def _dots(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Row-wise products of two columns of vectors."""
    return np.array([float(np.frombuffer(x) @ np.frombuffer(y)) if len(x) == len(y) else -1.0 for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)])


def _angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        angle = np.arccos(np.clip(_dots(batch.column(2), batch.column(3)), -1, 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(angle)], ["row", "lead", "angle"])


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``full`` or undecided pairs of balls; pairs that cannot link are left out."""
    for batch in batches:
        cos = _dots(batch.column(2), batch.column(3))
        ra, rb = batch.column(4).to_numpy(), batch.column(5).to_numpy()
        single = (ra == 0) & (rb == 0)
        angle = np.arccos(np.clip(cos, -1, 1))
        full = np.where(single, cos >= THRESHOLD, angle + ra + rb <= ANGLE - SLACK)
        out = np.where(single, cos < THRESHOLD, angle - ra - rb > ANGLE + SLACK)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(full)], ["a", "b", "full"]).filter(pa.array(~out))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between a block of a ball and a block of its guests: counts per row, one link per guest ball."""
    for run in sorted_runs(batches, ["host", "i", "j"]):
        guest = run["ball"].is_valid().to_numpy()
        if guest.all() or not guest.any():
            continue
        vec = run["vec"].to_pylist()
        x = np.array([np.frombuffer(vec[k]) for k in np.flatnonzero(~guest)])
        y = np.array([np.frombuffer(vec[k]) for k in np.flatnonzero(guest)])
        near = x @ y.T >= THRESHOLD
        rows = run["row"].to_numpy()
        counts = np.concatenate([near.sum(axis=1), near.sum(axis=0)])
        ids = np.concatenate([rows[~guest], rows[guest]])
        some = np.flatnonzero(counts)
        balls = np.unique(run["ball"].drop_null().to_numpy()[near.any(axis=0)])
        n, host = len(some), run["host"][0].as_py()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*ids[some].tolist(), *[None] * len(balls)], pa.int64()), pa.array([*counts[some].tolist(), *[None] * len(balls)], pa.int64()),
                pa.array([*[None] * n, *[host] * len(balls)], pa.int64()), pa.array([*[None] * n, *balls.tolist()], pa.int64()),
            ],
            ["row", "n", "a", "b"],
        )


def link_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row of ``df``."""
    ship(df.sparkSession)
    table = materialize(df.select(F.col(quoted([id_col])[0]).alias("id"), F.col(quoted([vector_col])[0]).cast("array<double>").alias("v"), F.monotonically_increasing_id().alias("row")), "lattice-input")
    sig = table.select("row", "v").mapInArrow(_hash, "row long, vec binary, own array<long>, probed array<long>")
    sig = materialize(sig, "lattice-cells")
    vec = sig.select("row", "vec")

    # Balls in the cells of the first table.
    first = sig.select("row", F.col("own")[0].alias("cell"), "vec")
    lead = first.groupBy("cell").agg(F.min("row").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    led = first.join(lead, "cell").where("row <> lead").join(vec.select(F.col("row").alias("lead"), F.col("vec").alias("lead_vec")), "lead")
    angles = led.select("row", "lead", "vec", "lead_vec").mapInArrow(_angles, "row long, lead long, angle double")
    inside = angles.where(F.col("angle") <= ANGLE / 2 - SLACK)
    ball = materialize(sig.select("row").join(inside, "row", "left").select("row", F.coalesce("lead", "row").alias("ball"), F.coalesce("angle", F.lit(0.0)).alias("angle")), "lattice-balls")
    # A ball of one is compared directly; others get the room that rounding needs.
    balls = ball.groupBy("ball").agg(F.count(F.lit(1)).alias("size"), F.max("angle").alias("radius"))
    balls = balls.withColumn("radius", F.when(F.col("size") > 1, F.col("radius") + SLACK).otherwise(F.lit(0.0)))
    balls = materialize(balls.join(vec.withColumnRenamed("row", "ball"), "ball"), "lattice-centres")

    # Balls that meet: in a cell of one's members, or in one that the other's members probe.
    placed = sig.select("row", "own", "probed").join(ball.select("row", "ball"), "row")
    home = placed.select("ball", F.explode("own").alias("cell")).distinct()
    looks = placed.select("ball", F.explode(F.concat("own", "probed")).alias("cell")).distinct()
    met = looks.join(home.withColumnRenamed("ball", "other"), "cell").where("ball <> other")
    pairs = met.select(F.least("ball", "other").alias("a"), F.greatest("ball", "other").alias("b")).distinct()
    one = balls.select(F.col("ball").alias("a"), F.col("vec").alias("va"), F.col("radius").alias("ra"))
    two = balls.select(F.col("ball").alias("b"), F.col("vec").alias("vb"), F.col("radius").alias("rb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "va", "vb", "ra", "rb")
    decided = materialize(both.mapInArrow(_decide, "a long, b long, full boolean"), "lattice-pairs")

    # Undecided pairs: the larger ball is the host, all members of its partners are its guests.
    size = balls.select("ball", "size")
    open_pairs = decided.where("not full").join(size.withColumnRenamed("ball", "a").withColumnRenamed("size", "na"), "a").join(size.withColumnRenamed("ball", "b").withColumnRenamed("size", "nb"), "b")
    hosted = open_pairs.select(F.when(F.expr("na >= nb"), F.col("a")).otherwise(F.col("b")).alias("host"), F.when(F.expr("na >= nb"), F.col("b")).otherwise(F.col("a")).alias("ball"), F.greatest("na", "nb").alias("n_host"), F.least("na", "nb").alias("n_guest"))
    hosted = materialize(hosted, "lattice-open")
    totals = hosted.groupBy("host").agg(F.max("n_host").alias("n_host"), F.sum("n_guest").alias("n_guests"))
    totals = totals.select("host", F.expr(f"cast(ceil(n_host / {GROUP}) as int)").alias("ni"), F.expr(f"cast(ceil(n_guests / {GROUP}) as int)").alias("nj"))
    members = ball.join(vec, "row")
    guests = hosted.select("host", "ball").join(members, "ball").join(totals, "host")
    guests = guests.withColumn("j", F.pmod(F.xxhash64("row"), "nj").cast("int")).withColumn("i", F.explode(F.expr("sequence(0, ni - 1)")))
    hosts = members.withColumnRenamed("ball", "host").join(totals, "host")
    hosts = hosts.withColumn("i", F.pmod(F.xxhash64("row"), "ni").cast("int")).withColumn("j", F.explode(F.expr("sequence(0, nj - 1)")))
    cols = ["host", "i", "j", "row", "vec"]
    blocks = guests.select(*cols, "ball").unionByName(hosts.select(*cols, F.lit(None).cast("long").alias("ball")))
    blocks = blocks.repartition("host", "i", "j").sortWithinPartitions("host", "i", "j")
    found = materialize(blocks.mapInArrow(_blocks, "row long, n long, a long, b long"), "lattice-links")

    # Counts: the rest of one's ball, balls that are fully linked, and what the blocks found.
    full = decided.where("full")
    ends = full.select(F.col("a").alias("ball"), F.col("b").alias("other")).unionAll(full.select("b", "a"))
    more = ends.join(size.withColumnRenamed("ball", "other").withColumnRenamed("size", "n"), "other").groupBy("ball").agg(F.sum("n").alias("near"))
    per_ball = size.join(more, "ball", "left").select("ball", (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("near"))
    per_row = found.where("row is not null").groupBy("row").agg(F.sum("n").alias("some"))
    edges = full.select("a", "b").unionAll(found.where("a is not null").select("a", "b"))
    comp = components(edges).withColumnRenamed("id", "ball")
    linked = ball.join(per_ball, "ball").join(comp, "ball", "left").join(per_row, "row", "left")
    linked = linked.select("row", (F.col("near") + F.coalesce("some", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "ball").alias("component"))
    joined = materialize(table.select("row", "id").join(linked, "row", "left").withColumn("component", F.coalesce("component", "row")), "lattice-result")
    smallest = joined.groupBy("component").agg(F.min("id").alias("component_id"))
    result = joined.join(smallest, "component")
    return result.select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op3_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding."""
    links = link_vectors(read_table(spark, sf_dir, "embeddings"))
    return links.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


# Brute force over all pairs (a component is found by spreading the smallest id).
SQL = r"""
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
p as (select a.vec_id as a, b.vec_id as b from v a, v b where a.vec_id <> b.vec_id
  and list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9),
r(a, b) as (select vec_id, vec_id from v union select r.a, p.b from r join p on r.b = p.a),
c as (select a, min(b) as component_id from r group by a),
n as (select a, count(*) as n from p group by a)
select vec_id, coalesce(n.n, 0) as n_links, component_id, vec_id = component_id as kept from v join c on c.a = vec_id left join n on n.a = vec_id
"""
