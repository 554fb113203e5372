"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vicinity.session import materialize

TextsFn = Callable[[pa.Array], Iterator[tuple[int, int, list[pa.Array]]]]


_SHIPPED: set[str] = set()
#: Bytes of an Arrow batch that goes to a Python worker; long texts would fill memory at the default.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Send this package's code to the Python workers, once per application.

    ``addPyFile`` is Spark's way to do so: the driver serves the archive, and
    every executor (also one that starts later) fetches it before its tasks.
    The session's Arrow batches are bounded in bytes, too.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    archive = os.path.join(tempfile.mkdtemp(prefix="vicinity-code-"), "vicinity_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def quoted(names: Sequence[str]) -> list[str]:
    return [f"`{n.replace('`', '``')}`" for n in names]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores in front until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def map_texts(df: DataFrame, text_col: str, out: str, fn: TextsFn, carry: Sequence[str] | None = None) -> DataFrame:
    """Add the columns ``out`` (a DDL string), computed in Arrow batches from a text column.

    ``fn`` gets the texts of a batch and yields ``(lo, hi, arrays)`` for
    consecutive row ranges. The columns ``carry`` (all, if not given) go
    along; one whose name clashes with an output column gives way to it.
    """
    ship(df.sparkSession)
    made = T.StructType.fromDDL(out)
    names = {f.name.lower() for f in made}
    kept = [c for c in (df.columns if carry is None else carry) if c.lower() not in names]
    at = free_name(df, "_text")
    # A text that goes along is sent to Python once.
    own = text_col in kept and isinstance(df.schema[text_col].dataType, T.StringType)
    source = df.select(*quoted(kept), *([] if own else [F.col(quoted([text_col])[0]).cast("string").alias(at)]))
    schema = T.StructType([f for f in source.schema if f.name != at] + list(made))
    columns = [f.name for f in schema]
    place = kept.index(text_col) if own else len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, arrays in fn(batch.column(place)):
                rest = [batch.column(k).slice(lo, hi - lo) for k in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*rest, *arrays], columns)

    return source.mapInArrow(run, schema)


#: Broadcast a counted table up to this many bytes; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20


def small_or_shuffled(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (a written table, so counting is cheap) marked for broadcast if its counted size allows."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal ``keys`` (not null), from rows sorted by them."""
    kept: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        table = pa.Table.from_batches([batch])
        for lo, hi in zip(edges, edges[1:], strict=False):
            key = tuple(c[lo] for c in columns)
            if kept and key != last:
                yield pa.concat_tables(kept)
                kept = []
            last = key
            kept.append(table.slice(lo, hi - lo))
    if kept:
        yield pa.concat_tables(kept)


def running_total(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column | str], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same ``keys`` that come before.

    ``bucket`` must follow ``order`` (all rows of a bucket come before those of
    the next) and takes a bounded number of values. One group of ``keys`` may
    then hold any share of the rows: totals per bucket are pre-aggregated, a
    running sum over them gives each bucket its start, and only the rows of one
    bucket meet in a task. Key columns must not be null.
    """
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_in_bucket"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, bucket, F.coalesce(F.sum("_in_bucket").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(starts, [*keys, bucket])
        .withColumn(name, F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_start")
    )


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(id, component)`` for every id in ``edges`` (columns ``a``, ``b`` of type long).

    ``component`` is the smallest id that can be reached. Large-star and
    small-star steps alternate until every id points to its root; each step's
    edges are written to the shared checkpoint folder, so the lineage stays
    short and a lost executor costs a re-read only. An id with any number of
    edges is handled by a partial minimum and a join that Spark can split.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.unionAll(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if not large:
            both = both.where("v < u")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        near = both.join(low, "u")
        if large:
            near = near.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            near = near.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return near.where("a <> b").distinct()

    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    for _ in range(max_rounds):
        # Done once no id both points to another and is pointed to, or points to two: then all point to roots.
        ends = e.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        if ends.where("n > 1").isEmpty() and ends.join(e.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            break
        e = materialize(star(star(e, True), False), "edges")
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(roots)
