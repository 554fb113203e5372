"""Readers that turn tables into labelled points ``(id, label, features)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vicinity.functions.vectors import as_array


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def labeled_points(
    df: DataFrame,
    id_col: str | None = "id",
    label_col: str | None = "label",
    features_col: str = "features",
) -> DataFrame:
    """``(id, label double, features array<double>)`` from any table.

    ``features_col`` may be a numeric array or an ML vector; ``label_col`` is
    cast to double. Pass ``None`` to leave a column out.
    """
    cols: list[Column] = []
    if id_col is not None:
        cols.append(F.col(id_col).alias("id"))
    if label_col is not None:
        cols.append(F.col(label_col).cast("double").alias("label"))
    cols.append(as_array(df, features_col).alias("features"))
    return df.select(*cols)


def assemble(df: DataFrame, exprs: Sequence[Column | str], name: str = "features") -> DataFrame:
    """Append ``array<double>`` column ``name`` built from scalar columns or expressions."""
    parts = [F.col(e) if isinstance(e, str) else e for e in exprs]
    return df.withColumn(name, F.array(*[p.cast("double") for p in parts]))


def number_rows(df: DataFrame, order: Sequence[str], name: str = "row_id", start: int = 1, keep: Sequence[str] | None = None) -> DataFrame:
    """Number the rows ``start, start+1, ...`` in the order of ``order``, distributed.

    A global ``row_number()`` would move every row into one task. Here the
    rows are range-sorted across partitions, each partition counts its rows
    (one small row per partition), a running sum over those counts gives each
    partition its first number, and a row's number is that offset plus its
    place in the partition. The per-partition table has one row per
    partition, so it is safe to broadcast.

    The sorted rows are written once to the checkpoint folder before they are
    counted, so a re-sort (of rows that tie on every ``order`` column, or
    after a lost executor) cannot place them differently. Of their columns only
    those of ``keep`` (all, if not given) are written and returned.
    """
    from vicinity.session import materialize

    # Sorted once and written to the checkpoint folder: the per-partition
    # counts and the numbering read the same rows in the same places.
    ordered = materialize(
        df.orderBy(*order).select(
            *(["*"] if keep is None else keep),
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().alias("_mono"),
        ),
        "numbered",
        "snappy" if keep is None else "zstd",
    )
    # monotonically_increasing_id puts the partition index in the upper 31 bits
    # and the row's place in the partition in the lower 33.
    pos = F.col("_mono") - F.shiftleft(F.col("_part").cast("long"), 33)
    counts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"),
    ).fillna(0, subset=["_off"])
    return (
        ordered.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_off") + pos + F.lit(start))
        .drop("_part", "_mono", "_off")
    )


def ensure_id(df: DataFrame, id_col: str) -> DataFrame:
    """``df`` with a stable unique id column.

    Returns ``df`` unchanged when the column exists. Otherwise a
    ``monotonically_increasing_id`` is added and the table is written once to
    the checkpoint folder, so recomputation after a lost executor sees the
    same ids.
    """
    if id_col in df.columns:
        return df
    from vicinity.session import materialize

    return materialize(df.withColumn(id_col, F.monotonically_increasing_id()), "with-id")
