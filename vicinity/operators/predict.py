"""Predictions from a k-NN table ``(q_id, t_id, label, d2, rank)``.

The k-NN table comes out of :mod:`vicinity.operators.search` hash-partitioned
on ``q_id``; every aggregate below groups by ``q_id`` (or ``q_id, label``),
which that partitioning already satisfies, so none of them shuffles again.
Only the final re-attach to the query rows (:func:`attach`) moves data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EXACT_MATCH_MODES = ("mean", "sum")


def vote_counts(nn: DataFrame) -> DataFrame:
    """``(q_id, label, votes)``: how many of a query's neighbours carry each label."""
    return nn.groupBy("q_id", "label").agg(F.count(F.lit(1)).alias("votes"))


def vote_share(nn: DataFrame) -> DataFrame:
    """``(q_id, label, votes, share)``, ``share = votes / neighbours found``."""
    votes = vote_counts(nn)
    total = F.sum("votes").over(Window.partitionBy("q_id"))
    return votes.withColumn("share", F.col("votes") / total)


def classify_predictions(nn: DataFrame) -> DataFrame:
    """``(q_id, prediction)``: label with most votes, ties to the smallest label."""
    votes = vote_counts(nn)
    best = F.max_by(F.col("label"), F.struct(F.col("votes"), -F.col("label")))
    return votes.groupBy("q_id").agg(best.alias("prediction"))


def raw_predictions(nn: DataFrame, num_classes: int) -> DataFrame:
    """``(q_id, raw array<double>, probability array<double>)``: votes, and their shares, per class ``0..num_classes-1``.

    Labels must be whole numbers from 0 (:func:`check_class_labels`). Gathers
    at most ``k`` (label, votes) entries per query, a bounded group.
    """
    per_q = vote_counts(nn).groupBy("q_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("label").cast("int"), F.col("votes").cast("double")))).alias("_m"),
        F.sum("votes").alias("_all"),
    )
    raw = F.transform(
        F.sequence(F.lit(0), F.lit(num_classes - 1)),
        lambda i: F.coalesce(F.element_at(F.col("_m"), i), F.lit(0.0)),
    )
    return per_q.select("q_id", raw.alias("raw"), F.transform(raw, lambda v: v / F.col("_all")).alias("probability"))


def probability_predictions(nn: DataFrame, num_classes: int) -> DataFrame:
    """``(q_id, probability array<double>)``: vote share per class index ``0..num_classes-1``."""
    return raw_predictions(nn, num_classes).select("q_id", "probability")


def check_class_labels(df: DataFrame, label_col: str) -> None:
    """Raise unless every label that is not null is a whole number from 0."""
    v = F.col(label_col).cast("double")
    bad = df.select(v.alias("v")).where(F.col("v").isNotNull() & (F.isnan("v") | (F.col("v") < 0) | (F.col("v") != F.floor("v")))).first()
    if bad is not None:
        raise ValueError(f"class votes need labels 0, 1, 2 and so on; found {bad['v']}")


def regress_predictions(nn: DataFrame, exact_match: str = "mean", power: float = 2.0) -> DataFrame:
    """``(q_id, prediction)``: inverse-distance weighted mean of neighbour labels.

    Weight is ``1 / d^power`` (``power=2``: one over the squared distance).
    When some neighbour sits at distance 0, weights are dropped and the
    labels at distance 0 give the answer: their mean (``exact_match="mean"``)
    or their sum (``"sum"``, the reference's literal rule). Neighbours
    without a label count neither in the sum nor in the weights.
    """
    if exact_match not in EXACT_MATCH_MODES:
        raise ValueError(f"exact_match must be one of {EXACT_MATCH_MODES}")
    d2 = F.col("d2")
    at_zero = F.when(d2 == 0, F.col("label"))
    exact = F.avg(at_zero) if exact_match == "mean" else F.sum(at_zero)
    inv = F.lit(1.0) / F.nullif(d2, F.lit(0.0)) if power == 2.0 else F.lit(1.0) / F.nullif(F.pow(d2, power / 2.0), F.lit(0.0))
    weighted = F.sum(F.col("label") * inv) / F.sum(F.when(F.col("label").isNotNull(), inv))
    return nn.groupBy("q_id").agg(F.coalesce(exact, weighted).alias("prediction"))


def attach(queries: DataFrame, preds: DataFrame, id_col: str, output_cols: list[str]) -> DataFrame:
    """Left join of predictions back to the query rows, whose columns keep their order; rows with no neighbour get nulls."""
    clash = [c for c in output_cols if c in queries.columns]
    if clash:
        raise ValueError(f"output column(s) {clash} already exist")
    p = preds.select(F.col("q_id").alias(id_col), *output_cols)
    return queries.join(p, id_col, "left").select(*queries.columns, *output_cols)


def class_count(df: DataFrame, label_col: str = "label") -> int:
    """Number of classes: from nominal or binary ML metadata when present, else ``max(label) + 1``."""
    meta = df.schema[label_col].metadata or {}
    attr = meta.get("ml_attr", {})
    if attr.get("type") == "binary":
        return 2
    if attr.get("type") == "nominal":
        if "num_vals" in attr:
            return int(attr["num_vals"])
        if "vals" in attr:
            return len(attr["vals"])
    row = df.agg(F.max(F.col(label_col).cast("double")).alias("m")).first()
    if row["m"] is None:
        return 0
    return int(row["m"]) + 1


def class_count_df(df: DataFrame, label_col: str = "label") -> DataFrame:
    """:func:`class_count` as a one-row DataFrame ``(num_classes)`` computed by Spark."""
    return df.agg((F.max(F.col(label_col).cast("double")).cast("int") + 1).cast("long").alias("num_classes"))

