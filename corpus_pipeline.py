"""Corpus pipeline: from raw documents to token ids, in five stages.

Each stage is one of the training-data operators and takes
``(spark, docs, sf_dir)``; its result is written as Parquet and read again as
the next stage's ``docs``. All but the last return the columns of
``documents``.

1. ``quality``: documents that the quality rules reject go.
2. ``near_dedup``: one document of each class of near duplicates stays.
3. ``pii``: personal data is replaced by its kind, as in ``<EMAIL>``.
4. ``mixing``: documents are repeated (the last copy cut) as the mix of sources takes them.
5. ``bpe``: token ids, their count and digests, one row per document of the mix.

Edge cases: a null or empty text has too few words, so ``quality`` drops it; a
text without words that reaches a later stage is kept as it is by ``near_dedup``
(a class of its own) and ``pii``, never taken by ``mixing`` (its size is 0), and
encoded to no tokens by ``bpe``. Null ids, languages, sources and counts pass
through; a null source is a source of its own. Of repeated rows one stays. Texts
of any length are taken whole. Extra columns, whatever their names, go along to the last stage, which returns
its own columns. An empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vicinity.llm import bpe, minhash, mixing, pii
from vicinity.llm import quality as rules
from vicinity.llm.common import quoted
from vicinity.session import materialize
from vicinity.sources.points import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.quality(docs).where("kept").select(*quoted(docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(docs, carry=["doc_id"], decoded="decoded")
    return encoded.select("doc_id", *bpe.digests(), "ids")


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("pii", pii_redaction),
    ("mixing", source_mixing),
    ("bpe", encoding),
]

# No SQL form: near-duplicate classes and token ids. The tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
