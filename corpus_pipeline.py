"""Corpus pipeline: toxicity, line dedup, SimHash near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the
last return the columns of ``documents``. Rows with nulls, empty texts and repeated rows pass
each stage as its operator defines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.llm import simhash, toxicity
from evispark.llm.line_dedup import dedup_lines
from evispark.llm.packing import pack_documents
from evispark.llm.store import materialize
from evispark.llm.tokens import SHARED_MEMO_BYTES


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labelled training part does not call toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, keep=True)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier line; ``n_chars`` follows the text."""
    kept = dedup_lines(docs)
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are linked by a Jaccard similarity of 0.8 or more of
    their five-word shingles."""
    return simhash.near_dedup(docs, shingle_words=5, radius=4)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    return pack_documents(docs, SHARED_MEMO_BYTES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_copies),
    ("packing", pack),
]

#: The model's scores, the fingerprints and the packing have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
