"""From raw documents to token counts in four stages, each a Spark job over all rows the one before kept.

Each stage reads the Parquet that the stage before wrote and returns the columns of ``documents``; the last returns
token counts and digests. Nulls, ties, repeated rows and empty tables are defined where the operators say so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from beamspark.llm import contamination, ordinal, pieces, setjoin
from beamspark.llm.op_queries import piece_model
from beamspark.llm.shared import written
from beamspark.plans.registry import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that are likely enough of the best grade; fitted on a bounded sample of ``labels``."""
    return ordinal.selected(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of documents linked by a likeness of 0.8 of their runs of five words."""
    return setjoin.one_of_each(docs, gram=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents of which a twentieth or more lies in windows of benchmark items."""
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every kept text and decode it again: counts and digests per document."""
    return pieces.digests(docs, piece_model())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", benchmark), ("sentencepiece", tokens)]
ORACLE_SQL = None  # hashing, model fitting and merge tables are beyond SQL; tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
