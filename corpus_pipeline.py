"""A corpus pipeline: toxicity, near copies, repeated passages, mixing to target weights, packing.

Each stage takes the documents that its predecessor kept and returns a DataFrame, which is written as Parquet and read
again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import durable
from gridloom.llm.mixing import mix, repeat_documents
from gridloom.llm.packing import pack_documents
from gridloom.llm.queries import WORD_VOCABULARY, table, vocabulary
from gridloom.llm.simhash import keep_first_of_group
from gridloom.llm.substring_dedup import remove_repeats
from gridloom.llm.toxicity import drop_toxic, fit
from gridloom.session import ship_package


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go. The machine learns from the labels of documents that are here."""
    ship_package(spark)
    return drop_toxic(docs, fit(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays."""
    return keep_first_of_group(docs, words=5, similarity=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are taken out of the texts; every document stays."""
    return remove_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, the last time in part, in training order."""
    return repeat_documents(docs, int(spark.conf.get("spark.sql.shuffle.partitions")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents, in sequences of at most 4096 tokens."""
    return pack_documents(docs, vocabulary(WORD_VOCABULARY), capacity=4096, end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can't train a model, hash texts to fingerprints or pack windows; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
