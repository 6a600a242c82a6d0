"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing, packing.

Each stage takes all that the one before it kept, written to the shared folder
and read again. All but the last return the columns of ``documents``; a document
that the mix takes twice is two rows there, and is packed twice.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankframe.llm import exact_dedup, mixing, near_dedup, packing, quality
from rankframe.llm.common import documents, settled
from rankframe.llm.queries import word_tokenizer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or lie far out in their language and source go."""
    return quality.without_outliers(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the smallest doc_id stays."""
    return near_dedup.without_near_duplicates(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it."""
    return mixing.mixed(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.packed_documents(docs, word_tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]
# SQL expresses neither the outlier estimate nor signatures and packing: see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
