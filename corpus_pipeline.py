"""Text pipeline over ``documents``: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tableloom.llm import decontaminate, exact_dedup, jaccard_join, language, packing, plans
from tableloom.llm.common import shared_folder


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language go: null and empty texts and those without a letter, however long.

    The model learns from labelled documents; without any, a letter is enough to stay. Ties, repeated rows and null identifiers change
    nothing; other columns are kept; an empty table gives an empty result.
    """
    return language.keep_identified(docs, plans.language_model(docs))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, that with the largest doc_id.

    Null texts count as empty; null identifiers lose to others, and of rows equal in identifier and text one stays; other columns are
    kept; an empty table gives an empty result.
    """
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of linked documents stays, that with the smallest doc_id (nulls last).

    Null and empty texts have no links and stay; rows with one identifier, or none, are told apart; other columns are kept; an empty table
    gives an empty result.
    """
    return jaccard_join.keep_one_row(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item occurs go, each by its own text.

    Null and empty texts stay; without items all do; other columns are kept; an empty table gives an empty result.
    """
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences of at most 2048 tokens: a row per piece.

    Null texts are empty (one end mark); null and repeated identifiers are packed like others; only the columns of the packing are
    returned; an empty table gives an empty result.
    """
    return packing.pack(docs, plans.tokenizer_file())


STAGES = [
    ("language ID", language_stage), ("exact dedup", exact_stage), ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", benchmark_stage), ("best-fit packing", packing_stage),
]

#: The classifier of the first stage and the tokenizer of the last cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each stored as Parquet and read again."""
    folder = shared_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
