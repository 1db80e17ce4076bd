"""The training-data pipeline: toxicity, near-duplicates, benchmark passages, source mix, token files.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import decontamination, mixing, neardup, toxicity
from shelfwise.llm.queries import table, token_rows
from shelfwise.sources.storage import scope, work_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject. It is fitted on the labelled documents of the corpus."""
    chain = toxicity.fit_chain(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, chain)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    return neardup.keep_one(docs, neardup.near_duplicates(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    verdicts = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    return decontamination.clean_documents(docs, verdicts)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them: left out, once or twice."""
    return mixing.apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, read back."""
    return token_rows(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("tokens", tokens),
]

#: SQL cannot express the classifier and the tokenizer; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again; the result of the last.

    Inside a ``scope`` what the stages write goes at its end.
    """
    docs = table(spark, sf_dir, "documents")
    folder = work_folder(spark, "pipeline")
    for name, stage in STAGES:
        with scope(spark):  # what the stage writes on the way goes when its result is written
            result = stage(spark, docs, sf_dir)
            result.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(result.schema).parquet(f"{folder}/{name}")
    return docs
