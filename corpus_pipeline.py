"""A corpus from raw documents to packed sequences: stages of the operators in graphloom/llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, jaccard_join, packing, pseudonyms, quality, runtime


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the trees reject go."""
    return quality.kept_rows(docs, quality.fit(docs, runtime.table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest doc_id stays."""
    return jaccard_join.one_of_each(docs)


def benchmark_overlaps(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    return decontaminate.without_overlaps(docs, runtime.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers, dates, addresses and tokens become pseudonyms, by the key in spark.graphloom.pseudonymKey (without one a warning, and the example's key)."""
    return pseudonyms.pseudonymised(docs, pseudonyms.key_or_example(spark))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of at most 4096 tokens: a row for each piece."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_overlaps", benchmark_overlaps),
    ("personal_data", personal_data),
    ("sequences", sequences),
]
#: The trees of the first stage are no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written as Parquet and read again as the next one's docs."""
    docs = runtime.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = runtime.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
