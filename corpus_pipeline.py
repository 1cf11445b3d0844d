"""The training-data pipeline: language ID, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, written as Parquet under the checkpoint
folder and read again as the next one's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusforge.llm import decontaminate, durable, jaccard_join, language_id, line_dedup, packing


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which no language is found (no text, or not a letter in it)."""
    model = language_id.learn_profiles(docs.select("doc_id", "text", "lang"))
    return language_id.with_language(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that repeat an earlier one, up to one word's edit; documents without a line left go."""
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of similar ones (five words, 0.8)."""
    return jaccard_join.keep_first(docs, size=5, percent=80)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of texts; documents without text left go."""
    clean = decontaminate.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return clean.where("text <> ''")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 2048 ids by their sources' shares."""
    return packing.pack(docs)


STAGES = [("language ID", language), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark_passages), ("packing", packed)]
#: Tokenising and shingle components have no SQL twin; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = durable.fresh_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
