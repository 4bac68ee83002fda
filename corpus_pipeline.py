"""From raw documents to a training mix: five stages, each written as Parquet and read again.

Every stage works on all documents that its predecessor kept and, but for the last, returns the columns of documents.
The last returns the mix: the same columns, and how many times the mix takes each document.

Defined results, for all stages: other columns, of whatever name, pass through; ids may repeat or be null; rows that
repeat are judged alike (the third stage keeps one of them); very long texts are taken whole; no rows give no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, decontaminate, language_id, line_dedup, mixing, near_dedup

#: SQL can't express the first and third stage.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models recognise; those they reject go, as do null texts and those without a letter."""
    return language_id.keep_recognised(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Duplicate lines go from the texts, and documents that thereby lose their last word; n_chars follows the text.

    Documents that lose nothing stay as they are, be their text null or empty.
    """
    kept = line_dedup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the least id. Texts without a word have no duplicates."""
    return near_dedup.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; a null text holds none, an empty benchmark has none."""
    return decontaminate.decontaminate(docs, common.read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often (times); a null source is a source of its own."""
    return mixing.take_mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near_duplicates", near_stage),
    ("benchmark", benchmark_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
