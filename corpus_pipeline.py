"""A corpus pipeline: language, near-duplicates, benchmark overlaps, personal data, pieces.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from restartlab.llm import decontaminate, language, near_dup, pieces, pseudonyms
from restartlab.llm.common import stored
from restartlab.llm.queries import KEY, TOKENIZER

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS = 2000  # rows of whole texts that a Python worker and its executor hold at once


def bounded(spark: SparkSession) -> None:
    """Let Arrow batches of texts be small: several workers of several stages stand side by side in an executor."""
    if not 0 < int(spark.conf.get(BATCH)) <= ROWS:  # 0 and less stand for no bound
        spark.conf.set(BATCH, str(ROWS))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, null texts and texts without a likely language go."""
    bounded(spark)
    return language.keep_known(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with 80 % of their five-word shingles in common the one with the smallest id stays."""
    bounded(spark)
    return near_dup.keep_one(docs, shingle=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    bounded(spark)
    return decontaminate.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def with_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values in the texts become pseudonyms; every document stays."""
    return pseudonyms.pseudonymise(docs, KEY)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, pieces, n_pieces, lossless of every document that is left."""
    bounded(spark)
    return pieces.encode(docs, TOKENIZER)


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("personal_data", with_pseudonyms),
    ("sentencepiece", as_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
