"""A corpus pipeline of five stages over the table of documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. run() writes each stage's result to the
shared folder and reads it back as the next one's input; then it deletes what
the stage's operators wrote for themselves, and the input of the stage before,
but nothing that others wrote. Between stages only narrow tables are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import langid, mixing, simhash, suffix_dedup
from vecspark.llm.common import new_path, read_documents, remove, scratch
from vecspark.llm.queries import bpe_digests

#: Documents whose language is less certain than this go.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is determined. The model learns from this stage's input; held-out rows are left out."""
    model = langid.train(docs, ~langid.held_out())
    return langid.confident(docs, model, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each near-duplicate component.

    The links are op10's: 4-word SimHashes at 4 bits or fewer, so many near copies of a Jaccard of 0.8 to 0.95 stay.
    """
    return simhash.one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out of every text the 50-byte strings that start in an earlier document; n_chars follows the text."""
    return suffix_dedup.deduplicated(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents by their sources' target weights."""
    return mixing.mixed_rows(docs)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text, a row for each document of the mix."""
    return bpe_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("suffix_array_dedup", suffix_array_dedup),
    ("source_mixing", source_mixing),
    ("bpe_round_trip", bpe_round_trip),
]

#: SimHash, suffix arrays and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs, before = read_documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
