"""The queries of the corpus operators, over their whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import bpe, langid, lsh_forest, mixing, oracle, quality, sharding, simhash, suffix_dedup, token_files, trie_counts
from vecspark.llm.common import read_documents


def word_bpe() -> str:
    """The installed word-level BPE file."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def piece_bpe() -> str:
    """The installed sentencepiece file."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.tokens_written(read_documents(spark, sf_dir), word_bpe())


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(read_documents(spark, sf_dir))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Encoded and decoded again: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.round_trip(docs.select("doc_id", "text"), word_bpe(), keep=["doc_id"]).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read_documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(read_documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = langid.train(docs, ~langid.held_out())
    marked = docs.select("doc_id", "text", langid.held_out().alias("held_out"))
    return langid.identify(marked, model, keep=["doc_id", "held_out"])


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.decisions(read_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    return trie_counts.token_counts(docs, trie_counts.vocabulary(piece_bpe()), keep=["doc_id"])


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_records(read_documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_files,
        op2_suffix_dedup,
        op3_nearest_neighbours,
        op4_bpe_round_trip,
        op5_quality_rules,
        op6_language_id,
        op7_source_mixing,
        op8_token_counts,
        op9_sharding,
        op10_simhash,
    )
}
ORACLES: dict[str, str] = oracle.SQL
