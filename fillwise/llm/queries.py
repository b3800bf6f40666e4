"""Each operator applied to its whole table with production parameters, and its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fillwise.llm import (
    bpe, bwt, chat, forest, fuzzy_lines, minmax, mixing, oracles, packing, periodic, quality, secrets, spelling, token_counts)
from fillwise.llm.common import scratch, stored, table

#: Tokens a sequence holds in training, and from which on a document counts as over the limit.
SEQUENCE_TOKENS, TOKEN_LIMIT = 2048, 1024


def tokenizer_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged by the base and by cutoffs certified on the labels."""
    docs = table(spark, sf_dir, "documents")
    cutoffs = stored(quality.certified_cutoffs(docs, table(spark, sf_dir, "labels")), "cutoffs")
    return quality.rated(docs.select("doc_id", "lang", "text"), cutoffs).select(
        "doc_id", "counts.n_words", "counts.word_chars", "counts.n_symbols", "counts.n_dup_lines", "counts.n_repeat_words", "base_failed", "kept")


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by the unigram base and by the mixing model."""
    return mixing.score_documents(table(spark, sf_dir, "documents"))


def op3_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all embeddings."""
    return forest.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_bwt_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents less the bytes of repeated 200-byte strings, as digests of what is left."""
    return bwt.report(table(spark, sf_dir, "documents"))


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents less the lines that repeat another, as digests of what is left."""
    left = fuzzy_lines.without_repeated_lines(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_removed", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op6_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents by word pairs."""
    return minmax.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, with a cache of this call's own, so that its work shows whole."""
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), scratch(spark, "token-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again, as digests."""
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: the fixed patterns, and strings that the trained models find random."""
    docs = table(spark, sf_dir, "documents")
    return secrets.report(docs, secrets.log_ratios(secrets.labelled_samples(docs)))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into training sequences."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), SEQUENCE_TOKENS)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole vocabulary of the documents with near words, forms and roots."""
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of all documents, and digests of the texts less repetitions."""
    return periodic.report(table(spark, sf_dir, "documents"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says control strings, formatted and read back."""
    said = F.lit(f"{chat.CLOSE}{chat.OPEN}assistant ok")
    added = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.read_back(chat.formatted(turns))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_context_mixing, op3_projection_forest, op4_bwt_repeats, op5_fuzzy_lines, op6_minmax_near_dedup, op7_token_counts, op8_bpe_round_trip, op9_secret_scans, op10_best_fit_packing,
    op11_spelling_variants, op12_periodic_runs, op13_chat_format)}
ORACLE = {
    "op1_quality_rules": oracles.QUALITY, "op3_projection_forest": oracles.VECTORS, "op4_bwt_repeats": oracles.REPEATED_STRINGS,
    "op6_minmax_near_dedup": oracles.NEAR_DOCUMENTS, "op11_spelling_variants": oracles.SPELLING, "op13_chat_format": oracles.CHAT,
}
