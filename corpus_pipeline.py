"""A training corpus from raw documents: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fillwise.llm import fuzzy_lines, minmax, packing, quality, secrets
from fillwise.llm.common import WORD, stored, table
from fillwise.llm.queries import SEQUENCE_TOKENS, tokenizer_path


def _own_columns_aside(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The documents with columns that an operator also makes under private names; `_restored` undoes it."""
    return docs.withColumnsRenamed({c: f"__own_{c}" for c in names if c in docs.columns})


def _restored(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the documents, as they were."""
    return rows.select(*[F.col(f"__own_{c}").alias(c) if f"__own_{c}" in rows.columns else F.col(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and the cutoffs certified on the labels of `sf_dir`."""
    cutoffs = stored(quality.certified_cutoffs(docs, table(spark, sf_dir, "labels")), "cutoffs")
    rows = quality.rated(_own_columns_aside(docs, ("counts", "base_failed", "kept")), cutoffs).filter("kept")
    return _restored(rows, docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that repeat another; those that lose every line with a word go."""
    left = fuzzy_lines.without_repeated_lines(_own_columns_aside(docs, ("n_removed",)))
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(WORD)
    return _restored(left.filter(~emptied), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by shingles of five words, similarity 0.8 or more."""
    return minmax.deduplicated(docs, width=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark."""
    return secrets.redacted(docs, secrets.log_ratios(secrets.labelled_samples(docs)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places."""
    return packing.pack_documents(docs, tokenizer_path(), SEQUENCE_TOKENS)


STAGES = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
    ("secret_scans", secret_scans), ("best_fit_packing", best_fit_packing),
]
#: Near-duplicate links and packing are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each result stored for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
