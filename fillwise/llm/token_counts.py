"""Token counts from a digest cache: only texts never counted before are encoded."""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fillwise.llm.common import chunks_by_size, stored, worker_state
from fillwise.llm.pretokens import CHUNK_CHARS, class_table, library_encoder, load

CACHE = T.StructType([
    T.StructField("content", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("tokenizer", T.StringType()),
])


def tokenizer_digest(path: str) -> str:
    """Names a tokenizer's version: its file's bytes and the library that reads it."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as file:
        return hashlib.sha256(f"{library.__name__} {library.__version__}\n".encode() + file.read()).hexdigest()


def _counter(path: str, classes: bytes):
    if path.endswith(".model"):
        def pieces():
            from sentencepiece import SentencePieceProcessor

            return SentencePieceProcessor(model_file=path)

        model = worker_state(("pieces", path), pieces)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    encoder = library_encoder(path, classes)
    return lambda texts: [len(x) // 4 for x in encoder.ids(texts)]


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _cached(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """The stored counts of one tokenizer version; a digest that two runs stored at once counts once."""
    if not _exists(spark, cache):
        return spark.createDataFrame([], CACHE).select("content", "n_tokens")
    kept = spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == tokenizer)
    return kept.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, cache: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (UTF-8) and n_tokens of every whole text, in any order, one row for each input row.

    `path` is a tokenizers file (.json) or a sentencepiece model (.model), readable on every machine;
    texts get no begin, end or padding and are not cut. Null texts count as empty, null and repeated
    keys are kept as they are. `cache` is a folder of Parquet files in shared storage: counts by
    SHA-256 of the text and digest of the tokenizer. Texts not found there are encoded once for all
    their copies, and their counts appended. The folder may be new.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(path)
    classes = b"" if path.endswith(".model") else class_table(load(path))
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("content", F.unhex(F.sha2("text", 256)))
    rows = stored(texts.select("key", F.octet_length("text").cast("long").alias("n_bytes"), "content"), "digests")

    # One row stands for all copies of a text; only digests are grouped, so a hot text costs a row a task.
    chosen = rows.groupBy("content").agg(F.min("key").alias("key"))
    chosen = chosen.join(_cached(spark, cache, version), "content", "left_anti")
    same = texts["key"].eqNullSafe(chosen["key"]) & (texts["content"] == chosen["content"])
    misses = texts.join(chosen.hint("shuffle_hash"), same, "left_semi").select("content", "text")

    def encode(batches):
        count = _counter(path, classes)
        for batch in batches:
            values = batch.column("text").to_pylist()
            for a, b in chunks_by_size([len(v) for v in values], CHUNK_CHARS):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("content").slice(a, b - a), pa.array(count(values[a:b]), pa.int64())], names=["content", "n_tokens"])

    counted = misses.mapInArrow(encode, T.StructType(CACHE.fields[:2])).withColumn("tokenizer", F.lit(version))
    counted.write.mode("append").partitionBy("tokenizer").parquet(cache)
    return (
        rows.join(_cached(spark, cache, version), "content", "left")
        .select(F.col("key").alias(key), "n_bytes", "n_tokens")
    )
