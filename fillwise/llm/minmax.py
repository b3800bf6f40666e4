"""Near-duplicate documents by min-max hashing.

Each permutation of the shingle hashes gives two signature values, its least and its greatest. Both
are unbiased: either agrees in two sets with the chance of their Jaccard similarity. So half the
permutations do, and since the two ends vary against each other the estimate varies less.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from fillwise.llm.common import WORD, chunks_by_size, stored
from fillwise.llm.hashing import band_keys, permutations, shingle_sets
from fillwise.llm.linking import resolve

#: 40 permutations give 80 values, 20 bands of 4: a pair at similarity 0.8 is missed 3 times in 100,000.
PERMUTATIONS, BAND_ROWS = 40, 4
#: Permutations of the longer signature of documents in mixed buckets: its 1024 values tell the similarity to 0.0125.
LONG_PERMUTATIONS = 512
CHUNK_BYTES = 200_000
SETS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("id", T.BinaryType()),
    T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("text_hash", T.LongType()),
])


def signatures(sets: list[np.ndarray], count: int = PERMUTATIONS) -> np.ndarray:
    """Least and greatest value of each nonempty set under each permutation, side by side."""
    factors, offsets = permutations(count, np.uint64)
    flat = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    values = np.empty((len(sets), 2 * count), np.uint64)
    for i in range(count):
        moved = flat * factors[i] + offsets[i]
        values[:, 2 * i] = np.minimum.reduceat(moved, first)
        values[:, 2 * i + 1] = np.maximum.reduceat(moved, first)
    return values


def shingled(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, id (a 128-bit digest of the shingle set, null if empty), band keys and a hash of the text.

    Equal sets have one id. A task gives the keys of an id only with the first document that has it.
    """

    def run(batches):
        given: set[bytes] = set()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = [(t or "").encode().lower() for t in batch.column("text").to_pylist()]  # bytes: A-Z only
            for a, b in chunks_by_size([len(t) for t in texts], CHUNK_BYTES):
                sets = shingle_sets(texts[a:b], width)
                names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                if len(given) > 300_000:
                    given.clear()
                keys: list = [None] * len(sets)
                new = []
                for i, name in enumerate(names):
                    if name is not None and name not in given:
                        given.add(name)
                        new.append(i)
                if new:
                    for i, row in zip(new, band_keys(signatures([sets[i] for i in new]), BAND_ROWS).tolist()):
                        keys[i] = row
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()),
                     pa.array(keys, pa.list_(pa.int64())), batch.column("text_hash").slice(a, b - a)], names=SETS.names)

    return numbered(docs).mapInArrow(run, SETS)


def numbered(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("text_hash", F.xxhash64("text"))


def long_signatures(width: int):
    """8 bits of each value of the longer signature, of texts that have words."""

    def sign(texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for a, b in chunks_by_size([len(t) for t in texts], CHUNK_BYTES // 2):
            sets = shingle_sets([t.encode().lower() for t in texts[a:b]], width)
            out += list((signatures(sets, LONG_PERMUTATIONS) >> np.uint64(24)).astype(np.uint8))
        return out

    return sign


def hashed_sets(width: int):
    return lambda texts: shingle_sets([(t or "").encode().lower() for t in texts], width)


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    A document's set are the distinct shingles of `width` words of its lower-cased (A-Z) text, or
    all its words as one. Documents are linked if their sets' Jaccard similarity is `percent` in a
    hundred or more; candidates come from min-max signatures, and every link is confirmed on the full
    sets, a shingle being its 64-bit hash. component_id is the least doc_id reachable, itself included; kept says whether
    that is the row's own. Null and blank texts have no set and are linked with nothing. Rows
    without doc_id are compared with nothing: component_id null, kept true. Rows that share a doc_id
    are judged each by its own text.
    """
    rows, components = _sets_and_components(docs, width, percent)
    return labelled(rows, components)


def _sets_and_components(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    rows = stored(shingled(docs, width), "signatures")
    named = rows.filter("doc_id is not null and id is not null")
    keys = named.filter("keys is not null").select(F.explode("keys").alias("key"), "id", F.col("n_shingles").alias("size"))
    first = named.groupBy("id").agg(F.min(F.struct("doc_id", "text_hash")).alias("row")).select("id", "row.*")

    def values_of(ids: DataFrame) -> DataFrame:
        chosen = first.join(ids, "id")
        found = numbered(docs).join(chosen.hint("shuffle_hash"), ["doc_id", "text_hash"])
        return found.select("id", F.col("text").alias("value"))

    return rows, resolve(keys, values_of, long_signatures(width), hashed_sets(width), percent)


def deduplicated(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, of which near_duplicates() leaves one a group: the least doc_id, then text hash.

    Of rows that agree in doc_id and text one stays. Rows without words or without doc_id all stay.
    """
    rows, components = _sets_and_components(docs, width, percent)
    named = rows.filter("doc_id is not null and id is not null").select("doc_id", "text_hash", "id")
    named = named.join(components.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    place = F.struct("doc_id", "text_hash")
    stays = named.groupBy("component").agg(F.min(place).alias("first"))
    gone = named.join(stays, "component").filter(place != F.col("first")).select(
        F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), F.lit(True).alias("__gone")).distinct()
    text = F.col("text").cast("string")
    marked = docs.withColumns({"__doc": F.col("doc_id").cast("long"), "__hash": F.xxhash64(text)})
    left = marked.join(gone.hint("shuffle_hash"), ["__doc", "__hash"], "left").filter("__gone is null")
    copy = F.row_number().over(Window.partitionBy("__doc", "__hash").orderBy("__doc"))
    free = F.col("__doc").isNull() | ~F.coalesce(text, F.lit("")).rlike(WORD)
    return left.withColumn("__copy", copy).filter((F.col("__copy") == 1) | free).select(*docs.columns)


def labelled(rows: DataFrame, components: DataFrame) -> DataFrame:
    """The result rows from sets (doc_id, n_shingles, id) and components of set ids."""
    owned = rows.select("doc_id", "n_shingles", "id").join(components.withColumnRenamed("node", "id"), "id", "left")
    owned = owned.withColumn("component", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id")))
    least = owned.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = owned.join(least, "component", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
