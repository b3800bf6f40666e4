"""Fuzzy line dedup: MinHash of character shingles, banding, exact Jaccard, union-find, one line a group."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fillwise.llm.common import WORD, chunks_by_size, forget, let, stored
from fillwise.llm.hashing import mix, permutations
from fillwise.llm.linking import resolve

#: Characters of a shingle. A changed character inside a line of n takes `width` shingles of either set, so 0.8 is
#: kept from 10 * width - 1 characters on: 39 for short lines, 79 for long ones, whose sets narrow shingles would fill up.
SHORT_WIDTH, LONG_WIDTH = 4, 8
#: Lines of fewer than SHORT_BELOW characters are compared by short shingles, those of LONG_FROM or more by long ones, those between by both.
SHORT_BELOW, LONG_FROM = 100, 80
#: A line is a node under its own hash for the long comparison, and under this turned one for the short comparison.
TURN = 0x5DEECE66D1B2C3A5
#: 40 MinHash values in 10 bands of 4: a pair at similarity 0.8 is missed 5 times in 1,000, at 0.9 twice in 100,000.
VALUES, BAND_ROWS = 40, 4
#: Values of the longer signature of lines in mixed buckets.
LONG_VALUES = 1024
CHUNK_CHARS = 60_000
#: Characters of one line that are hashed at a time.
SLICE_CHARS = 1_000_000
HAS_WORD = re.compile(WORD).search
_BASE = 0x9E3779B97F4A7C15


def hashed(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all character shingles of the lines, and the first and the end of each line's own.

    Between two lines lie numbers of shingles that reach over both; they belong to none. A line
    shorter than a shingle is one shingle, filled up with a sign that no text holds.
    """
    sizes = np.array([max(len(x), width) for x in lines], np.int64)
    filled = [x if len(x) >= width else x + "\U0010ffff" * (width - len(x)) for x in lines]
    signs = np.frombuffer("".join(filled).encode("utf-32-le"), np.uint32).astype(np.uint64)
    rolled, power, step = signs, _BASE, 1
    while 2 * step <= width:
        rolled = rolled[:-step] + rolled[step:] * np.uint64(power)
        power, step = power * power % 2**64, 2 * step
    while step < width:
        rolled = rolled[:-1] + signs[step:] * np.uint64(power)
        power, step = power * _BASE % 2**64, step + 1
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return rolled, first, first + sizes - width + 1


def signatures(lines: list[str], width: int, count: int = VALUES) -> np.ndarray:
    """MinHash values of the character shingles of each line. A very long line is hashed slice by slice."""
    if len(lines) > 1 or len(lines[0]) <= SLICE_CHARS:
        return _signed(lines, width, count)
    starts = range(0, len(lines[0]) - width + 1, SLICE_CHARS)
    return np.minimum.reduce([_signed([lines[0][i : i + SLICE_CHARS + width - 1]], width, count) for i in starts])


def _signed(lines: list[str], width: int, count: int) -> np.ndarray:
    factors, _ = permutations(count, np.uint32)  # of hashes, so that no offsets are needed
    rolled, first, end = hashed(lines, width)
    hashes = (((rolled ^ (rolled >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
    edges = np.stack([first, end], axis=1).ravel()[:-1]
    out, moved = np.empty((len(lines), count), np.uint32), np.empty_like(hashes)
    for i in range(count):
        np.multiply(hashes, factors[i], out=moved)
        out[:, i] = np.minimum.reduceat(moved, edges)[::2]
    return out


def line_keys(lines: list[str], width: int) -> np.ndarray:
    """A key for each band of each line's signature; bands and widths share none on purpose."""
    out = [np.empty((0, VALUES // BAND_ROWS), np.int64)]
    for a, b in chunks_by_size([len(x) for x in lines], CHUNK_CHARS):
        values = signatures(lines[a:b], width).reshape(b - a, -1, BAND_ROWS).astype(np.uint64)
        key = np.arange(values.shape[1], dtype=np.uint64) * np.uint64(16) + np.uint64(width)
        for r in range(BAND_ROWS):
            key = key * np.uint64(_BASE) + values[:, :, r]
        out.append(mix(key).view(np.int64))
    return np.concatenate(out)


def _by_width(values: list[str], make: Callable[[list[str], int], list]) -> list:
    """What `make` gives for values, which are a sign of their width (s, l) and a line."""
    out: list = [None] * len(values)
    for sign, width in (("s", SHORT_WIDTH), ("l", LONG_WIDTH)):
        own = [i for i, x in enumerate(values) if x[0] == sign]
        for i, made in zip(own, make([values[i][1:] for i in own], width)):
            out[i] = made
    return out


def long_signatures(values: list[str]) -> list[np.ndarray]:
    """8 bits of each number of the longer signature."""

    def make(lines: list[str], width: int) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for a, b in chunks_by_size([len(x) for x in lines], CHUNK_CHARS):
            out += list((signatures(lines[a:b], width, LONG_VALUES) >> np.uint32(4)).astype(np.uint8))
        return out

    return _by_width(values, make)


def distinct(numbers: np.ndarray) -> np.ndarray:
    """np.unique without its general part, which takes longer than the work on a short line."""
    ordered = np.sort(numbers)
    keep = np.empty(len(ordered), bool)
    keep[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=keep[1:])
    return ordered[keep]


def shingles(values: list[str]) -> list[np.ndarray]:
    """Of each line its distinct shingles, as sorted hashes."""

    def make(lines: list[str], width: int) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for a, b in chunks_by_size([len(x) for x in lines], CHUNK_CHARS):
            numbers, first, end = hashed(lines[a:b], width)
            out += [distinct(numbers[i:j]) for i, j in zip(first.tolist(), end.tolist())]
        return out

    return _by_width(values, make)


LINES = ("doc", "hash", "numbers", "ids", "short_keys", "short_nodes", "long_keys", "long_nodes")


def numbered(docs: DataFrame) -> DataFrame:
    """The key of a document, its number and a hash of its text, and its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64(text).alias("hash"), text.alias("text"))


def line_table(docs: DataFrame) -> DataFrame:
    """doc, hash, the numbers (from 0) and ids of its lines with a word, and band keys with their nodes, by width.

    An id is the line's 64-bit hash, as xxhash64() gives it. A task gives a line's keys once in a stretch.
    """

    def run(batches):
        from xxhash import xxh64_intdigest

        given: set[int] = set()
        for batch in batches:
            texts = [t.split("\n") for t in batch.column("text").to_pylist()]
            if len(given) > 1_000_000:
                given.clear()
            numbers = [[i for i, x in enumerate(lines) if x and HAS_WORD(x)] for lines in texts]
            ids: list[list[int]] = []
            fresh = {SHORT_WIDTH: ([], [], []), LONG_WIDTH: ([], [], [])}  # row, node and line of each line not given before
            for row, (lines, own) in enumerate(zip(texts, numbers)):
                names = [xxh64_intdigest(lines[i].encode(), 42) for i in own]
                names = [x - 2**64 if x >= 2**63 else x for x in names]
                ids.append(names)
                for i, name in zip(own, names):
                    if name in given:
                        continue
                    given.add(name)
                    for width, node, used in ((SHORT_WIDTH, name ^ TURN, len(lines[i]) < SHORT_BELOW), (LONG_WIDTH, name, len(lines[i]) >= LONG_FROM)):
                        if used:
                            for held, x in zip(fresh[width], (row, node, lines[i])):
                                held.append(x)
            columns = [batch.column("doc"), batch.column("hash"), pa.array(numbers, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.int64()))]
            for width, (rows, nodes, lines) in fresh.items():
                keys = line_keys(lines, width)
                offsets = pa.array((np.searchsorted(np.array(rows, np.int64), np.arange(len(texts) + 1)) * keys.shape[1]).astype(np.int32))
                columns += [pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in (keys, np.repeat(np.array(nodes, np.int64), keys.shape[1]))]
            yield pa.RecordBatch.from_arrays(columns, names=LINES)

    kinds = dict(zip(LINES, ("long", "long", "array<int>", *["array<long>"] * 5)))
    return numbered(docs).mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in kinds.items()))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc, hash, number (from 0), id and line of every line with a word."""
    rows = numbered(docs).select("doc", "hash", F.posexplode(F.split("text", "\n")).alias("number", "line"))
    return rows.filter(F.col("line").rlike(WORD)).withColumn("id", F.xxhash64("line"))


def repeated_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc, hash and `numbers` of the lines to remove, of documents with such lines.

    Lines are linked if the Jaccard similarity of their distinct character shingles is `percent` in a
    hundred or more: of SHORT_WIDTH characters if both are shorter than SHORT_BELOW, of LONG_WIDTH if
    both have LONG_FROM characters or more; either will do for lines that are both. Of each connected group the line with the least (doc_id, text hash, number)
    stays. Equal lines are one node, named by a 64-bit hash; shingles are compared by 64-bit hashes.
    """
    lines = stored(line_table(docs), "lines")
    places = lines.select("doc", "hash", F.inline(F.arrays_zip(F.col("numbers").alias("number"), F.col("ids").alias("id"))))
    pairs = F.concat(*[F.arrays_zip(F.col(f"{w}_keys").alias("key"), F.col(f"{w}_nodes").alias("id")) for w in ("short", "long")])
    keys = lines.select(F.inline(pairs))
    turned = lambda c: F.col(c).bitwiseXOR(F.lit(TURN))

    def values_of(ids: DataFrame) -> DataFrame:
        size, node = F.length("line"), lambda name, sign: F.struct(name.alias("id"), F.concat(F.lit(sign), "line").alias("value"))
        short, long = node(turned("id"), "s"), node(F.col("id"), "l")
        nodes = F.when(size < LONG_FROM, F.array(short)).when(size < SHORT_BELOW, F.array(short, long)).otherwise(F.array(long))
        return lines_of(docs).select(F.inline(nodes)).join(ids.hint("shuffle_hash"), "id", "left_semi").transform(_once)

    def twins(ids: DataFrame) -> DataFrame:
        both = ids.select(F.col("id").alias("a"), turned("id").alias("b"))
        return both.filter("a < b").join(ids.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")

    components = resolve(keys, values_of, long_signatures, shingles, percent, twins)
    named = components.select(F.explode(F.array(F.col("node"), turned("node"))).alias("id"), "component").distinct()  # no line has an id that is none
    nodes = places.groupBy("id").agg(F.count("*").alias("n"), F.min("doc").alias("doc"))
    nodes = nodes.join(named, "id", "left").withColumn("component", F.coalesce("component", "id"))
    nodes = stored(nodes, "nodes")
    groups = nodes.groupBy("component").agg(F.sum("n").alias("n"), F.min("doc").alias("first_doc")).filter("n > 1").drop("n")
    repeated = nodes.select("id", "component").join(groups, "component")
    found = stored(places.join(repeated, "id"), "repeated")
    first = found.filter("doc = first_doc").groupBy("component").agg(F.min(F.struct("hash", "number")).alias("first"))
    removed = found.join(first, "component").filter((F.col("doc") != F.col("first_doc")) | (F.struct("hash", "number") != F.col("first")))
    removed = stored(removed.groupBy("doc", "hash").agg(F.sort_array(F.collect_list("number")).alias("numbers")), "removed")
    forget(lines, nodes, found)
    return removed


def _once(rows: DataFrame) -> DataFrame:
    """Each (id, value) once a task and bounded stretch: what is left of copies does no harm."""

    def run(batches):
        given: set[int] = set()
        for batch in batches:
            ids = batch.column("id").to_pylist()
            if len(given) > 1_000_000:
                given.clear()
            new = []
            for i, x in enumerate(ids):
                if x not in given:
                    given.add(x)
                    new.append(i)
            yield batch.take(pa.array(new, pa.int64()))

    return rows.mapInArrow(run, rows.schema)


def without_repeated_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """All rows of docs in their columns, with `text` less its repeated lines, and `n_removed`.

    Lines are the pieces between \\n. Lines without a word take no part and stay. Null and empty texts
    stay as they are. Rows that agree in doc_id and text count as one document: they lose and keep
    the same lines. n_chars, if there, is counted anew where lines went. A column `n_removed` is replaced.
    """
    removed = repeated_lines(docs, percent).select(F.col("doc").alias("__doc"), F.col("hash").alias("__hash"), F.col("numbers").alias("__numbers"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.drop("n_removed").withColumns({"__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "__hash": F.xxhash64(text)})
    rows = rows.join(removed.hint("shuffle_hash"), ["__doc", "__hash"], "left")
    gone = F.col("__numbers").isNotNull()

    def left(lines: Column) -> Column:
        numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__numbers"))
        return F.array_join(F.transform(numbers, lambda i: F.get(lines, i)), "\n")

    rows = rows.withColumn("text", F.when(gone, let(F.split(text, "\n"), left)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(gone, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    rows = rows.withColumn("n_removed", F.when(gone, F.size("__numbers")).otherwise(0).cast("long"))
    return rows.select(*[c for c in docs.columns if c != "n_removed"], "n_removed")
