"""Spelling variants: words one edit apart, found by scans of the sorted vocabulary.

A scan walks down the sorted words with one banded edit-matrix row a character. The rows of a prefix
that the next word shares (the adjacent LCP) are kept, and where a row holds no cell below two, all
words with that prefix are passed over. The vocabulary lies in bounded chunks, once sorted from the
front and once from the back: two words one edit apart share the first half of either or the rest of it,
so that a word scans one chunk of each order, or those few its half reaches into.
"""

from __future__ import annotations

import bisect
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fillwise.llm.common import forget, stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words are shorter than that by no code point, and occur at least so often.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One in so many (document, word) loses a letter, as planted misspellings.
TYPO_ONE_IN = 97
#: Distinct words a task counts before it sends them on.
HELD_WORDS = 200_000
#: Code points of the words of one chunk of the sorted vocabulary, and queries scanned at a time.
CHUNK_CHARS, SCAN_QUERIES = 500_000, 20_000


def misspelt(doc: str, counts: dict[str, int]):
    """(word, count) of a document's lower-cased runs; of some, by a hash of document and run, one letter is left out."""
    start = zlib.crc32(f"{doc}:".encode())
    for run, n in counts.items():
        h = zlib.crc32(run.encode(), start)
        if h % TYPO_ONE_IN == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        if len(run) >= LEAST_LENGTH:
            yield run, n


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n of the vocabulary of `docs` (doc_id, text). Null texts have no words; a null id counts as ''."""

    def run(batches):
        held: dict[str, int] = {}

        def table():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts: dict[str, int] = {}
                for word in RUN.findall(text.encode().translate(LOWER).decode()):
                    counts[word] = counts.get(word, 0) + 1
                for word, n in misspelt(doc, counts):
                    held[word] = held.get(word, 0) + n
                if len(held) > HELD_WORDS:
                    yield table()
                    held.clear()
        yield table()

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.col("text").cast("string").alias("text"))
    found = texts.filter("text is not null").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words in a row, the first of each word, and lengths."""
    length = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum(length)[:-1]]) if len(words) else length, length


class SortedWords:
    """Sorted distinct words, LCPs of neighbours, and for each the next place with a lesser LCP."""

    def __init__(self, words: list[str]):
        self.words = words
        self.codes, self.first, self.length = _codes(words)
        n = len(words)
        self.lcp = np.zeros(n + 1, np.int64)
        self.lcp[0] = self.lcp[n] = -1
        pairs, depth = np.arange(1, n), 0
        while len(pairs):
            pairs = pairs[(self.length[pairs] > depth) & (self.length[pairs - 1] > depth)]
            pairs = pairs[self.codes[self.first[pairs] + depth] == self.codes[self.first[pairs - 1] + depth]]
            depth += 1
            self.lcp[pairs] = depth
        self.next = np.full(n + 1, n, np.int64)
        waiting: list[int] = []
        for i, x in enumerate(self.lcp.tolist()):
            while waiting and waiting[-1][1] > x:
                self.next[waiting.pop()[0]] = i
            waiting.append((i, x))

    def near(self, queries: list[str], shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word) one edit apart that have the query's first `shared` code points in common.

        All queries go down the list in step. A row holds the edits between the word's first e code
        points and the query's first e - 1, e and e + 1; two stands for two or more.
        """
        codes, first, size = _codes(queries)
        place = np.array([bisect.bisect_left(self.words, w[:k]) for w, k in zip(queries, shared.tolist())], np.int64)
        base = np.concatenate([[0], np.cumsum(size - shared + 3)])
        rows = np.empty((base[-1], 3), np.int8)
        rows[base[:-1]] = (1, 0, 1)
        base = base[:-1] - shared
        inside = [i < len(self.words) and self.words[i].startswith(w[:k]) for i, w, k in zip(place.tolist(), queries, shared.tolist())]
        q = np.flatnonzero(np.array(inside, bool))
        i, d = place[q], shared[q]
        found = []
        while len(q):
            ends = d == self.length[i]
            if ends.any():
                own, at = q[ends], i[ends]
                over = size[own] - d[ends]
                one = np.abs(over) <= 1
                own, at, over = own[one], at[one], over[one]
                hit = rows[base[own] + d[ends][one], over + 1] == 1
                found.append((own[hit], at[hit]))
            e, m = d + 1, size[q]
            c = self.codes[np.minimum(self.first[i] + d, len(self.codes) - 1)]
            old = rows[base[q] + d].astype(np.int64)
            other = [(c != codes[first[q] + np.minimum(e + o - 1, m - 1)]) for o in (-1, 0, 1)]
            low = np.where(e - 1 <= m, np.minimum(old[:, 0] + other[0], old[:, 1] + 1), 2)
            mid = np.where(e <= m, np.minimum(np.minimum(old[:, 1] + other[1], old[:, 2] + 1), low + 1), 2)
            top = np.where(e + 1 <= m, np.minimum(old[:, 2] + other[2], mid + 1), 2)
            new = np.minimum(np.stack([low, mid, top], axis=1), 2)
            on = ~ends & (new.min(axis=1) <= 1)
            rows[base[q[on]] + e[on]] = new[on]
            # The rest goes on at the next word whose prefix differs where this one ended or failed.
            j = i + 1
            while True:
                far = ~on & ~ends & (self.lcp[j] >= e)
                if not far.any():
                    break
                j = np.where(far, self.next[j], j)
            i, d = np.where(on, i, j), np.where(on, e, self.lcp[j])
            keep = on | (d >= shared[q])
            q, i, d = q[keep], i[keep], d[keep]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def exceeds(prefix: str, word: str) -> bool:
    """Whether no word that begins with `prefix` can be one edit from `word`."""
    row = [0, 1]  # edits between the empty prefix and the first 0 and 1 code points of the word
    low = 0
    for d, c in enumerate(prefix, 1):
        new, lowest = [], max(0, d - 1)
        for j in range(lowest, min(len(word), d + 1) + 1):
            options = [2]
            if low <= j < low + len(row):
                options.append(row[j - low] + 1)
            if j and low <= j - 1 < low + len(row):
                options.append(row[j - 1 - low] + (word[j - 1] != c))
            if new:
                options.append(new[-1] + 1)
            new.append(min(options))
        if not new or min(new) > 1:
            return True
        row, low = new, lowest
    return False


def near_words(vocabulary: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """word, n_near and `best` (minus the n and the word of the most frequent near word) of words with a near word.

    `vocabulary` has distinct words of two code points or more with their n, stored. Its chunks are
    ranges of the sorted words, cut by Spark; only their borders, one row for `chunk_chars` code points,
    reach the driver. A word is sent to the chunks that its half reaches into and whose common prefix
    leaves it a chance. Tasks hold one chunk and a batch of words, and give one row a word and chunk, not pairs.
    """
    chars = vocabulary.agg(F.sum(F.length("word"))).first()[0] or 0
    parts = []
    for backwards in (False, True):
        key = F.reverse("word") if backwards else F.col("word")
        words = vocabulary.select(key.alias("key"), "n").repartitionByRange(1 + chars // chunk_chars, "key")
        words = stored(words.withColumn("chunk", F.spark_partition_id()), "words")
        borders = words.groupBy("chunk").agg(F.min("key").alias("low"), F.max("key").alias("high")).orderBy("low").collect()
        parts.append(_scanned(words, [tuple(r) for r in borders], backwards))
    both = parts[0].unionByName(parts[1])
    return both.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _halves(size: int, backwards: bool) -> int:
    """How many code points a word shares, in reading order, with the near words of this scan."""
    return size - size // 2 if backwards else size // 2


def _scanned(words: DataFrame, borders: list[tuple], backwards: bool) -> DataFrame:
    chunks, lows, highs = ([b[i] for b in borders] for i in range(3))
    # What all words of a chunk have in common: the prefix that its first and last word share.
    common = [a[: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))] for a, b in zip(lows, highs)]

    def route(batches):
        for batch in batches:
            to, keys = [], []
            for word in batch.column(0).to_pylist():
                half = word[: _halves(len(word), backwards)]
                first, last = bisect.bisect_left(highs, half), bisect.bisect_right(lows, half + "\U0010ffff")
                for i in range(first, last):
                    if last - first == 1 or not exceeds(common[i], word):
                        to.append(chunks[i])
                        keys.append(word)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(keys, pa.string())], names=["chunk", "key"])

    def answers(held: SortedWords, counts: list[int], queries: list[str]):
        shared = np.array([_halves(len(w), backwards) for w in queries], np.int64)
        near: dict[int, int] = {}
        best: dict[int, tuple] = {}
        for q, i in zip(*(x.tolist() for x in held.near(queries, shared))):
            word, other = queries[q], held.words[i]
            if backwards:
                word, other = word[::-1], other[::-1]
                half = len(word) // 2
                if other[:half] == word[:half]:
                    continue  # found from the front
            near[q] = near.get(q, 0) + 1
            mark = (-counts[i], other)
            if q not in best or mark < best[q]:
                best[q] = mark
        own = list(near)
        return pa.RecordBatch.from_arrays(
            [pa.array([queries[q][::-1] if backwards else queries[q] for q in own], pa.string()), pa.array([near[q] for q in own], pa.int64()),
             pa.array([best[q][0] for q in own], pa.int64()), pa.array([best[q][1] for q in own], pa.string())],
            names=["word", "n_near", "rank", "other"])

    def scan(batches):
        chunk, listed, counts, held, queries = None, [], [], None, []
        for batch in itertools.chain(batches, [None]):
            rows = [] if batch is None else zip(*(c.to_pylist() for c in batch.columns))
            for at, asked, key, n in rows:
                if at != chunk:
                    if queries:
                        yield answers(held, counts, queries)
                    chunk, listed, counts, held, queries = at, [], [], None, []
                if not asked:
                    listed.append(key)
                    counts.append(n)
                    continue
                if held is None:
                    held = SortedWords(listed)
                queries.append(key)
                if len(queries) >= SCAN_QUERIES:
                    yield answers(held, counts, queries)
                    queries = []
        if queries:
            yield answers(held, counts, queries)

    asked = words.select("key").mapInArrow(route, "chunk int, key string").withColumn("n", F.lit(0).cast("long"))
    rows = words.select("chunk", F.lit(0).alias("asked"), "key", "n").unionByName(asked.select("chunk", F.lit(1).alias("asked"), "key", "n"))
    rows = rows.repartition("chunk").sortWithinPartitions("chunk", "asked", "key")
    found = rows.mapInArrow(scan, "word string, n_near long, rank long, other string")
    return found.select("word", "n_near", F.struct("rank", "other").alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """word and root of every word of `forms` (word, form): the word at which following forms ends.

    A form is at least twice as frequent as its word, so chains have the logarithm of the largest n at
    most, and each round of joins halves them.
    """
    steps = stored(forms.select("word", F.col("form").alias("root")), "steps")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "steps")
        done = moved.filter("next is not null").isEmpty()
        forget(steps)
        steps = moved.select("word", "root")
        if done:
            return steps


def spelling_groups(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the texts.

    Words are runs of letters, A-Z lower-cased, with planted misspellings (see `misspelt`), of at least
    LEAST_LENGTH code points and LEAST_COUNT occurrences. Near words differ by one code point inserted,
    deleted or replaced. A word's form is its near word of largest n (of equals the least), if
    that is at least twice the word's own; root follows forms to the last. Null texts have no words,
    empty tables no rows, repeated rows count each; other columns do not matter.
    """
    vocabulary = stored(word_counts(docs), "vocabulary")
    near = near_words(vocabulary)
    rows = vocabulary.join(near, "word", "left").withColumn("largest", -F.col("best.rank"))
    twice = F.col("largest") >= 2 * F.col("n")
    rows = stored(rows.select(
        "word", F.when(twice, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(twice, F.col("largest")).alias("form_n")), "forms")
    roots = last_forms(rows.filter("form is not null"))
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
