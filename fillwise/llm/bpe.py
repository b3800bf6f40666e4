"""BPE encoding and decoding: batched merge rounds in numpy.

The symbols of many words lie in one flat array. Each round finds the rank of every adjacent pair by
binary search over the sorted pair keys, takes the lowest of each word, and merges it wherever it
stands in that word. A rank only ever merges symbols made by lower ranks (checked when the file is
read), so merging all places of a pair at once equals merging them one after the other.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from fillwise.llm.common import chunks_by_size, worker_state
from fillwise.llm.pretokens import CHUNK_CHARS, Encoder, class_table, cut_by_words, load

#: Rounds are as many as a word has merges; longer words are merged one by one with a heap.
LONG_WORD = 400
NO_RANK = np.int32(2**31 - 1)


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in byte-level vocabularies (fixed by their format)."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """A vocabulary file's merges as sorted arrays, and its tokens' bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if not cut_by_words(spec):
            raise ValueError(f"{path} is no plain byte-level BPE file")
        model, signs = spec["model"], byte_signs()
        vocab = model["vocab"]
        self.of_byte = np.zeros(256, np.int32)
        for sign, byte in signs.items():
            self.of_byte[byte] = vocab[sign]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        born = np.full(max(vocab.values()) + 1, -1, np.int64)
        born[made[::-1]] = np.arange(len(made))[::-1]
        if (born[left] >= np.arange(len(made))).any() or (born[right] >= np.arange(len(made))).any():
            raise ValueError(f"{path} merges symbols before they are made")
        self.base = np.int64(len(born))
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        self.pair = dict(zip(keys.tolist(), range(len(made))))
        tokens = [bytes(signs[c] for c in t) if set(t) <= signs.keys() else t.encode() for t, _ in sorted(vocab.items(), key=lambda x: x[1])]
        ids = sorted(vocab.values())
        self.bytes = [b""] * (max([*ids, *[t["id"] for t in spec["added_tokens"]]]) + 1)
        for i, token in zip(ids, tokens):
            self.bytes[i] = token
        for t in spec["added_tokens"]:
            self.bytes[t["id"]] = t["content"].encode()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Of each word its ids, as little-endian unsigned 32-bit numbers."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        out: list[bytes] = [b""] * len(words)
        for i in np.flatnonzero(sizes > LONG_WORD).tolist():
            out[i] = np.array(self._heap(self.of_byte[np.frombuffer(raw[i], np.uint8)].tolist()), np.uint32).tobytes()
        short = np.flatnonzero((sizes <= LONG_WORD) & (sizes > 0))
        symbols = self.of_byte[np.frombuffer(b"".join([raw[i] for i in short.tolist()]), np.uint8)].astype(np.int64)
        word = np.repeat(np.arange(len(short)), sizes[short])
        done_symbols, done_word = [], []
        while len(symbols):
            rank = np.full(len(symbols), NO_RANK, np.int32)
            inside = np.flatnonzero(word[1:] == word[:-1])
            rank[inside] = self.rank(symbols[inside], symbols[inside + 1])
            first = np.flatnonzero(np.diff(word, prepend=-1))
            lowest = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(word)))
            going = np.repeat(lowest < NO_RANK, length)
            done_symbols.append(symbols[~going])
            done_word.append(word[~going])
            hit = going & (rank == np.repeat(lowest, length))
            at = np.flatnonzero(hit)
            if len(at) and (np.diff(at) == 1).any():  # a run of one sign: take every other place of it
                run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
                place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
                at = at[place % 2 == 0]
            symbols[at] = self.made[rank[at]]
            going[at + 1] = False
            symbols, word = symbols[going], word[going]
        if done_word:
            ids, owner = np.concatenate(done_symbols), np.concatenate(done_word)
            order = np.argsort(owner, kind="stable")
            ends = np.searchsorted(owner[order], np.arange(len(short)), "right").tolist()
            flat = ids[order].astype(np.uint32).tobytes()
            for i, a, b in zip(short.tolist(), [0, *ends], ends):
                out[i] = flat[4 * a : 4 * b]
        return out

    def _heap(self, symbols: list[int]) -> list[int]:
        """One long word: always the lowest rank, the leftmost place of it first."""
        base, pair, made = int(self.base), self.pair, self.made
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def push(i: int) -> None:
            j = after[i]
            if j < n and (r := pair.get(symbols[i] * base + symbols[j])) is not None:
                heapq.heappush(heap, (r, i, symbols[i], symbols[j]))

        heap: list[tuple] = []
        for i in range(n):
            push(i)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = int(made[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        return [s for s in symbols if s >= 0]

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def merges(path: str) -> Merges:
    return worker_state(("merges", path), lambda: Merges(path))


def merge_encoder(path: str, classes: bytes) -> Encoder:
    return worker_state(("bpe", path), lambda: Encoder(path, classes, merges(path).encode_words))


def _kept_fields(df: DataFrame, made: list[T.StructField]) -> T.StructType:
    names = {f.name for f in made}
    return T.StructType([f for f in df.schema.fields if f.name not in names] + made)


def _map_chunks(df: DataFrame, column: str, made: list[T.StructField], work) -> DataFrame:
    """Adds columns made from one column by work(list) -> list of Arrow arrays, a bounded chunk at a time."""
    schema = _kept_fields(df, made)
    kept = [f.name for f in schema.fields[: -len(made)]]
    names = schema.names

    def run(batches):
        step = work()
        for batch in batches:
            values = batch.column(column).to_pylist()
            for a, b in chunks_by_size([len(v) if v else 0 for v in values], CHUNK_CHARS):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(k) for k in kept] + step(values[a:b]), names=names)

    return df.mapInArrow(run, schema)


def _id_lists(raw: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *[len(r) // 4 for r in raw]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), np.int32)))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds `ids`, the token ids of each whole text. Null texts count as empty: no ids.

    `path` is a plain byte-level BPE file, readable on every machine. Special strings in a text
    become their special ids, nothing is added, cut or padded. A column already named `ids` is replaced.
    """
    classes = class_table(load(path))

    def work():
        encoder = merge_encoder(path, classes)
        return lambda texts: [_id_lists(encoder.ids([t or "" for t in texts]))]

    return _map_chunks(df, text, [T.StructField(ids, T.ArrayType(T.IntegerType(), False))], work)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds `text`, the text of each id list, special tokens included. Null lists count as empty.

    Bytes that are not valid UTF-8 become U+FFFD. An id outside the vocabulary is an error.
    """

    def work():
        vocabulary = merges(path)
        return lambda lists: [pa.array([vocabulary.decode(x or ()) for x in lists], pa.string())]

    return _map_chunks(df, ids, [T.StructField(text, T.StringType())], work)


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encode() and decode() in one pass over the rows, so that the id lists travel once."""
    classes = class_table(load(path))

    def work():
        encoder, vocabulary = merge_encoder(path, classes), merges(path)

        def step(texts):
            raw = encoder.ids([t or "" for t in texts])
            return [_id_lists(raw), pa.array([vocabulary.decode(np.frombuffer(r, np.uint32).tolist()) for r in raw], pa.string())]

        return step

    made = [T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded, T.StringType())]
    return _map_chunks(df, text, made, work)


def digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of whole texts, encoded and decoded again."""
    both = round_trip(df.select("doc_id", "text"), path)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
