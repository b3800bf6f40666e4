"""Language-model scoring by logistic mixing of context bit predictors.

A text is its UTF-8 bytes and an end sign (byte 0xFF, which no text holds), each coded as 8 binary
decisions. A predictor of order 1 to 5 counts, for the last bytes and the bits coded so far, how
often 0 and 1 followed in all training texts. Their logits are summed with weights chosen by a gate
(how many orders know their context, and the bit's place), learned online; a last stage refines the
probability by what followed it before. Every probability depends on the last five bytes only, so
each distinct run of six bytes (a window) is counted and scored once.

Counts are exact at every size. Windows are dealt by the last three bytes before theirs into buckets
whose number follows the input; a bucket holds all windows of its contexts of orders 3 to 5, so their
counts are sums over runs of its sorted windows. Orders 1 and 2 have at most 2^24 windows and are sent
whole. Texts and scores meet by chunk, a stretch of a task's texts.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from fillwise.llm.common import arrow_batches, chunks_by_size, stored, worker_state
from fillwise.llm.hashing import mix

#: Orders of the contexts, and the byte after a text.
ORDERS, END = 5, 0xFF
CHUNK_BYTES = 1_000_000
#: Distinct windows after which a chunk of texts ends, and windows held before they are merged.
CHUNK_TYPES, HELD_TYPES = 600_000, 1_200_000
#: Bytes of text for each bucket of windows, and the least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 4_000_000, 256
#: Windows whose counts are laid out at a time, in whole contexts of order 3.
SLICE_TYPES = 100_000
#: A worker and its JVM both hold a batch of rows, which are windows of whole chunks and buckets.
BATCH = "8m"
#: Gates: known orders (0 to 5) times the bit's place; buckets of the last stage's logits from -8 to 8.
GATES, BUCKETS = (ORDERS + 1) * 8, 33
LEAST = 1e-4
#: Passes of the mixer over all training windows; weight of the logistic curve in the last stage's cells.
ROUNDS, PRIOR = 2, 20.0


def pieces(texts: list[bytes]):
    """(first text, last text, windows, starts, owners) of chunks of whole texts or of slices of long ones.

    A window packs a byte and the five before it (zeros before a text) in a 48-bit number.
    """
    held, size = [], 0

    def done():
        joined = np.frombuffer(b"".join(p for _, p in held), np.uint8).astype(np.uint64)
        packed = joined.copy()
        for i in range(1, ORDERS + 1):
            packed[i:] |= joined[:-i] << np.uint64(8 * i)
        ends = np.cumsum([len(p) for _, p in held])
        real = np.ones(len(joined), bool)
        for s in range(ORDERS):
            real[np.concatenate([[0], ends[:-1]]) + s] = False
        counts = np.array([len(p) - ORDERS for _, p in held])
        return packed[real], np.concatenate([[0], np.cumsum(counts)[:-1]]), [i for i, _ in held]

    for i, text in enumerate(texts):
        whole = bytes(ORDERS) + text + bytes([END])
        for first in range(0, len(whole) - ORDERS, CHUNK_BYTES):
            part = whole[first : first + CHUNK_BYTES + ORDERS]
            if held and size + len(part) > CHUNK_BYTES:
                yield done()
                held, size = [], 0
            held.append((i, part))
            size += len(part)
    if held:
        yield done()


def bit(windows: np.ndarray, place: int) -> np.ndarray:
    return (windows >> np.uint64(7 - place)) & np.uint64(1) == 1


def keys_of(windows: np.ndarray) -> np.ndarray:
    """Windows with the last three bytes of the context in front: x3 x2 x1 x5 x4 and the byte itself."""
    front = (windows >> np.uint64(8)) & np.uint64(0xFFFFFF)
    return front << np.uint64(24) | (windows >> np.uint64(32)) << np.uint64(8) | windows & np.uint64(255)


def context_keys(keys: np.ndarray, order: int) -> np.ndarray:
    """The context of an order and the byte after it, of each key."""
    front, byte = keys >> np.uint64(24), keys & np.uint64(255)
    if order == ORDERS:
        return keys
    if order == 4:
        return front << np.uint64(16) | keys & np.uint64(0xFFFF)
    return (front & np.uint64((1 << 8 * order) - 1)) << np.uint64(8) | byte


def packed(numbers: np.ndarray, width: int) -> bytes:
    """The lowest `width` bytes of sorted or small numbers, byte place by byte place: that compresses well."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(blob: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


#: Bytes of a key, and of the counts of one chunk and of all.
KEY, FEW, MANY = 6, 4, 8


def _merged(parts: list[tuple]) -> tuple[np.ndarray, ...]:
    """Distinct keys of (keys, n, texts) and their sums."""
    if len(parts) == 1:
        return parts[0]
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys, kind="stable")  # sorted runs
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], *(np.add.reduceat(np.concatenate([p[i] for p in parts])[order], first) for i in (1, 2))


def counted(texts: list[bytes], trains: np.ndarray):
    """(keys, n, texts) of pieces of texts: occurrences in, and number of, the texts that train."""
    for windows, starts, owners in pieces(texts):
        ends = [*starts.tolist()[1:], len(windows)]
        for a in range(0, len(starts), 1 << 16):
            first, last = int(starts[a]), ends[min(a + (1 << 16), len(starts)) - 1]
            sizes = np.diff(np.append(starts[a : a + (1 << 16)], last))
            own = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
            both = np.sort(keys_of(windows[first:last]) << np.uint64(16) | own)
            begin = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
            times, both = np.diff(np.append(begin, len(both))), both[begin]
            learned = trains[np.array(owners)[a : a + (1 << 16)]][(both & np.uint64(0xFFFF)).astype(np.int64)]
            keys = both >> np.uint64(16)
            begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            yield keys[begin], np.add.reduceat(times * learned, begin), np.add.reduceat(learned.astype(np.int64), begin)


def chunked(rows: DataFrame, buckets: int) -> DataFrame:
    """Of each chunk its texts (bucket null), and of each bucket the chunk's distinct windows with n and texts."""

    def run(batches):
        chunk, parts = TaskContext.get().partitionId() << 33, []

        def windows():
            keys, n, texts = _merged(parts)
            bucket = (mix(keys >> np.uint64(24)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            begin = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0]))
            cut = list(zip(begin.tolist(), [*begin.tolist()[1:], len(order)]))
            blobs = [pa.array([packed(x[order[a:b]], width) for a, b in cut], pa.binary()) for x, width in ((keys, KEY), (n, FEW), (texts, FEW))]
            none = pa.nulls(len(cut))
            return pa.RecordBatch.from_arrays(
                [pa.array([chunk] * len(cut), pa.int64()), pa.array(bucket[order[begin]]), none.cast(kind), none.cast(pa.bool_()), none.cast(pa.string()), *blobs], names=names)

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            trains = ~np.array(batch.column("held_out").to_pylist(), bool)
            for a, b in chunks_by_size(pc.binary_length(batch.column("text")).to_pylist(), CHUNK_BYTES):
                parts += counted([t.encode() for t in batch.column("text").slice(a, b - a).to_pylist()], trains[a:b])
                none = pa.nulls(b - a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * (b - a), pa.int64()), none.cast(pa.int32()), *(batch.column(c).slice(a, b - a) for c in ("doc_id", "held_out", "text")),
                     *[none.cast(pa.binary())] * 3], names=names)
                if sum(len(p[0]) for p in parts) > HELD_TYPES:
                    parts = [_merged(parts)]
                    if len(parts[0][0]) > CHUNK_TYPES:
                        yield windows()
                        chunk, parts = chunk + 1, []
        if parts:
            yield windows()

    names = ["chunk", "bucket", "doc_id", "held_out", "text", "keys", "n", "texts"]
    doc = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "held_out", "text").mapInArrow(
        run, f"chunk long, bucket int, doc_id {doc}, held_out boolean, text string, keys binary, n binary, texts binary")


def count_types(chunks: DataFrame) -> DataFrame:
    """bucket, and its distinct windows (sorted keys) with n and texts over all chunks."""

    def run(batches):
        bucket, parts = None, []

        def whole():
            keys, n, texts = _merged(parts)
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([packed(x, width)], pa.binary()) for x, width in ((keys, KEY), (n, MANY), (texts, MANY)))],
                                              names=["bucket", "keys", "n", "texts"])

        for batch in batches:
            for own, *blobs in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys", "n", "texts"))):
                if parts and own != bucket:
                    yield whole()
                    parts = []
                bucket = own
                parts.append(tuple(unpacked(x, width) for x, width in zip(blobs, (KEY, FEW, FEW))))
                if len(parts) > 1 and sum(len(p[0]) for p in parts[1:]) > max(HELD_TYPES, len(parts[0][0])):
                    parts = [_merged(parts)]
        if parts:
            yield whole()

    rows = chunks.filter("bucket is not null").select("bucket", "keys", "n", "texts").repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(run, "bucket int, keys binary, n binary, texts binary")


def count_grams(types: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted windows of order 2 and their n, at most 2^24."""

    def run(batches):
        for batch in batches:
            for keys, n in zip(batch.column("keys").to_pylist(), batch.column("n").to_pylist()):
                grams, where = np.unique(context_keys(unpacked(keys, KEY), 2), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams.astype(np.int32)), pa.array(np.bincount(where, unpacked(n, MANY)).astype(np.int64))], names=["gram", "n"])

    table = types.select("keys", "n").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # at most 2^24
    grams, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(grams, kind="stable")
    return grams[order].astype(np.uint64), n[order]


def totals(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(9, keys): occurrences of each key's context followed by the first 0 to 8 bits of its byte; keys are sorted.

    Whole numbers, so that their differences are exact however frequent a context is.
    """
    out = np.empty((9, len(keys)), np.int64)
    for bits in range(9):
        part = keys >> np.uint64(8 - bits)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        out[bits] = np.repeat(np.add.reduceat(n.astype(np.int64), first), np.diff(np.append(first, len(keys))))
    return out


def low_orders(grams: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted keys and totals of orders 1 and 2."""
    pairs, where = np.unique(grams & np.uint64(0xFFFF), return_inverse=True)
    return [(pairs, totals(pairs, np.bincount(where, n, len(pairs)).astype(np.int64))), (grams, totals(grams, n))] if len(grams) else []


def path_counts(keys: np.ndarray, n: np.ndarray, low: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(orders, 2, 8, keys): how often each bit of a key came after its path in each order, and how often the other bit did.

    `keys` has whole contexts of order 3.
    """
    out = np.empty((ORDERS, 2, 8, len(keys)), np.float32)
    for order in range(1, ORDERS + 1):
        own, where = np.unique(context_keys(keys, order), return_inverse=True)
        if order < 3:
            known, sums = low[order - 1]
            sums = sums[:, np.searchsorted(known, own)]
        else:
            sums = totals(own, np.bincount(where, n, len(own)).astype(np.int64))
        out[order - 1, 0] = sums[1:].astype(np.float32)[:, where]
        out[order - 1, 1] = (sums[:-1] - sums[1:]).astype(np.float32)[:, where]
    return out


def inputs_of(counts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """(keys, 8, orders): stretched probabilities of a one at each place, NaN where the context is unknown."""
    same, other = counts[:, 0], counts[:, 1]
    ones = np.stack([bit(keys, p) for p in range(8)])
    return np.ascontiguousarray(logits(np.where(ones, other, same), np.where(ones, same, other)).transpose(2, 1, 0))


def slices(keys: np.ndarray):
    """(first, end) of about SLICE_TYPES sorted keys, in whole contexts of order 3."""
    first = 0
    while first < len(keys):
        end = min(first + SLICE_TYPES, len(keys))
        end = int(np.searchsorted(keys, ((keys[end - 1] >> np.uint64(24)) + np.uint64(1)) << np.uint64(24)))
        yield first, end
        first = end


def logits(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Stretched probability of a one; NaN where nothing was counted."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(zeros + ones > 0, np.log((ones + 0.4) / (zeros + 0.4)), np.nan).astype(np.float32)


def gated(inputs: np.ndarray, place: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Inputs (orders and one constant) without NaN, and the gate of each."""
    known = ~np.isnan(inputs)
    x = np.empty((inputs.shape[0], ORDERS + 1), np.float32)
    x[:, :ORDERS] = np.where(known, inputs, 0)
    x[:, ORDERS] = 0.3
    return x, known.sum(axis=1) * 8 + place


def refined(last: np.ndarray, node: np.ndarray, logit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability after the last stage, and the bucket and share it was read from."""
    spot = (np.clip(logit, -7.999, 7.999) + 8) * ((BUCKETS - 1) / 16)
    low = spot.astype(np.int64)
    share = spot - low
    seen = last[node, low] * (1 - share) + last[node, low + 1] * share
    p = 1 / (1 + np.exp(-np.clip(logit, -12, 12)))
    return np.clip((p + seen) / 2, LEAST, 1 - LEAST), low, share


def initial() -> tuple[np.ndarray, np.ndarray]:
    """Weights by gate and the last stage's table before anything is learned."""
    return np.full((GATES, ORDERS + 1), 0.3), np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, BUCKETS))), (256, 1))


def learn(keys: np.ndarray, n: np.ndarray, texts: np.ndarray, low: list, weights: np.ndarray, rate: float = 0.02, step: int = 512) -> tuple[np.ndarray, ...]:
    """Weights after an online pass over a bucket's training windows, the occurrences at each gate, and the last stage's ones and all.

    A window counts as often as it occurs. It is predicted from the counts less its mean count in a
    text that has it: what only one text has is unknown there.
    """
    weights, last = weights.copy(), initial()[1]
    size, seen, ones, every = last.size, np.zeros(GATES), np.zeros(last.size), np.zeros(last.size)
    for a, b in slices(keys):
        counts = path_counts(keys[a:b], n[a:b], low)
        used = np.flatnonzero(n[a:b])
        used = used[np.argsort(mix(keys[a:b][used]))]  # neighbours share contexts
        own, times = keys[a:b][used], n[a:b][used]
        counts = counts[..., used]
        counts[:, 0] = np.maximum(counts[:, 0] - (times / texts[a:b][used]).astype(np.float32), 0)
        inputs = inputs_of(counts, own)
        truth = np.stack([bit(own, p) for p in range(8)], axis=1)
        nodes = np.stack([((own & np.uint64(255)) | np.uint64(256)) >> np.uint64(8 - p) for p in range(8)], axis=1).astype(np.int64)
        for i in range(0, len(own), step):
            xs, gs = gated(inputs[i : i + step].reshape(-1, ORDERS), np.tile(np.arange(8), len(own[i : i + step])))
            ts, ns, rs = truth[i : i + step].ravel(), nodes[i : i + step].ravel(), np.repeat(times[i : i + step], 8).astype(np.float64)
            logit = np.einsum("ij,ij->i", xs, weights[gs])
            error = rs * (ts - 1 / (1 + np.exp(-np.clip(logit, -12, 12))))
            number, weight = np.bincount(gs, minlength=GATES), np.bincount(gs, rs, GATES)
            seen += weight
            move = np.stack([np.bincount(gs, error * xs[:, j], GATES) for j in range(ORDERS + 1)], axis=1)
            weights += rate * move * (np.sqrt(number) / np.maximum(weight, 1))[:, None]
            _, spot, share = refined(last, ns, logit)
            for cell, part in ((ns * BUCKETS + spot, rs * (1 - share)), (ns * BUCKETS + spot + 1, rs * share)):
                every += np.bincount(cell, part, size)
                ones += np.bincount(cell, part * ts, size)
    return weights * seen[:, None], seen, ones, every


def _sums(rows: DataFrame) -> DataFrame:
    """The sum of arrays of doubles in `sums`, one row a task."""

    def run(batches):
        total = None
        for batch in batches:
            for raw in batch.column("sums").to_pylist():
                total = np.frombuffer(raw) + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return rows.select("sums").mapInArrow(run, "sums binary")


def fit_mixer(types: DataFrame, low) -> tuple[np.ndarray, np.ndarray]:
    """Weights by gate and the last stage's table, from all training windows.

    In each round every bucket learns online from the weights of the round before. Weights are averaged
    by the occurrences at their gate; the last stage's cells are sums. Buckets, not tasks, decide the result.
    """
    weights, last = initial()
    cuts = np.cumsum([weights.size, GATES, last.size])
    for _ in range(ROUNDS):

        def run(batches, start=weights):
            for batch in batches:
                for blobs in zip(*(batch.column(c).to_pylist() for c in ("keys", "n", "texts"))):
                    keys, n, texts = (unpacked(x, width) for x, width in zip(blobs, (KEY, MANY, MANY)))
                    sums = np.concatenate([x.ravel() for x in learn(keys, n, texts, low(), start)])
                    yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

        parts = _sums(types.select("keys", "n", "texts").mapInArrow(run, "sums binary"))
        parts = stored(parts, "learned")
        while (tasks := parts.rdd.getNumPartitions()) > 16:
            parts = stored(_sums(parts.coalesce(math.ceil(tasks / 8))), "learned")
        rows = [np.frombuffer(r["sums"]) for r in parts.collect()]  # at most a few dozen of fixed size
        if rows:
            moved, seen, ones, every = np.split(sum(rows), cuts)
            moved = moved.reshape(weights.shape)
            weights = np.where(seen[:, None] > 0, moved / np.maximum(seen, 1)[:, None], weights)
            curve = initial()[1]
            last = (ones.reshape(last.shape) + PRIOR * curve) / (every.reshape(last.shape) + PRIOR)
    return weights, last


def mixed(byte: np.ndarray, inputs, weights: np.ndarray, last: np.ndarray) -> np.ndarray:
    """log10 probability of each byte (the low 8 bits), from inputs(place) of all orders."""
    total = np.zeros(len(byte))
    for place in range(8):
        x, gate = gated(inputs(place), place)
        logit = np.einsum("ij,ij->i", x, weights[gate])
        node = (((byte & np.uint64(255)) | np.uint64(256)) >> np.uint64(8 - place)).astype(np.int64)
        p, _, _ = refined(last, node, logit)
        total += np.log10(np.where(bit(byte, place), p, 1 - p))
    return total


def key_scores(keys: np.ndarray, n: np.ndarray, low: list, weights: np.ndarray, last: np.ndarray) -> np.ndarray:
    """log10 probability of each key's byte after its five others, by the exact counts of a bucket."""
    out = np.empty(len(keys), np.float32)
    for a, b in slices(keys):
        inputs = inputs_of(path_counts(keys[a:b], n[a:b], low), keys[a:b])
        out[a:b] = mixed(keys[a:b], lambda p: inputs[:, p], weights, last)
    return out


def scored_types(chunks: DataFrame, types: DataFrame, low, model) -> DataFrame:
    """chunk, keys and scores of the chunks' windows, by bucket."""

    def run(batches):
        for batch in batches:
            for chunk, own, n in zip(*(batch.column(c).to_pylist() for c in ("chunk", "keys", "n"))):
                wanted = unpacked(own, KEY)
                if chunk is None:
                    keys, scores = wanted, key_scores(wanted, unpacked(n, MANY), low(), *model)
                    continue
                found = scores[np.searchsorted(keys, wanted)]
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([own], pa.binary()), pa.array([found.tobytes()], pa.binary())], names=["chunk", "keys", "scores"])

    own = chunks.filter("bucket is not null").select("bucket", "chunk", "keys", F.lit(None).cast("binary").alias("n"))
    rows = types.select("bucket", F.lit(None).cast("long").alias("chunk"), "keys", "n").unionByName(own)
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", F.col("chunk").asc_nulls_first())
    return rows.select("chunk", "keys", "n").mapInArrow(run, "chunk long, keys binary, scores binary")


def count_words(texts: DataFrame) -> DataFrame:
    """word and n over all texts."""

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.update((text or "").encode().translate(LOWER).split())
                if len(held) > 300_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
                    held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def score_documents(docs: DataFrame, *, frequent_words: int = 200_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte of every row.

    The model learns from the documents that are not held out: all their bytes and words are counted.
    base_score is the add-one unigram log10 probability of the lower-cased words and one end; score the
    mixing model's log10 probability of the text's bytes and end, bits_per_byte its cost a byte.

    The mixer learns from all of them too. Up to `frequent_words` of the most frequent words are looked up
    in the tasks that score; the others are joined by word, exactly. Null and empty texts have the end only. Rows
    without doc_id train. No training rows: every base probability is 1 and every bit's is one half.
    """
    with arrow_batches(docs.sparkSession, BATCH):  # all that runs in Python is stored before it ends
        return _scored(docs, frequent_words)


def _scored(docs: DataFrame, frequent_words: int) -> DataFrame:
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    train = rows.filter(~held_out(F.col("doc_id")))
    words = stored(count_words(train), "words")
    n_train = train.count()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(LEAST_BUCKETS, math.ceil(size / BUCKET_BYTES))
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens = sums[0] + n_train
    below = math.log10(tokens + sums[1] + (n_train > 0) + 1)
    size = F.floor(F.log2("n") * 8)  # an eighth of a doubling: a few hundred sizes
    sizes, room, least_size = words.groupBy(size.alias("size")).count().collect(), frequent_words, 1 << 30
    for row in sorted(sizes, key=lambda r: -r["size"]):
        room -= row["count"]
        if room < 0:
            break
        least_size = row["size"]
    top = words.filter(size >= least_size).toArrow()  # bounded by frequent_words
    frequent = {w: math.log10(n + 1) - below for w, n in zip(top.column("word").to_pylist(), top.column("n").to_pylist())}
    chunks = stored(chunked(rows.withColumn("held_out", held_out(F.col("doc_id"))), buckets), "chunks")
    types = stored(count_types(chunks), "types")
    context, token = docs.sparkSession.sparkContext, uuid.uuid4().hex  # names this model among those a worker may have met
    grams = context.broadcast(count_grams(types))

    def low():
        return worker_state(("mixing", token), lambda: low_orders(*grams.value))

    scores = scored_types(chunks, types, low, fit_mixer(types, low))
    common = context.broadcast(frequent)

    def scored_texts(part, keys, values, task, row):
        frequent = common.value
        raw = [t.encode() for t in part.column("text").to_pylist()]
        score = np.zeros(len(raw))
        for windows, starts, owner in pieces(raw):
            own, where = np.unique(keys_of(windows), return_inverse=True)
            np.add.at(score, owner, np.add.reduceat(values[np.searchsorted(keys, own)][where], starts))
        n, base, known, rare = [], [], [], []
        for text in raw:
            words = text.translate(LOWER).split()
            found = list(map(frequent.get, words))
            other = Counter(w for w, x in zip(words, found) if x is None)
            n.append(len(words) + 1)
            known.append(len(words) - other.total())
            base.append(math.fsum(x for x in found if x is not None))
            rare.append([{"word": w, "times": c} for w, c in other.items()])
        return pa.RecordBatch.from_arrays(
            [pa.array((task << 33) + np.arange(row, row + len(raw))), part.column("doc_id"), part.column("held_out"),
             pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score),
             pa.array([len(t) for t in raw], pa.int64()), pa.array(rare, pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())])))],
            names=["row", "doc_id", "held_out", "n_tokens", "found", "base", "score", "n_bytes", "rare"])

    def run(batches):
        task, row = TaskContext.get().partitionId(), 0
        parts, keys, values = [], None, None
        for batch in batches:
            is_text = np.array(batch.column("keys").is_null())
            edge = np.flatnonzero(np.diff(is_text)) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(is_text)]):
                part = batch.slice(a, b - a)
                if not is_text[a]:
                    keys = None  # another chunk begins, or goes on
                    parts += zip(part.column("keys").to_pylist(), part.column("scores").to_pylist())
                    continue
                if keys is None:
                    keys = np.concatenate([unpacked(k, KEY) for k, _ in parts])
                    values = np.concatenate([np.frombuffer(v, np.float32) for _, v in parts])
                    order = np.argsort(keys)
                    keys, values, parts = keys[order], values[order].astype(np.float64), []
                for c, d in chunks_by_size(pc.binary_length(part.column("text")).to_pylist(), 4 * CHUNK_BYTES):
                    yield scored_texts(part.slice(c, d - c), keys, values, task, row)
                    row += d - c

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = chunks.filter("bucket is null").select("chunk", "doc_id", "held_out", "text")
    met = texts.unionByName(scores, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", F.col("keys").isNull())
    scored = stored(met.mapInArrow(
        run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, found long, base double, score double, n_bytes long, "
             "rare array<struct<word: binary, times: bigint>>"), "scored")
    others = scored.select("row", F.explode("rare").alias("x")).select("row", "x.*").join(words, "word", "left")
    others = others.groupBy("row").agg(
        F.sum(F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 1) - below)).alias("rare_base"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    end = math.log10(n_train + 1) - below
    return scored.drop("rare").join(others, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("found") + F.coalesce("rare_known", F.lit(0)) + int(n_train > 0)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + end).alias("base_score"), "score", "n_bytes",
        (-F.col("score") * math.log2(10) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))
