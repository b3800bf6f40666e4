"""Best-fit packing of token sequences: each partition packs its own, then a tree merges what is underfull."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from fillwise.llm.common import chunks_by_size, stored
from fillwise.llm.pretokens import CHUNK_CHARS, class_table, library_encoder, load

#: Items packed together at a time, in a partition and in a group of a merge round.
PACKED_ITEMS = 100_000
#: Groups of one round that the next round packs together.
FAN_IN = 8
PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("bin", T.LongType()),
    T.StructField("place", T.LongType()), T.StructField("fill", T.LongType()),
])


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit in decreasing order: of each item its bin and place, and of each bin its fill.

    Bins are kept by free room; one integer has a bit for each room that some bin has, so the
    tightest bin that holds an item is its lowest bit at or above the item's size.
    """
    sizes = np.asarray(sizes, np.int64)
    bins, places, fills = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    present = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = present >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            number = rooms[room].pop()
            if not rooms[room]:
                present ^= 1 << room
        else:
            room, number = capacity, len(fills)
            fills.append(0)
        bins[i], places[i] = number, capacity - room
        fills[number] += size
        rooms[room - size].append(number)
        present |= 1 << (room - size)
    return bins, places, np.array(fills, np.int64)


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole if they fit, else full pieces after a first rest."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def packed_locally(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of all documents with the bin and place that their own partition gave them."""
    classes = class_table(load(path))
    end = np.array([end_id], np.uint32).tobytes()

    def run(batches):
        encoder = library_encoder(path, classes)
        task, made = TaskContext.get().partitionId(), 0
        held: list[list] = [[], [], [], [], []]

        def pack():
            nonlocal made
            length = np.array(held[3], np.int64)
            bins, places, fills = best_fit(length, capacity)
            columns = [pa.array(x, t.type) for x, t in zip(held, pa.schema([("d", pa.int64()), ("p", pa.int32()), ("s", pa.int64()), ("l", pa.int64()), ("c", pa.int64())]))]
            columns += [pa.array((task << 33) + made + bins), pa.array(places), pa.array(fills[bins])]
            made += len(fills)
            for x in held:
                x.clear()
            return pa.RecordBatch.from_arrays(columns, names=PIECES.names)

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in chunks_by_size([len(t) for t in texts], CHUNK_CHARS):
                for doc_id, raw in zip(ids[a:b], encoder.ids(texts[a:b])):
                    raw += end
                    for piece, (start, length) in enumerate(cut_pieces(len(raw) // 4, capacity)):
                        crc = zlib.crc32(raw[4 * start : 4 * (start + length)])
                        for x, v in zip(held, (doc_id, piece, start, length, crc)):
                            x.append(v)
                if len(held[0]) >= PACKED_ITEMS:
                    yield pack()
        if held[0]:
            yield pack()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, PIECES)


def merge_round(items: DataFrame, groups: int, capacity: int) -> DataFrame:
    """Packs bins (bin, fill) as items: each gets the bin it goes `into`, its `shift` there, and that bin's fill."""

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("bin")
        number = rows.column("bin").to_numpy()
        bins, places, fills = best_fit(rows.column("fill").to_numpy(), capacity)
        owner = np.empty(len(fills), np.int64)
        owner[bins[places == 0]] = number[places == 0]
        return pa.table({"bin": number, "into": owner[bins], "shift": places, "fill": fills[bins]})

    grouped = items.withColumn("group", F.pmod(F.xxhash64("bin", F.lit(groups)), F.lit(groups)))
    return grouped.groupBy("group").applyInArrow(lambda t: pack(t), "bin long, into long, shift long, fill long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, slack: int = 8) -> DataFrame:
    """Packs all documents into few sequences of at most `capacity` tokens; one row for each piece.

    A document is its token ids and one `end_id`. Only documents longer than `capacity` are cut, into
    full pieces of which the first takes the rest. Columns: doc_id, piece, start, length, ids_crc32
    (of the ids as little-endian unsigned 32-bit numbers), sequence_id and offset, gapless from 0.

    Each partition packs its pieces best-fit in decreasing order. Bins with at most `slack` tokens free
    are done. The others go on as items of their fill, in ever fewer groups of at most about
    PACKED_ITEMS, until one group is left or a round no longer merges any. No group grows with the
    data. Null texts are empty: their one token is the end. Null and repeated doc_ids are kept as they
    are; each row is packed on its own. No rows give no rows.
    """
    pieces = stored(packed_locally(docs, path, capacity, end_id), "pieces")
    items = pieces.filter((F.col("place") == 0) & (F.col("fill") < capacity - slack)).select("bin", "fill")
    moved, count = None, items.count()
    groups = max(1, pieces.rdd.getNumPartitions())
    while count > 1:
        groups = max(math.ceil(groups / FAN_IN), math.ceil(count / PACKED_ITEMS))
        step = stored(merge_round(items, groups, capacity), "packing-round")
        if moved is None:
            moved = step.select("bin", "into", "shift")
        else:
            later = step.select(F.col("bin").alias("into"), F.col("into").alias("next"), F.col("shift").alias("more"))
            moved = moved.join(later, "into", "left").select(
                "bin", F.coalesce("next", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        items = step.filter((F.col("bin") == F.col("into")) & (F.col("fill") < capacity - slack)).select("bin", "fill")
        before, count = count, items.count()
        if groups == 1 or (count >= 0.999 * before and math.ceil(groups / FAN_IN) <= math.ceil(count / PACKED_ITEMS)):
            break
    if moved is not None:
        pieces = pieces.join(moved, "bin", "left")
    else:
        pieces = pieces.withColumns({"into": F.col("bin"), "shift": F.lit(0).cast("long")})
    return pieces.select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("sequence_id"),
        (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset"))
