"""Removes bytes covered by long repeated strings, by merging Burrows-Wheeler transforms of shards.

Windows of `length` bytes meet where they are equal: the least-hashed 64-byte string of a window (its
anchor, the leftmost of equals) depends on the window's bytes only, so equal windows have equal
anchors at equal places. Only the surroundings of anchors found more than once go on, as pieces. Of
the pieces of one anchor, shards build transforms over an alphabet of 40-byte blocks (each suffix
goes on 40 bytes later), and the transforms are merged by refining the interleave of their suffixes
one block at a time. Suffixes that no refinement has parted share that many blocks: after `length` /
40 rounds, those in one interval share a window. No suffix is sorted anew.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fillwise.llm.common import chunks_by_size, stored
from fillwise.llm.hashing import mix

#: Bytes of a repeated string, of an anchor and of a block; blocks divide the length.
LENGTH, ANCHOR, BLOCK = 200, 64, 40
CHUNK_BYTES = 100_000
#: Bytes of pieces merged at a time; shards whose transforms are merged. Anchors with more are split by content first.
MERGED_BYTES, SHARDS = 1_000_000, 4
BASE = 0x9E3779B97F4A7C15


def rolled(signs: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all strings of `width` bytes, by doubling."""
    part, size, done, covered = signs.astype(np.uint64) + np.uint64(1), 1, None, 0
    base = BASE
    while True:
        if width & size:
            if done is None:
                done, covered = part, size
            else:  # what is covered so far, then the next part
                power = pow(BASE, covered, 2**64)
                n = len(signs) - covered - size + 1
                done, covered = done[:n] + part[covered : covered + n] * np.uint64(power), covered + size
        if covered == width:
            return mix(done)
        part = part[: len(part) - size] + part[size:] * np.uint64(base)
        base, size = base * base % 2**64, 2 * size


def anchored(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: the text's number, first window, windows, anchor hash.

    Texts shorter than a window have none. Places are counted from each text's begin.
    """
    long = [i for i, t in enumerate(texts) if len(t) >= LENGTH]
    if not long:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    sizes = np.array([len(texts[i]) for i in long])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    hashes = rolled(np.frombuffer(b"".join([texts[i] for i in long]), np.uint8), ANCHOR)
    least = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    span, size = LENGTH - ANCHOR + 1, 1
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if span > size:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.ones(len(anchor), bool)
    for e in (begin + sizes)[:-1].tolist():
        inside[e - LENGTH + 1 : e] = False
    place = np.flatnonzero(inside)
    own = anchor[place]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (np.diff(place) != 1)]))
    text = np.searchsorted(begin, place[first], "right") - 1
    windows = np.diff(np.append(first, len(place)))
    return np.array(long)[text], place[first] - begin[text], windows, hashes[own[first]]


def dealt(symbols: np.ndarray) -> np.ndarray:
    """The stable order of 32-bit symbols: by their lower, then by their upper halves, each a radix sort."""
    order = np.argsort(symbols.astype(np.uint16), kind="stable")
    upper = (symbols >> np.uint32(16)).astype(np.uint16)
    return order[np.argsort(upper[order], kind="stable")] if upper.any() else order


def suffixes(pieces: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of all suffixes of the pieces: piece, place, the block it begins with and the suffix 40 bytes before.

    A suffix is a place in a piece. Blocks are numbered from 1 by their hash; the last 40 places have
    none, symbol 0. Stepping back from a piece's first places leads to those empty suffixes, so that
    every suffix is met.
    """
    sizes = np.array([len(p) for p in pieces])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    total = int((sizes + 1).sum())
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes + 1)
    place = (np.arange(total) - begin[piece]).astype(np.int32)
    left = sizes.astype(np.int32)[piece] - place
    signs = np.frombuffer(b"".join([p + b"\0" for p in pieces]), np.uint8)
    blocks = np.zeros(total, np.uint64)
    hashes = rolled(signs, BLOCK) | np.uint64(1) if total >= BLOCK else np.empty(0, np.uint64)
    blocks[: len(hashes)] = hashes
    blocks[left < BLOCK] = 0
    symbol = np.unique(np.append(blocks, np.uint64(0)), return_inverse=True)[1][:-1].astype(np.uint32)
    back = np.arange(-BLOCK, total - BLOCK, dtype=np.int32)
    early = np.flatnonzero(place < BLOCK)
    size = sizes[piece[early]]
    back[early] = begin[piece[early]] + size - (size - place[early]) % BLOCK
    return piece, place, symbol, back


class Shard:
    """The transform of a shard's suffixes: their order by blocks, and the block before each of them."""

    def __init__(self, place: np.ndarray, symbol: np.ndarray, back: np.ndarray, rounds: int):
        before = np.where(place >= BLOCK, symbol[back], np.uint32(0))  # nothing before a piece's first places
        order = np.arange(len(place), dtype=np.int32)
        for _ in range(rounds):
            order = back[order[dealt(before[order])]]
        self.order, self.before = order, before[order]


def merged(shards: list[Shard], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, interval): of all suffixes in merged order the shard each comes from, and its interval.

    Suffixes of one interval agree in `rounds` blocks. Each round reads the shards' transforms in the
    order of the interleave so far and deals the shard numbers stably by the block read.
    """
    interleave = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(s.order) for s in shards])
    interval = np.zeros(len(interleave), np.int32)
    for _ in range(rounds):
        read = np.empty(len(interleave), np.uint32)
        for number, shard in enumerate(shards):
            read[interleave == number] = shard.before
        order = dealt(read)
        read, interval, interleave = read[order], interval[order], interleave[order]
        new = np.ones(len(read), bool)
        new[1:] = (read[1:] != read[:-1]) | (interval[1:] != interval[:-1])
        interval = np.cumsum(new, dtype=np.int32)
    return interleave, interval


def repeated_windows(pieces: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """Of each piece a flag a window: whether it is in the pieces, each taken `counts` times, more than once."""
    rounds = LENGTH // BLOCK
    piece, place, symbol, back = suffixes(pieces)
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes + 1)
    cuts = sorted({0, len(place), *(int(ends[len(pieces) * i // SHARDS - 1]) for i in range(1, SHARDS) if len(pieces) * i // SHARDS)})
    shards = [Shard(place[a:b], symbol[a:b], back[a:b] - np.int32(a), rounds) for a, b in zip(cuts, cuts[1:])]
    interleave, interval = merged(shards, rounds)
    suffix = np.empty(len(interleave), np.int64)
    for number, (first, shard) in enumerate(zip(cuts, shards)):
        suffix[interleave == number] = shard.order + np.int64(first)
    window = (place + LENGTH <= sizes[piece])[suffix]
    weight = np.where(window, np.array(counts)[piece[suffix]], 0)
    often = np.bincount(interval, weight)[interval] >= 2
    flagged = np.zeros(len(place), bool)
    flagged[suffix[window & often]] = True
    return [flagged[e - n - 1 : max(e - n - 1, e - LENGTH)] for e, n in zip(ends.tolist(), sizes.tolist())]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the runs of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def anchors_of(texts: DataFrame) -> DataFrame:
    """anchor, text_id and place (first window) of all runs; a task gives a text that repeats once in a stretch."""

    def run(batches):
        given: set[bytes] = set()
        for batch in batches:
            ids = batch.column("text_id").to_pylist()
            raw = [t.encode() for t in batch.column("text").to_pylist()]
            if len(given) > 300_000:
                given.clear()
            new = []
            for i, x in enumerate(ids):
                if x not in given and len(raw[i]) >= LENGTH:
                    given.add(x)
                    new.append(i)
            for a, b in chunks_by_size([len(raw[i]) for i in new], CHUNK_BYTES):
                text, first, _, anchor = anchored([raw[i] for i in new[a:b]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), batch.column("text_id").take(pa.array(np.array(new[a:b], np.int64)[text])), pa.array(first)],
                    names=["anchor", "text_id", "place"])

    return texts.mapInArrow(run, "anchor long, text_id binary, place long")


def pieces_of(texts: DataFrame) -> DataFrame:
    """anchor, piece_id, text_id, place, windows and piece around the `places` of texts.

    A piece's bytes come only with the first of its copies in a stretch of a task's rows.
    """

    def run(batches):
        given: set[bytes] = set()
        for batch in batches:
            ids, places = batch.column("text_id").to_pylist(), batch.column("places").to_pylist()
            raw = [t.encode() for t in batch.column("text").to_pylist()]
            for a, b in chunks_by_size([len(t) for t in raw], CHUNK_BYTES):
                wanted = [set(p) for p in places[a:b]]
                out: list[list] = [[], [], [], [], [], []]
                for text, first, windows, anchor in zip(*(x.tolist() for x in _signed(anchored(raw[a:b])))):
                    if first not in wanted[text]:
                        continue
                    piece = raw[a + text][first : first + windows + LENGTH - 1]
                    name = hashlib.blake2b(piece, digest_size=16).digest()
                    new = name not in given
                    if new:
                        if len(given) > 500_000:
                            given.clear()
                        given.add(name)
                    for column, value in zip(out, (anchor, name, ids[a + text], first, windows, piece if new else None)):
                        column.append(value)
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, k in zip(out, kinds)], names=["anchor", "piece_id", "text_id", "place", "windows", "piece"])

    return texts.mapInArrow(run, "anchor long, piece_id binary, text_id binary, place long, windows long, piece binary")


def _signed(columns: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    return *columns[:3], columns[3].view(np.int64)


def anchor_place(piece: bytes) -> int:
    """Where the anchor of a piece's windows begins."""
    return int(np.argmin(rolled(np.frombuffer(piece[:LENGTH], np.uint8), ANCHOR) >> np.uint64(32)))


def halved(rows: DataFrame) -> DataFrame:
    """Pieces (anchor, low, high, at, begin, n, piece_id, piece) cut in two, their groups named anew, and part_id.

    Equal windows lie equally far around their anchor. Of windows that begin `low` to `high` bytes before
    it, all have the `low` bytes before and LENGTH - ANCHOR - `high` bytes after it: those name the group.
    """

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], [], [], []]
            for row in batch.to_pylist():
                piece, low, high = row["piece"], row["low"], row["high"]
                at = anchor_place(piece) if row["at"] is None else row["at"]
                middle, last = (low + high) // 2, len(piece) - LENGTH
                for a, b in ((low, middle), (middle + 1, high)):
                    i, j = max(0, at - b), min(last, at - a)
                    if a > b or i > j:
                        continue
                    part, own = piece[i : j + LENGTH], at - i
                    shared = part[own - a : own + LENGTH - b]
                    group = hashlib.blake2b(b"%d %d " % (a, b) + shared, digest_size=8).digest()
                    name = hashlib.blake2b(part, digest_size=16).digest()
                    for column, value in zip(out, (int.from_bytes(group, "big", signed=True), a, b, own, row["begin"] + i, row["n"], row["piece_id"], part, name)):
                        column.append(value)
            kinds = (pa.int64(), *[pa.int32()] * 3, *[pa.int64()] * 2, *[pa.binary()] * 3)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(out, kinds)], names=["anchor", "low", "high", "at", "begin", "n", "piece_id", "piece", "part_id"])

    return rows.mapInArrow(run, "anchor long, low int, high int, at int, begin long, n long, piece_id binary, piece binary, part_id binary")


def merged_pieces(pieces: DataFrame) -> DataFrame:
    """piece_id and runs of repeated windows of distinct pieces (anchor, piece_id, n, piece) that have any.

    Pieces of an anchor with more than MERGED_BYTES are halved, group by group, until a group is small or
    has equal parts only (at the latest when each part is one window). A piece's runs may come in several rows.
    """
    size = F.sum(F.length("piece"))
    hot = stored(pieces.groupBy("anchor").agg(size.alias("size")).filter(F.col("size") > MERGED_BYTES).select("anchor"), "hot")
    if hot.isEmpty():
        return _merged_groups(pieces)
    found = _merged_groups(pieces.join(F.broadcast(hot), "anchor", "left_anti"))  # hot: one row for MERGED_BYTES at most
    rows = pieces.join(F.broadcast(hot), "anchor", "left_semi").select(
        "anchor", F.lit(0).alias("low"), F.lit(LENGTH - ANCHOR).alias("high"), F.lit(None).cast("int").alias("at"),
        F.lit(0).cast("long").alias("begin"), "n", "piece_id", "piece")
    while not rows.isEmpty():
        rows = stored(halved(rows), "halves")
        kinds = stored(rows.groupBy("anchor", "part_id").agg(F.sum("n").alias("n"), F.first("piece").alias("piece")), "kinds")
        groups = stored(kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), size.alias("size")), "groups")
        hot = groups.filter((F.col("kinds") > 1) & (F.col("size") > MERGED_BYTES)).select("anchor")
        small = groups.filter((F.col("kinds") > 1) & (F.col("size") <= MERGED_BYTES)).select("anchor")
        several = kinds.withColumnRenamed("part_id", "piece_id").join(small, "anchor", "left_semi")
        equal = kinds.filter("n > 1").join(groups.filter("kinds = 1").select("anchor"), "anchor", "left_semi")
        whole = F.array(F.struct(F.lit(0).cast("long").alias("begin"), (F.length("piece") - LENGTH + 1).cast("long").alias("end")))
        spans = _merged_groups(several.select("anchor", "piece_id", "n", "piece")).unionByName(equal.select(F.col("part_id").alias("piece_id"), whole.alias("spans")))
        met = rows.select("part_id", "piece_id", F.col("begin").alias("moved")).join(spans.withColumnRenamed("piece_id", "part_id"), "part_id")
        found = found.unionByName(met.select("piece_id", F.transform("spans", lambda x: F.struct(
            (x["begin"] + F.col("moved")).alias("begin"), (x["end"] + F.col("moved")).alias("end"))).alias("spans")))
        rows = rows.join(F.broadcast(hot), "anchor", "left_semi").drop("part_id")
    return found


def _merged_groups(pieces: DataFrame) -> DataFrame:
    """merged_pieces() of anchors none of which has much more than MERGED_BYTES."""

    def run(batches):
        anchors, ids, counts, raw = [], [], [], []
        size = 0

        def done(upto: int):
            found, spans = [], []
            for name, flags in zip(ids[:upto], repeated_windows(raw[:upto], counts[:upto])):
                if flags.any():
                    found.append(name)
                    spans.append([{"begin": x, "end": y} for x, y in runs(flags)])
            for x in (anchors, ids, counts, raw):
                del x[:upto]
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(spans, kind)], names=["piece_id", "spans"])

        for batch in batches:
            for anchor, name, n, piece in zip(*[batch.column(c).to_pylist() for c in ("anchor", "piece_id", "n", "piece")]):
                if anchors and anchor != anchors[-1] and size > MERGED_BYTES:
                    yield done(len(ids))
                    size = 0
                anchors.append(anchor)
                ids.append(name)
                counts.append(n)
                raw.append(piece)
                size += len(piece)
        if ids:
            yield done(len(ids))

    rows = pieces.repartition("anchor").sortWithinPartitions("anchor", "piece_id")
    return rows.mapInArrow(run, "piece_id binary, spans array<struct<begin: bigint, end: bigint>>")


def cleaned(texts: DataFrame) -> DataFrame:
    """text_id, left (the bytes that stay), n_removed and n_spans of texts with their repeated runs of windows."""

    def run(batches):
        for batch in batches:
            left, removed, count = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                raw = np.frombuffer(text.encode(), np.uint8)
                edge = np.zeros(len(raw) + 1, np.int64)
                begin = np.array([s["begin"] for s in spans], np.int64)
                np.add.at(edge, begin, 1)
                np.add.at(edge, np.array([s["end"] for s in spans], np.int64) + LENGTH - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                left.append(raw[~gone].tobytes())
                removed.append(int(gone.sum()))
                count.append(len(runs(gone)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("text_id"), pa.array(left, pa.binary()), pa.array(removed, pa.int64()), pa.array(count, pa.int64())],
                names=["text_id", "left", "n_removed", "n_spans"])

    return texts.mapInArrow(run, "text_id binary, left binary, n_removed long, n_spans long")


def _texts(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("text_id", F.unhex(F.md5("text")))


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, results): of each distinct text its copies, and what `cleaned` gives for texts that lose part of themselves."""
    rows = _texts(docs)
    met = F.struct("text_id", "place")
    anchors = anchors_of(rows.select("text_id", "text"))
    # An anchor at one place of one text only, however many copies that text has, repeats nothing but the text.
    own = Window.partitionBy("anchor")
    several = anchors.withColumns({"low": F.min(met).over(own), "high": F.max(met).over(own)}).filter("low != high")
    places = several.groupBy("text_id").agg(F.collect_set("place").alias("places"))
    named = rows.groupBy("text_id").agg(F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id")).alias("row"))
    named = stored(named.select("text_id", "copies", F.col("row.doc_id").alias("doc_id")), "texts")
    chosen = places.join(named, "text_id").select("text_id", "doc_id", "copies", "places")
    same = rows["doc_id"].eqNullSafe(chosen["doc_id"]) & (rows["text_id"] == chosen["text_id"])
    texts = stored(rows.join(chosen.hint("shuffle_hash"), same).select(chosen["text_id"], "text", "copies", "places"), "anchored")
    pieces = stored(pieces_of(texts.select("text_id", "text", "places")), "pieces")

    known = pieces.groupBy("anchor", "piece_id").agg(F.count("*").alias("n"))
    known = known.join(known.groupBy("anchor").agg(F.count("*").alias("kinds")), "anchor")
    known = stored(known, "kinds")
    alone = known.filter("kinds = 1 and n > 1").select("piece_id").distinct()
    bytes_of = pieces.filter("piece is not null").select("piece_id", "piece")
    mixed = known.filter("kinds > 1").join(bytes_of, "piece_id").dropDuplicates(["anchor", "piece_id"]).select("anchor", "piece_id", "n", "piece")
    none = F.lit(None).cast("array<struct<begin: bigint, end: bigint>>")
    spans = stored(merged_pieces(mixed).unionByName(alone.withColumn("spans", none)), "spans")
    found = pieces.select("piece_id", "text_id", "place", "windows").join(spans, "piece_id")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("windows").alias("end")))
    found = found.withColumn("span", F.explode(F.coalesce("spans", whole)))
    found = found.groupBy("text_id").agg(F.collect_set(F.struct(
        (F.col("place") + F.col("span.begin")).alias("begin"), (F.col("place") + F.col("span.end")).alias("end"))).alias("spans"))
    results = cleaned(texts.filter("copies = 1").select("text_id", "text").join(found, "text_id"))
    return named.select("text_id", "copies"), stored(results, "cleaned")


def _whole(size: Column) -> Column:
    return (F.col("copies") > 1) & (size >= LENGTH)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and left (the bytes that stay) of every row.

    A byte goes if a string of LENGTH bytes that covers it also starts anywhere else in the texts of
    all rows, its own included; strings never cross rows and are judged on the input. `left` may cut
    through a character. Null texts are empty. Null and repeated doc_ids are kept as they are; a text
    of LENGTH bytes or more that several rows hold goes whole. Texts and pieces are told apart by
    128-bit digests, blocks by 64-bit hashes of which five in a row must agree.
    """
    named, results = repeats(docs)
    size = F.octet_length("text").cast("long")
    out = _texts(docs).join(named, "text_id").join(results, "text_id", "left")
    return out.select(
        "doc_id", size.alias("n_bytes"), F.when(_whole(size), size).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(_whole(size), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(_whole(size), F.lit(b"")).when(F.col("left").isNotNull(), F.col("left")).otherwise(F.col("text").cast("binary")).alias("left"))


def report(docs: DataFrame) -> DataFrame:
    """without_repeats() with kept_sha256 in place of `left`; whole texts stay where they are read."""
    named, results = repeats(docs)
    results = results.select("text_id", "n_removed", "n_spans", F.sha2("left", 256).alias("left_sha256"))
    rows = _texts(docs).select("doc_id", "text_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))
    out = rows.join(named, "text_id").join(results, "text_id", "left")
    gone = _whole(F.col("n_bytes"))
    return out.select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("left_sha256", "text_sha256")).alias("kept_sha256"))
