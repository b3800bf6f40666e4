"""Near-duplicate vectors by a forest of random-projection trees with spill.

Every tree splits the vectors again and again at the median of a random direction; vectors near a
split go to both sides. Vectors that share a leaf of any tree are compared.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fillwise.llm.common import stored
from fillwise.llm.components import connected_components

#: Vectors of a leaf compared at a time; larger leaves are compared block by block.
BLOCK_ROWS = 2048


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, also where squares would overflow."""
    wide = vectors.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def usable(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """key, id (a 128-bit digest of the vector), width and vector (doubles as bytes); id null for unusable rows."""

    def run(batches):
        for batch in batches:
            ids, widths, raw = [], [], []
            for row in batch.column("vector").to_pylist():
                values = None if not row or None in row else np.array(row, np.float64)
                if values is None or not np.isfinite(values).all() or not values.any():
                    ids.append(None)
                    widths.append(0)
                    raw.append(None)
                else:
                    data = values.tobytes()
                    ids.append(hashlib.blake2b(data, digest_size=16).digest())
                    widths.append(len(values))
                    raw.append(data)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(ids, pa.binary()), pa.array(widths, pa.int32()), pa.array(raw, pa.binary())],
                names=["key", "id", "width", "vector"])

    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(embedding).cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, "key long, id binary, width int, vector binary")


def tree(units: np.ndarray, depth: int, least: int, seed: list[int], first_leaf: int) -> tuple[list[tuple], int]:
    """Nodes of one tree fitted on unit vectors, and the next free leaf number.

    A node is (direction, median, left node, right node) or (leaf number,).
    """
    random = np.random.default_rng(seed)
    nodes: list[tuple] = []
    leaf = first_leaf

    def grow(rows: np.ndarray, depth: int) -> int:
        nonlocal leaf
        number = len(nodes)
        nodes.append(())
        if depth == 0 or len(rows) < 2 * least:
            nodes[number] = (leaf,)
            leaf += 1
        else:
            direction = random.standard_normal(units.shape[1])
            direction /= np.linalg.norm(direction)
            along = units[rows] @ direction
            median = float(np.median(along))
            left = grow(rows[along <= median], depth - 1)
            nodes[number] = (direction, median, left, grow(rows[along > median], depth - 1))
        return number

    grow(np.arange(len(units)), depth)
    return nodes, leaf


def route(nodes: list[tuple], units: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, leaves): every row with each of its leaves."""
    rows, leaves, todo = [], [], [(0, np.arange(len(units)))]
    while todo:
        number, own = todo.pop()
        node = nodes[number]
        if not len(own):
            continue
        if len(node) == 1:
            rows.append(own)
            leaves.append(np.full(len(own), node[0], np.int64))
            continue
        direction, median, left, right = node
        along = units[own] @ direction - median
        todo += [(left, own[along <= spill]), (right, own[along > -spill])]
    return np.concatenate(rows), np.concatenate(leaves)


def fit(sample: dict[int, np.ndarray], total: int, trees: int, leaf_rows: int, seed: int) -> dict[int, list]:
    """Trees for every width of the sample, deep enough for leaves of about leaf_rows of `total` vectors."""
    depth = max(0, math.ceil(math.log2(max(1, total) / leaf_rows)))
    forests, leaf = {}, 0
    for width in sorted(sample):
        forests[width] = []
        for number in range(trees):
            nodes, leaf = tree(sample[width], depth, 8, [seed, width, number], leaf)
            forests[width].append(nodes)
    return forests


def routed(distinct: DataFrame, forests: dict[int, list], closeness: float, spill: float) -> DataFrame:
    """id, n, vector, width, all leaves of a vector in order, and one row for each of them (`leaf`)."""
    shared = distinct.sparkSession.sparkContext.broadcast(forests)  # bounded by the sample it was fitted on
    margin = spill * math.sqrt(2 - 2 * closeness)

    def run(batches):
        for batch in batches:
            width = batch.column("width").to_numpy()
            raw = batch.column("vector").to_pylist()
            found: list[list[int]] = [[] for _ in raw]
            for w in np.unique(width).tolist():
                rows = np.flatnonzero(width == w)
                units = unit_rows(np.frombuffer(b"".join([raw[i] for i in rows.tolist()]), np.float64).reshape(len(rows), w))
                for nodes in shared.value.get(w, ()):
                    for i, leaf in zip(*(x.tolist() for x in route(nodes, units, margin / math.sqrt(w)))):
                        found[rows[i]].append(leaf)
            leaves = [sorted(x) or [-w] for x, w in zip(found, width.tolist())]  # a width that the sample lacks is one leaf
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(leaves, pa.list_(pa.int64()))], names=[*batch.schema.names, "leaves"])

    rows = distinct.mapInArrow(run, "id binary, n long, width int, vector binary, leaves array<long>")
    return rows.withColumn("leaf", F.explode("leaves"))


def compared(rows: DataFrame, closeness: float) -> DataFrame:
    """id, n_links (rows linked to it here and in no earlier leaf) and root (one id of its group here).

    One group is a pair of blocks of a leaf. A pair of vectors counts in the first leaf they share.
    """
    place, whole = Window.partitionBy("leaf").orderBy("id"), Window.partitionBy("leaf")
    rows = rows.withColumns({"block": F.floor((F.row_number().over(place) - 1) / BLOCK_ROWS), "blocks": F.ceil(F.count("*").over(whole) / BLOCK_ROWS)})
    turns = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda i: F.struct(
        F.least("block", i).alias("low"), F.greatest("block", i).alias("high")))
    rows = rows.withColumn("turn", F.explode(turns)).select("leaf", "turn.low", "turn.high", "block", "id", "n", "vector", "leaves")

    def compare(table: pa.Table) -> pa.Table:
        ids, count = table.column("id").to_pylist(), table.column("n").to_numpy()
        units = unit_rows(np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float64).reshape(len(ids), -1))
        leaf, block = table.column("leaf")[0].as_py(), table.column("block").to_numpy()
        across = table.column("low")[0].as_py() != table.column("high")[0].as_py()
        linked = units @ units.T >= closeness
        np.fill_diagonal(linked, False)
        if across:
            linked &= block[:, None] != block[None, :]
        lists = table.column("leaves").to_pylist()
        earlier = sorted({x for own in lists for x in own if x < leaf})
        met = np.zeros((len(ids), len(earlier)), np.float32)
        number = {x: i for i, x in enumerate(earlier)}
        for i, own in enumerate(lists):
            met[i, [number[x] for x in own if x < leaf]] = 1
        new = linked & (met @ met.T == 0) if earlier else linked
        root = np.full(len(ids), -1)
        for i in range(len(ids)):
            if root[i] < 0 and linked[i].any():
                reached = np.array([i])
                root[i] = i
                while len(reached):
                    more = np.flatnonzero(linked[reached].any(axis=0) & (root < 0))
                    root[more] = i
                    reached = more
        has = np.flatnonzero(root >= 0)
        return pa.table({
            "id": pa.array([ids[i] for i in has], pa.binary()), "n_links": pa.array((new[has] @ count).astype(np.int64)),
            "root": pa.array([ids[root[i]] for i in has], pa.binary())})

    return rows.groupBy("leaf", "low", "high").applyInArrow(lambda t: compare(t), "id binary, n_links long, root binary")


def near_vectors(vectors: DataFrame, *, key: str = "vec_id", embedding: str = "embedding", closeness: float = 0.95, trees: int = 6,
                 leaf_rows: int = 128, spill: float = 0.5, sample_rows: int = 50_000, seed: int = 1) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Rows are linked if the cosine of their vectors, in double precision, is `closeness` or more and a
    leaf of one of the trees holds both; every link reported is computed. n_links counts the other
    rows linked directly, copies of the same vector included. component_id is the least vec_id
    reachable; kept says whether it is the row's own. `spill` is how near a split, in standard
    deviations of the distance of two vectors of the closeness asked, a vector goes to both sides.

    Copies are compared once. The splits are fitted on a bounded sample, about `sample_rows` distinct
    vectors by hash; all vectors are routed. Leaves aim at `leaf_rows`, but at least 8 of the sample:
    with more vectors than 16 times the sample raise it, or leaves grow and are compared in blocks.
    Vectors that are null, empty, zero or hold null or non-finite components are linked with nothing, as are
    rows without vec_id (component_id null, kept true). Only vectors of one length are compared.
    """
    rows = stored(usable(vectors, key, embedding), "vectors")
    distinct = stored(rows.filter("id is not null and key is not null").groupBy("id").agg(
        F.count("*").alias("n"), F.first("width").alias("width"), F.first("vector").alias("vector")), "distinct")
    total = distinct.count()
    every = max(1, math.ceil(total / sample_rows))
    some = distinct.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("width", "vector").toArrow()  # bounded by sample_rows
    widths, raw = some.column("width").to_pylist(), some.column("vector").to_pylist()
    sample = {w: unit_rows(np.frombuffer(b"".join([v for v, x in zip(raw, widths) if x == w]), np.float64).reshape(-1, w)) for w in set(widths)}
    forests = fit(sample, total, trees, leaf_rows, seed)
    met = stored(compared(routed(distinct, forests, closeness, spill), closeness), "met")
    components = connected_components(met.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = met.groupBy("id").agg(F.sum("n_links").alias("others"))
    known = distinct.select("id", "n").join(counts, "id", "left").join(components.withColumnRenamed("node", "id"), "id", "left")
    known = known.select("id", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    owned = rows.select("key", F.when(F.col("key").isNotNull(), F.col("id")).alias("id")).join(known, "id", "left")
    least = owned.filter("component is not null").groupBy("component").agg(F.min("key").alias("component_id"))
    out = owned.join(least, "component", "left").withColumn("component_id", F.coalesce("component_id", "key"))
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id",
                      F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
