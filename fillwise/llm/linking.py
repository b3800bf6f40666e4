"""From band keys to components: candidates in each bucket, exact checks, union."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fillwise.llm.common import forget, stored
from fillwise.llm.components import connected_components

#: Members of a bucket whose signatures are compared at a time; larger buckets are compared block by block.
BLOCK_ROWS = 1024
#: Signature values of a first look at a pair; a pair still likely is judged by all values.
FIRST_LOOK = 64
#: Values of that look that are compared at a time, and pairs whose whole signatures are.
LOOK_BYTES, PAIR_ROWS = 2_000_000, 2_000
#: A pair is left unchecked if its share of equal values is so many standard deviations below the
#: similarity asked: chance hides a pair at the threshold 3 times in a million.
DEVIATIONS = 4.5
#: Bytes of prepared values that a task keeps while it checks pairs.
KEPT_BYTES = 64_000_000
#: In the first comparison of a mixed bucket each member brings only so many of its likeliest pairs.
FIRST_PAIRS = 4


def crowded(keys: DataFrame) -> DataFrame:
    """Rows (key, id and size, if there) of buckets that hold at least two different ids, each once."""
    bucket = Window.partitionBy("key")
    rows = keys.withColumns({"low": F.min("id").over(bucket), "high": F.max("id").over(bucket)})
    return rows.filter("low != high").drop("low", "high").distinct()


def _checked(pairs: DataFrame, values: DataFrame, prepare: Callable, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets, made by `prepare` of a list of values, have a Jaccard similarity of `percent` in a hundred."""
    first = values.select(F.col("id").alias("a"), F.col("value").alias("value_a"))
    second = values.select(F.col("id").alias("b"), F.col("value").alias("value_b"))
    both = pairs.join(second, "b").join(first, "a").select("a", "b", "value_a", "value_b")

    def check(batches):
        known: dict = {}
        size = 0
        for batch in batches:
            a, b, values_a, values_b = (c.to_pylist() for c in batch.columns)
            new = {k: v for ids, values in ((a, values_a), (b, values_b)) for k, v in zip(ids, values) if k not in known}
            if size > KEPT_BYTES:
                known.clear()
                size = 0
                new = dict(zip((*a, *b), (*values_a, *values_b)))
            for name, own in zip(new, prepare(list(new.values()))):
                known[name] = own
                size += own.nbytes
            found = [(x, y) for x, y in zip(a, b) if alike(known[x], known[y], percent)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[i] for p in found], batch.schema.field(i).type) for i in (0, 1)], names=["a", "b"])

    return both.mapInArrow(check, pairs.select("a", "b").schema)


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of hashes have a Jaccard similarity of `percent` in a hundred or more."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    common = int(np.count_nonzero(y.take(np.searchsorted(y, x), mode="clip") == x))
    return 100 * common >= percent * (len(x) + len(y) - common)


def least_share(percent: int, values: int) -> float:
    asked = percent / 100
    return asked - DEVIATIONS * math.sqrt(asked * (1 - asked) / values)


def _likely(members: DataFrame, signatures: DataFrame, percent: int, most: int | None) -> DataFrame:
    """Pairs (a, b) of one bucket and different components whose signatures make the similarity likely.

    `members` has (key, id, component), `signatures` (id, signature). A bucket is cut into blocks and each pair of blocks
    compared on its own, so no bucket has to fit in one task; only likely pairs leave it, of each member
    the `most` likeliest (None: all). Two members that share several buckets meet in the least key only.
    """
    keys = members.groupBy("id").agg(F.collect_list("key").alias("keys"))  # at most one a band
    members = members.join(keys, "id")
    place = Window.partitionBy("key").orderBy("component", "id")
    count = F.count("*").over(Window.partitionBy("key"))
    rows = members.withColumns({"block": F.floor((F.row_number().over(place) - 1) / BLOCK_ROWS), "blocks": F.ceil(count / BLOCK_ROWS)})
    turns = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda i: F.struct(
        F.least("block", i).alias("low"), F.greatest("block", i).alias("high")))
    rows = rows.withColumn("turn", F.explode(turns)).select(
        "key", F.col("turn.low").alias("low"), F.col("turn.high").alias("high"), "block", "id", "component", "keys")
    rows = rows.join(signatures, "id")  # last: a signature is longer than all the rest
    group = ["key", "low", "high"]
    rows = rows.repartition(*group).sortWithinPartitions(*group)

    def compare(key: int, across: bool, ids: list, owner: np.ndarray, signs: np.ndarray, block: np.ndarray, keys: list[set]) -> list[tuple]:
        brief = np.ascontiguousarray(signs[:, :FIRST_LOOK].T)  # a value of all members lies together
        least, wanted = least_share(percent, signs.shape[1]), math.ceil(least_share(percent, len(brief)) * len(brief))
        pairs = set()  # a pair that both members bring is given once
        step = max(1, LOOK_BYTES // brief.size)
        for first in range(0, len(ids), step):
            mine = slice(first, min(first + step, len(ids)))
            found: dict[int, list] = {}
            good = (brief[:, mine, None] == brief[:, None, :]).sum(axis=0, dtype=np.uint8) >= wanted
            good &= owner[mine, None] != owner[None, :]
            if across:
                good &= block[mine, None] != block[None, :]
            if most is None:
                good &= np.arange(first, mine.stop)[:, None] < np.arange(len(ids))[None, :]  # each pair once
            one, other = np.nonzero(good)
            one += first
            for at in range(0, len(one), PAIR_ROWS):
                i, j = one[at : at + PAIR_ROWS], other[at : at + PAIR_ROWS]
                share = np.count_nonzero(signs[i] == signs[j], axis=1) / signs.shape[1]
                for x, y, z in zip(i[share >= least].tolist(), j[share >= least].tolist(), share[share >= least].tolist()):
                    if min(keys[x] & keys[y]) == key:
                        found.setdefault(x, []).append((-z, y))
            for x, others in found.items():
                pairs.update((min(ids[x], ids[y]), max(ids[x], ids[y])) for _, y in sorted(others)[:most])
        return list(pairs)

    def run(batches):
        held = None
        for batch in itertools.chain(batches, [None]):
            table = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if table is None or not table.num_rows:
                continue
            keys = [table.column(k).to_numpy() for k in group]
            first = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])).tolist()
            whole = first if batch is None else first[:-1]  # the last group may go on in the next batch
            held = None if batch is None else table.slice(first[-1])
            done = table.slice(0, table.num_rows if batch is None else first[-1])
            if not done.num_rows:
                continue
            pairs: list[tuple] = []
            ids, buckets = done.column("id").to_pylist(), [set(k) for k in done.column("keys").to_pylist()]
            owner = done.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
            signs = np.frombuffer(b"".join(done.column("signature").to_pylist()), np.uint8).reshape(len(ids), -1)
            block = done.column("block").to_numpy()
            for i, j in zip(whole, first[1:] + [table.num_rows]):
                own = slice(i, j)
                pairs += compare(int(keys[0][i]), keys[1][i] != keys[2][i], ids[own], owner[own], signs[own], block[own], buckets[own])
            a, b = [x for x, _ in pairs], [y for _, y in pairs]
            kind = table.schema.field("id").type
            yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])

    kind = members.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def resolve(keys: DataFrame, values_of: Callable[[DataFrame], DataFrame], sign: Callable, prepare: Callable,
            percent: int, ties: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """node and component of all ids that are linked to another.

    `keys` has (key, id) and may have the sets' `size`; ids that share a key are candidates, and linked
    if their sets have a Jaccard similarity of `percent` in a hundred (sizes that rule it out save the
    check). `prepare` makes the sets, as sorted hashes, of a list of values. `values_of` gives (id, value) for a table
    of ids; equal rows may repeat. `sign` makes signatures, 8 bits a number, of a list of values.
    `ties` gives links (a, b) that hold without a check, from a table of the ids in shared buckets.

    First each member of a bucket is checked against the least one: a bucket of copies of one text
    costs one check a member. In buckets whose members then still lie in different components, all
    others are compared by signature, and likely pairs of different components are checked: first the
    likeliest of each member, which joins what belongs together, then all that are left. So no
    group of all pairs is ever formed, and no link between components is left out for its bucket's size.
    """
    members = stored(crowded(keys), "crowded")
    values = stored(values_of(members.select("id").distinct()), "values")
    centers = members.groupBy("key").agg(F.min("id").alias("center"))
    stars = members.join(centers, "key").filter(F.col("center") < F.col("id"))
    if "size" in members.columns:
        sizes = members.select(F.col("id").alias("center"), F.col("size").alias("center_size")).distinct()
        stars = stars.join(sizes, "center").filter(100 * F.least("size", "center_size") >= percent * F.greatest("size", "center_size"))
    stars = stored(stars.select(F.col("center").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    links = _checked(stars, values, prepare, percent)
    if ties is not None:
        links = links.unionByName(ties(members.select("id").distinct()))
    links = stored(links, "links")
    components = stored(connected_components(links), "components")
    tested, read = stars, [members, values, stars, links]
    left = members.join(centers, "key").filter(F.col("id") != F.col("center")).select("key", "id")

    def signed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([s.tobytes() for s in sign(batch.column("value").to_pylist())], pa.binary())], names=["id", "signature"])

    kind = members.schema["id"].dataType.simpleString()
    signatures = None
    for most in (FIRST_PAIRS, None):
        left = left.join(components.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        left = stored(left, "left")
        mixed = left.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("key")
        left, before = stored(left.join(mixed, "key", "left_semi").select("key", "id", "component"), "mixed"), left
        forget(before)
        read.append(left)
        if left.isEmpty():
            break
        if signatures is None:  # the second comparison is among members of the first
            own = values.join(left.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
            signatures = stored(own.select("id", "value").mapInArrow(signed, f"id {kind}, signature binary"), "signed")
            read.append(signatures)
        pairs = stored(_likely(left, signatures, percent, most).join(tested, ["a", "b"], "left_anti"), "pairs")
        read.append(pairs)
        if pairs.isEmpty():
            left = left.select("key", "id")
            continue
        links = stored(links.unionByName(_checked(pairs, values, prepare, percent)), "links")
        before, components = components, stored(connected_components(links), "components")
        read += [links, before]
        tested, left = tested.unionByName(pairs), left.select("key", "id")
    forget(*read)
    return components
