"""Connected components of a link table by star contractions; links never meet in one place."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fillwise.llm.common import forget, stored

#: Links a task contracts at a time; once no more are left, one task ends the work.
LOCAL_LINKS = 500_000


def _local_stars(batches):
    """Links of a task as stars: every node to the least node it is joined to here."""

    def stars(a, b):
        root = {}

        def find(x):
            top = x
            while (up := root.setdefault(top, top)) != top:
                top = up
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        for x, y in zip(a, b):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        pairs = [(n, find(n)) for n in list(root)]
        return [p for p in pairs if p[0] != p[1]]

    a, b, schema = [], [], None
    for batch in batches:
        schema = batch.schema
        a += batch.column(0).to_pylist()
        b += batch.column(1).to_pylist()
        if len(a) >= LOCAL_LINKS:
            done = stars(a, b)
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in done], schema.field(i).type) for i in (0, 1)], names=["a", "b"])
            a, b = [], []
    if a:
        done = stars(a, b)
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in done], schema.field(i).type) for i in (0, 1)], names=["a", "b"])


def _least(links: DataFrame) -> DataFrame:
    # Stored, so that the join below meets two plain exchanges and can split a hub's rows.
    return stored(links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(_least(both), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down)
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.filter("a != b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """node and component (the least node reachable) of every node named in `links` (a, b).

    Nodes may be of any ordered type. Null ends, links of a node to itself and repeated links do not
    matter. Each task first contracts its own links; then large-star and small-star rounds go on
    until nothing changes, about as often as the logarithm of the longest path, or until no more than
    LOCAL_LINKS are left, which one task contracts. Every round is stored in the shared folder; only a
    count and a checksum reach the driver.
    """
    pairs = links.select("a", "b").filter("a is not null and b is not null and a != b")
    stars = stored(pairs.mapInArrow(_local_stars, pairs.schema).distinct(), "stars")
    seen = None
    while True:
        state = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state[0] <= LOCAL_LINKS:
            if state[0]:
                before, stars = stars, stored(stars.coalesce(1).mapInArrow(_local_stars, pairs.schema), "stars")
                forget(before)
            break
        if state == seen:
            break
        seen = state
        before, stars = stars, stored(_small_star(_large_star(stars)), "stars")
        forget(before)
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
