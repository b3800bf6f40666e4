"""What the operators share: stored intermediate tables, worker caches and the input tables."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: ASCII white space, the only separator of words here.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all machines of the cluster share.

    Where the setting is missing (tests on one machine) a folder of this session is set, once.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="run-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df`, written to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    folder = scratch(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def forget(*tables: DataFrame) -> None:
    """Deletes the folders of stored tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def arrow_batches(spark: SparkSession, size: str):
    """What runs inside hands its Python workers at most about `size` at a time, however large the rows are."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def let(value: Column, use) -> Column:
    """use(value), with value computed once a row even if `use` mentions it inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def worker_state(key, make):
    """An object kept for the life of a Python worker, over tasks: vocabularies and word caches."""
    holder = sys.modules.get("_fillwise_worker")
    if holder is None:
        holder = sys.modules["_fillwise_worker"] = types.ModuleType("_fillwise_worker")
        holder.kept = {}
    if key not in holder.kept:
        holder.kept[key] = make()
    return holder.kept[key]


def chunks_by_size(sizes, limit: int):
    """Consecutive (first, last) ranges whose sizes sum to at most `limit`, or of one item."""
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > limit:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)
