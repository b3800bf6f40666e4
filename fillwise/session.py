"""Session settings the operators are written for."""

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",  # split a hot key even if that costs one more shuffle
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder below the cluster's shared checkpoint folder.

    There is no default: a folder local to one machine would lose state with that machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a shared folder, or pass the location")
    return f"{root.rstrip('/')}/fillwise/{name}"


def held(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df`, written to the shared folder and read back, so that plans that use them several times stay small.

    In a session without a shared folder `df` stays as it is: the result is the same, its plan larger.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        return df
    folder = f"{shared_folder(spark, 'held')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
