"""Exports. Spark writes a folder of part files; nothing passes through the driver."""

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_table(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "overwrite") -> None:
    """Parquet; partitioning by month lets date filters prune files."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
