"""File streams into stored tables.

The checkpoint remembers which files were read, so a rerun only takes new ones. Both targets survive a
retried batch: acknowledgements go to the file sink, which commits a batch once, and forecasts to a
table that knows the batches it holds.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import shared_folder
from ..sources.acks import flatten_documents, read_documents, rejected_lines, valid_lines
from ..sources.forecasts import parse_sheets, stream_sheet_lines, with_place
from .forecast_table import ForecastTable


def _append(df: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    return (
        df.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def ingest_acks(spark: SparkSession, source: str, table: str, checkpoint: str | None = None,
                json_lines: bool = False, pattern: str = "*.json*") -> StreamingQuery:
    """Append the valid lines of all new documents below `source`."""
    documents = read_documents(spark, source, streaming=True, json_lines=json_lines, pattern=pattern)
    return _append(valid_lines(flatten_documents(documents)), table, checkpoint or shared_folder(spark, "acks"))


def ingest_ack_rejects(spark: SparkSession, source: str, table: str, checkpoint: str | None = None,
                       json_lines: bool = False, pattern: str = "*.json*") -> StreamingQuery:
    """Append what `ingest_acks` leaves out."""
    documents = read_documents(spark, source, streaming=True, json_lines=json_lines, pattern=pattern)
    return _append(rejected_lines(flatten_documents(documents)), table, checkpoint or shared_folder(spark, "ack_rejects"))


def ingest_forecasts(spark: SparkSession, source: str, table: str, checkpoint: str | None = None) -> StreamingQuery:
    """Merge all new sheets below `source` into a ForecastTable.

    Each batch is a version of its own: a late older sheet changes only what is not known better. The stream sees a
    path once; `ForecastTable.load` also follows files that were rewritten or removed.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        lines = with_place(batch)
        files = lines.groupBy("source_file").agg(F.first("size").alias("size"), F.first("modified_at").alias("modified_at"))
        ForecastTable(batch.sparkSession, table).merge(parse_sheets(lines.drop("size")), files, batch=batch_id)

    return (
        stream_sheet_lines(spark, source).writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint or shared_folder(spark, "forecasts"))
        .trigger(availableNow=True).start()
    )


def current_forecasts(spark: SparkSession, table: str) -> DataFrame:
    """The newest row per product and month of a stored table."""
    return ForecastTable(spark, table).current()
