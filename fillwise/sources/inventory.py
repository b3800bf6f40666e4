"""Inventory snapshots (CSV exports); only the newest file counts."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.clean import blank_to_null, quantity
from ..schemas import INVENTORY
from .forecasts import OPENS, quote_map

# Column names of the inventory export.
SKU, SUPPLIER_PO, AVAILABLE, DESCRIPTION = (
    "Item__No__", "Item__Qty__on_Purch__Order_", "QtyAvailable", "Item_Item_Description")


def snapshot_day(file_name: Column, modified: Column) -> Column:
    """Date spelled in a file name such as ``Stock 14July2026.csv`` or ``14Jul2026``, else the file's own date."""
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    text = F.regexp_extract(stem, r"(\d{1,2}[A-Za-z]{3,9}\d{4})", 1)
    return F.coalesce(F.try_to_date(text, "dMMMMyyyy"), F.try_to_date(text, "dMMMyyyy"), modified.cast("date"))


def clean_rows(raw: DataFrame) -> DataFrame:
    """Typed rows of one or more raw exports (`file_name`, `modified_at` and the export's text columns)."""
    described = blank_to_null(F.col(DESCRIPTION)) if DESCRIPTION in raw.columns else F.lit(None).cast("string")
    return raw.select(
        blank_to_null(F.col(SKU)).alias("vendor_sku"),
        quantity(F.col(AVAILABLE)).alias("qty_available"),
        quantity(F.col(SUPPLIER_PO)).alias("supplier_po_qty"),
        snapshot_day(F.col("file_name"), F.col("modified_at")).alias("inventory_snapshot_date"),
        F.col("file_name").alias("inventory_source_file"),
        described.alias("inventory_description"),
    )


def latest_snapshot(rows: DataFrame) -> DataFrame:
    """Rows of the newest file, summed per SKU.

    The newest file is a one-row scalar subquery, so the rows themselves are shuffled once, after
    partial aggregation. Two files of the same day: the alphabetically last one counts.
    """
    newest = rows.agg(F.max(F.struct("inventory_snapshot_date", "inventory_source_file")).alias("newest"))
    mark = F.struct("inventory_snapshot_date", "inventory_source_file")
    return (
        rows.filter(mark == newest.select("newest").scalar())
        .filter(F.col("vendor_sku").isNotNull())
        .groupBy("vendor_sku")
        .agg(
            F.sum("qty_available").alias("qty_available"),
            F.sum("supplier_po_qty").alias("supplier_po_qty"),
            F.max("inventory_snapshot_date").alias("inventory_snapshot_date"),
            F.min("inventory_source_file").alias("inventory_source_file"),
            F.min("inventory_description").alias("inventory_description"),
        )
        .select(INVENTORY.fieldNames())
    )


def read_inventory(spark: SparkSession, folder: str, encoding: str = "UTF-8") -> DataFrame:
    """The newest snapshot in a folder of CSV exports.

    The newest file is found from the file listing (names and dates only); just that file is read.
    """
    names = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
        .select("path", "modificationTime")
        .withColumn("file_name", F.url_decode(F.element_at(F.split("path", "/"), -1)))
        .withColumn("snapshot", snapshot_day(F.col("file_name"), F.col("modificationTime")))
    )
    newest = names.agg(F.max_by(F.struct("path", "file_name", "modificationTime"),
                                F.struct("snapshot", "file_name")).alias("n")).select("n.*").first()
    if newest is None or newest["path"] is None:
        return spark.createDataFrame([], INVENTORY)
    # Only a file with line breaks inside cells has to be read as a whole; any other is split.
    opens = quote_map(F.col("value")).bitwiseAND(OPENS) == OPENS
    breaks = not spark.read.option("encoding", encoding).text(newest["path"]).filter(opens).isEmpty()
    raw = spark.read.csv(newest["path"], header=True, inferSchema=False, encoding=encoding, quote='"', escape='"', multiLine=breaks)
    if not {SKU, SUPPLIER_PO, AVAILABLE} <= set(raw.columns):
        return spark.createDataFrame([], INVENTORY)
    raw = raw.withColumns({"file_name": F.lit(newest["file_name"]),
                           "modified_at": F.lit(newest["modificationTime"])})
    return latest_snapshot(clean_rows(raw))
